"""Document fingerprints: SpotSigs, chains of content words that follow common-word anchors."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from chainloom.llm.common import Scratch, small_batches, tidy
from chainloom.llm.setjoin import candidates, prefix_size, reaches

#: Articles and forms of "to be" of four languages, which begin a spot.
ANCHORS = frozenset("a an the is are was be el la los las un una es der die das ein eine ist le les une est".split())
#: Common words that are no content.
COMMON = ANCHORS | frozenset(
    "and at as by for from in it of on or that this to with he she they we you i de del en y que con por para se su al lo no und zu von mit den dem auf für nicht sich auch im et du des dans qui par pour sur au avec pas ce il elle".split()
)
#: Content words in a chain.
CHAIN = 3


def signatures(text: str) -> list[int]:
    """The sorted 32-bit hashes of a text's chains. Words are lower-cased and bare of surrounding punctuation. A text with no whole chain gives every run of CHAIN content words, or
    of all its words if it has fewer content words, so that an edit changes a few hashes only; one with fewer words than that gives them all as one."""
    import xxhash

    content, spots = [], []
    for w in text.lower().split():
        if not w.isalnum():
            w = w.strip(".,;:!?\"'()[]|*%&$#")
        if w in ANCHORS:
            spots.append((w, len(content)))
        elif w and w not in COMMON:
            content.append(w)
    h, n = xxhash.xxh32_intdigest, len(content)
    found = {h(f"{w} {' '.join(content[i : i + CHAIN])}") for w, i in spots if i + CHAIN <= n}
    if not found and (words := text.lower().split()):
        runs = content if n >= CHAIN else words
        found = {h(" ".join(runs[i : i + CHAIN])) for i in range(max(len(runs) - CHAIN, 0) + 1)}
    return sorted(found)


def likeness(a: list[int], b: list[int]) -> float:
    """Jaccard similarity; 1 of two empty fingerprints. Sizes that differ settle nothing here but bound the count: only what can be common is counted."""
    if not a or not b:
        return float(not a and not b)
    common = len(set(a).intersection(b))
    return common / (len(a) + len(b) - common)


def printed(sigs: list[int]) -> str:
    return np.array(sigs, ">u4").tobytes().hex()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (8 hex digits for each signature, ascending) of each row of `docs`. No shuffle.

    Cases: null or empty text: fingerprint "". Repeated rows and null ids: printed alike. Very long texts: whole. Empty table: no rows. Other columns are ignored."""
    small_batches(docs.sparkSession)
    schema = StructType([docs.select(docs[doc_id].alias("doc_id")).schema[0]]).add("fingerprint", StringType())

    def made(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([printed(signatures(t.as_py() or "")) for t in batch.column(1)], pa.string())], names=schema.names)

    return docs.select(docs[doc_id], docs[text]).mapInArrow(tidy(made), schema)


def similar(prints: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of a table of doc_id, fingerprint. classes: doc_id, fingerprint's class (hash), members. links: pairs of classes whose fingerprints' Jaccard similarity
    reaches the bound: equal fingerprints collapse first, then sets meet by prefix within partitions of set length, and are verified whole. Links between different fingerprints are
    all returned, as many as there are.

    Cases: null or empty fingerprints: linked to none. Repeated rows: members of one class. Empty table: no rows."""
    scratch = Scratch(prints.sparkSession)
    own = scratch.keep(prints.select("doc_id", "fingerprint", F.xxhash64("fingerprint").alias("class")))
    one = own.where("fingerprint <> ''").groupBy("class").agg(F.min("fingerprint").alias("f"))
    sets = one.select(F.col("class").alias("id"), F.transform(F.sequence(F.lit(0), (F.length("f") / 8 - 1).cast("int")), lambda i: F.substring(F.col("f"), i * 8 + 1, F.lit(8))).alias("t"))
    sets = scratch.keep(sets.withColumn("n", F.size("t")))
    pairs = candidates(sets.select("id", "n", F.slice("t", 1, prefix_size(F.col("n"), similarity)).alias("prefix")), similarity)
    whole = pairs.join(sets.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    links = whole.where(reaches(F.col("ta"), F.col("tb"), similarity)).select("a", "b")
    members = own.groupBy("class").agg(F.count("*").alias("members"))
    return own.join(members, "class").select("doc_id", "class", "members"), links


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint against that of an edited text and of the next row by ascending id (after the last: the first).

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next text. Rows go once, by range of id, to sorted partitions; the first
    row of each range is also sent to the range before it, so that each row meets its next one. Partitions are read as streams.

    Cases: null text: empty. Empty texts: fingerprint "", likeness 1 to each other. One row alone is its own next. Equal ids are ordered by text. Null ids come first. Very long
    texts: whole. Empty table: no rows. Other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of about equal numbers of rows: the least id of each, of which there are as many as partitions
    ranges = rows.select("doc_id").repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    firsts = sorted({r["first"] for r in ranges if r["first"] is not None})

    def placed(ids: pa.Array) -> pa.Array:
        known = ids.drop_null().to_pylist()
        out = np.zeros(len(ids), np.int32)  # null ids come first
        out[ids.is_valid().to_numpy(zero_copy_only=False)] = [max(bisect.bisect_right(firsts, i) - 1, 0) for i in known]
        return pa.array(out)

    moved = rows.withColumn("_p", F.arrow_udf(placed, "int")("doc_id")).withColumn("_halo", F.lit(False))
    if any(r["nulls"] for r in ranges):
        begins = [None, *firsts[1:]]
    else:
        begins = firsts
    if begins:
        halo = [(first, (p or max(len(firsts), 1)) - 1) for p, first in enumerate(begins)]  # the first row of all comes after the last
        at = spark.createDataFrame(halo, StructType([StructField("_first", rows.schema["doc_id"].dataType), StructField("_p", IntegerType())]))  # a row per range
        moved = moved.union(rows.join(F.broadcast(at), F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "text", "_p", F.lit(True).alias("_halo")))
    moved = moved.repartitionById(max(len(firsts), 1), "_p").sortWithinPartitions("_p", "_halo", F.col("doc_id").asc_nulls_first(), "text")
    schema = StructType([rows.schema["doc_id"]]).add("n_chars", LongType()).add("edited_sha256", StringType()).add("fingerprint", StringType()).add("edited_fingerprint", StringType()).add("near_edited", DoubleType()).add("near_next", DoubleType())

    def compared(batches):
        held = None  # (part, id, text, signatures) of the row that waits for its next one
        for batch in batches:
            out = []
            for doc, own, p, halo in zip(*(batch.column(k) for k in ("doc_id", "text", "_p", "_halo"))):
                own, p, halo = own.as_py(), p.as_py(), halo.as_py()
                if halo and (held is None or held[0] != p):
                    continue  # a further row of the same first id
                sigs = signatures(own)
                if held is not None and held[0] == p:
                    _, name, text, mine = held
                    half = len(text) // 2
                    edited = text[: len(text) - half] + own[:half]
                    other = signatures(edited)
                    out.append((name, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(mine), printed(other), likeness(mine, other), likeness(mine, sigs)))
                held = None if halo else (p, doc.as_py(), own, sigs)
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=schema.names)

    return moved.mapInArrow(tidy(compared), schema)
