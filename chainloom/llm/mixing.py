"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import WORD, Scratch


def word_count(text: Column) -> Column:
    """Number of words; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """One row per source (`_s`, `source`, `source_size`): `target`, its words in the mix.

    The sources in code-point order (null last) weigh `weights` in turn and share `share` times all words by weight. A target stops at `repeats` times its source's size, and
    what it gives up is shared again. In order of the level at which each stops, a prefix of them has stopped: the final level is the greatest that its own source doesn't
    stop. The windows see one row per source, not per document."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    cap = repeats * F.col("source_size").cast("double")
    df = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", cap).withColumn("_stop", F.col("_cap") / F.col("_w"))
    every, before = Window.partitionBy(), Window.orderBy("_stop", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    df = df.withColumn("_level", level)
    level = F.max(F.when(F.col("_level") <= F.col("_stop"), F.col("_level"))).over(every)
    return df.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select("_s", "source_size", "target")


def _buckets(rows: int) -> int:
    """A power of two near the root of the number of rows: neither the rows of one bucket nor the buckets are many for one task. The result doesn't depend on it."""
    return 1 << (rows.bit_length() // 2 + 1)


def fair_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, key: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size (words), source_size, target (its source's words in the mix), copies, row (the column `key`, or doc_id, which tells rows apart).

    Each source's documents queue in a shuffled order (a hash of `row`), once for each of `repeats` rounds. `copies` holds (round, start, finish) of each: a copy starts at virtual
    time (words queued before it) / target and finishes one size later, so that the sources are served at rates in proportion to their targets.

    A running sum within a source never meets in one task: words are summed by (source, bucket of the hash), the buckets' sums run per source, and only the rows of one bucket are
    sorted together. The windows over sources see one row per source: as many as one task sorts, some millions, may be.

    Cases: null text or no words: size 0. Null source: a source of its own, last. Null or repeated ids: rows stay rows; rows alike in id and size are interchangeable. Empty
    table: no rows. Other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(key or doc_id).alias("row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    shuffled = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("row").cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 15), 16, 10).cast("long")  # 60 bits
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_h", shuffled)
    rows = Scratch(docs.sparkSession).keep(rows)  # a narrow table; the texts are read once
    buckets = _buckets(rows.count())
    rows = rows.withColumn("_b", F.shiftright("_h", 61 - buckets.bit_length()))  # its first bits
    sums = rows.groupBy("_s", "source", "_b").agg(F.sum("size").alias("_n"))
    order = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_s", "_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"))
    targets = source_targets(sums.groupBy("_s", "source").agg(F.sum("_n").alias("source_size")), weights, share, repeats)
    queue = Window.partitionBy("_s", "_b").orderBy("_h", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("_before", F.coalesce(F.sum("size").over(queue), F.lit(0))).join(offsets.join(targets, "_s"), ["_s", "_b"])

    def copy(k: int) -> Column:
        start = F.col("_offset") + F.col("_before") + k * F.col("source_size")
        at = lambda x: F.when(F.col("target") > 0, x / F.col("target"))
        return F.struct(F.lit(k).alias("round"), at(start).alias("start"), at(start + F.col("size")).alias("finish"))

    return df.select("doc_id", "row", "source", "size", "source_size", "target", F.array(*[copy(k) for k in range(repeats)]).alias("copies"))


def mix_stream(mixed: DataFrame, whole: bool = False) -> DataFrame:
    """The mix itself: row, source, size, round, finish, taken (words), range-sorted over the cluster by virtual finish time and cut at the total budget, the sum of the targets.

    A copy in service at virtual time 1, when sources served at their rates have spent the budget, is queued in two parts, the words before and after; without that the longest
    document would shift its source's share by its size. whole: copies are not parted; one is queued as it is if at least half of its words come before, else left out.

    The running sum goes in two steps: words by bucket of the finish time, then within each bucket. Parts that finish later than a bucket past the end can't be reached.

    Cases: documents without words aren't in the mix. Sources without target give nothing. Ties in finish time go by source, id and round. Empty table: no rows."""
    copies = mixed.where("size > 0 AND target > 0").select("row", "source", "size", "target", F.explode("copies").alias("_c")).select("row", "source", "size", "target", "_c.*")
    queued_before = F.round(F.col("start") * F.col("target")).cast("long")
    served = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.round("target").cast("long") - queued_before))
    copies = copies.where("start < 1").withColumn("_served", served)
    if whole:
        parts = copies.where("2 * _served >= size").withColumn("taken", F.col("size"))
    else:
        part = lambda words, at: F.struct(words.alias("taken"), at.alias("finish"))
        cut = F.array(part(F.col("_served"), F.lit(1.0).cast("double")), part(F.col("size") - F.col("_served"), F.col("finish")))
        one = F.array(part(F.col("size"), F.col("finish")))
        parts = copies.select("row", "source", "size", "target", "round", F.explode(F.when(F.col("finish") > 1, cut).otherwise(one)).alias("_p")).select("row", "source", "size", "target", "round", "_p.*").where("taken > 0")
    scratch = Scratch(mixed.sparkSession)
    parts = scratch.keep(parts.select("row", "source", "size", "round", "finish", "taken"))
    buckets = _buckets(parts.count())
    budget = scratch.keep(mixed.groupBy("source").agg(F.max("target").alias("t")).agg(F.round(F.coalesce(F.sum("t"), F.lit(0.0))).cast("long").alias("budget")))
    parts = parts.withColumn("_b", F.least(F.lit(buckets), F.floor(F.col("finish") * buckets)))
    sums = parts.groupBy("_b").agg(F.sum("taken").alias("_n"))
    offsets = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # a row per bucket
    order = Window.partitionBy("_b").orderBy("finish", F.col("source").isNull(), "source", "row", "round").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("taken").over(order), F.lit(0))
    queued = parts.join(offsets, "_b").withColumn("_left", budget.scalar() - before)
    fits = F.col("_left") >= F.col("taken") / 2 if whole else F.col("_left") > 0
    queued = queued.where(fits).withColumn("taken", F.col("taken") if whole else F.least("taken", "_left"))
    return queued.select("row", "source", "size", "round", "finish", "taken").orderBy("finish", "source", "row", "round")


def mix_report(mixed: DataFrame) -> DataFrame:
    """`fair_mix` with `taken`, the words that the mix takes of each row, repeats counted. mixed: its `row` tells rows apart."""
    took = mix_stream(mixed).groupBy(F.col("row").alias("_id")).agg(F.sum("taken").alias("taken"))
    return mixed.join(took, mixed["row"] == took["_id"], "left").select(*[mixed[c] for c in mixed.columns], F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
