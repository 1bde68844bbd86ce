"""What several corpus operators share: the shared scratch folder and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir. Where that is unset, a local one is made if all run in this one process; a cluster must set it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chainloom-"))
    return sc.getCheckpointDir()


#: Rows of an Arrow batch that goes to Python: whole texts, so the batch's bytes follow their length.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets fewer rows than Spark's 10,000 go to Python at once, unless the session says otherwise: a batch of whole texts is held on both sides."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


#: Bytes that opening a file counts as when small files are put together for a task.
OPEN_COST = 1 << 20


def large_reads(spark: SparkSession) -> None:
    """Lets a task read more small files than Spark's 4 MB a file allow, unless the session says otherwise: many small files in else make as many small files out."""
    if spark.conf.get("spark.sql.files.openCostInBytes", "4194304") in ("4194304", "4194304b"):
        spark.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs the tasks it ran, not the job. Once a table is written, the shuffles that led to it go."""

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0
        large_reads(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a membership filter: 512 KB, whatever the input.
FILTER = 1 << 22


def membership(hashes: DataFrame, scratch: Scratch) -> DataFrame:
    """What `is_in` takes: a table of FILTER bits, one row, in which the bit of every hash (the one column, long) is set. It rules rows out before a shuffle; a hash that isn't
    there may seem to be."""
    h = F.col(hashes.columns[0])
    place = F.shiftright(h.bitwiseAND(F.lit(FILTER - 1)), 6)
    bits = hashes.select(place.alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("v"))
    every = hashes.sparkSession.range(FILTER // 64).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"))
    words = bits.groupBy("k").agg(F.bit_or("v").alias("v")).union(every).groupBy("k").agg(F.bit_or("v").alias("v"))
    return scratch.keep(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("bits")))  # FILTER / 64 longs


def is_in(h: Column, bits: DataFrame) -> Column:
    """Whether a hash may be among those of `membership`; false if it surely isn't."""
    word = F.get(bits.scalar(), F.shiftright(h.bitwiseAND(F.lit(FILTER - 1)), 6).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


SALTS = 64
#: A key is hot if more than one in so many rows has it; there are fewer hot keys than that.
HOT = 1000


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, counts: DataFrame, total: int | Column, how: str = "inner") -> DataFrame:
    """`rows` joined with the one row that `table` has for their keys. counts: keys and n, the rows of each key; total: the number of rows. Rows of a hot key are dealt over SALTS
    tasks by `spread`, and its one row is repeated for each; the hot keys themselves, fewer than HOT, are broadcast."""
    names = [f"_hot{i}" for i in range(len(keys))]
    hot = F.broadcast(counts.where(F.col("n") * HOT > total).select(*[F.col(k).alias(x) for k, x in zip(keys, names)]))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(hot, reduce(Column.__and__, [df[k] == hot[x] for k, x in zip(keys, names)]), "left")

    is_hot = F.col(names[0]).isNotNull()
    left = marked(rows).withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop(*names)
    right = marked(table).withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(*names)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_row_key(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """`docs` with one more column, and its name: a key of each row in order of id, null last. It is the id where each names one row, else the row's place among all."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    ids = docs.groupBy(doc_id).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count_if(F.col(doc_id).isNull()).alias("nulls")).first()
    if ids["n"] <= 1 and not ids["nulls"]:
        return docs.withColumn(key, F.col(doc_id)), key
    placed = docs.orderBy(F.col(doc_id).asc_nulls_last(), F.xxhash64(*docs.columns)).withColumn(key, F.monotonically_increasing_id())
    return Scratch(docs.sparkSession).keep(placed), key


def without_rows(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`docs` less the rows whose key, never null, is in the one column of `gone`. Only rows that may be among them are shuffled."""
    gone = gone.select(F.col(gone.columns[0]).alias("_gone"))
    there = is_in(F.xxhash64(key), membership(gone.select(F.xxhash64("_gone").alias("h")), Scratch(docs.sparkSession)))
    some = docs.where(there)
    return docs.where(~there).union(some.join(gone, some[key] == gone["_gone"], "left_anti"))


def tidy(f):
    """A function of batches that at its end gives freed memory back to the system. Worker processes are kept for later tasks, and allocators keep what they have had; beside a JVM
    that counts."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def without_spaces(text):
    """Column: the text (null: empty) without the six white-space bytes; chained replacements stay in generated code."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


# --- vectorised words: numpy over the bytes of a whole Arrow column -----------------------------------------------

_space = np.zeros(256, bool)
_space[[ord(c) for c in SPACES]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_value = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[_lower]
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes handled at a time; whole documents only, so one longer document makes one longer block.
BLOCK = 256 << 10
#: Bytes for which sums are held at once, however long a document is.
TILE = 64 << 10


def _powers(base: int) -> np.ndarray:
    out = np.full(TILE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(column):
    """(first row, rows, bytes, row offsets) of blocks of a pyarrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray, bag: np.ndarray | None = None):
    """(hash, start, end of every word, index of each row's first word) of a block; A-Z count as a-z. With `bag`, a number for each byte, also each word's sum of those of its
    runs of bytes with equal numbers. Sums are held for a tile at a time; a word that goes on in the next tile carries its sums over."""
    sums, bags, starts, ends = [], [], [], []
    goes_on, last = False, 0
    for t in range(0, len(data), TILE):
        d = data[t : t + TILE]
        word = ~_space[d]
        cut = offsets[np.searchsorted(offsets, t) : np.searchsorted(offsets, t + len(d))] - t
        edge = np.zeros(len(d) + 1, bool)  # edge[i]: a row begins at i
        edge[cut] = True
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        stops[:-1] &= ~word[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(_value[d] * _up[: len(d)], out=total[1:])
        h = (total[end] - total[start]) * _down[start]
        goes_on = goes_on and len(start) > 0 and start[0] == 0 and not edge[0]
        if bag is not None:
            kind = bag[d]
            new = np.ones(len(d), bool)
            new[1:] = kind[1:] != kind[:-1]
            new[start] = True
            if goes_on:
                new[0] = kind[0] != last
            last = kind[-1]
            runs = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(np.where(new, kind, np.uint64(0)), out=runs[1:])
            b = runs[end] - runs[start]
        if goes_on:
            before = int(ends[-1][-1] - starts[-1][-1])
            sums[-1][-1:] += h[:1] * np.uint64(pow(_BASE, before, 1 << 64))
            ends[-1][-1] += end[0]
            if bag is not None:
                bags[-1][-1:] += b[:1]
                b = b[1:]
            h, start, end = h[1:], start[1:], end[1:]
        goes_on = bool(word[-1])
        if len(start):
            sums.append(h)
            starts.append(start + t)
            ends.append(end + t)
            if bag is not None:
                bags.append(b)
    none = np.zeros(0, np.int64)
    start, end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    out = mix(np.concatenate([none.view(np.uint64), *sums])), start, end, np.searchsorted(start, offsets)
    return out if bag is None else (*out, mix(np.concatenate([none.view(np.uint64), *bags])))


def hash_shingles(words: np.ndarray, first: np.ndarray, k: int):
    """(hash, row) of every run of k words; a row of one to k - 1 words gives the whole run as one."""
    n, rows = len(words), len(first) - 1
    counts = np.diff(first)
    factors = [np.uint64(2 * i * 0x2545F491 + 0x9E3779B9) for i in range(k)]
    many = max(n - k + 1, 0)
    h = np.zeros(many, np.uint64)
    for i in range(k):
        h += words[i : i + many] * factors[i]
    row = np.repeat(np.arange(rows), counts)[:many]
    inside = np.arange(many) + k <= first[row + 1] if many else np.zeros(0, bool)
    h, row = mix(h[inside] + np.uint64(k)), row[inside]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        own = [mix(np.array([sum(int(w) * int(f) for w, f in zip(words[first[r] : first[r + 1]], factors)) + int(counts[r]) & (1 << 64) - 1], np.uint64))[0] for r in few]
        h, row = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row
