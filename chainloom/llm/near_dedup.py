"""MinHash near-dedup: universal hash minima in bands, links confirmed on whole shingle sets, components by alternating large-star and small-star."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from chainloom.llm.common import Scratch, blocks, hash_shingles, hash_words, is_in, membership, salted_join, small_batches, tidy, with_row_key, without_rows

SIMILARITY = 0.8
#: Two sets of similarity s share no band with probability (1 - s**ROWS)**BANDS: 5e-7 at 0.8, 1e-9 at 0.85.
BANDS, ROWS = 48, 6
#: Of each set's first 256 minima one bit is kept. Sets of similarity s agree in (1 + s) / 2 of them; five standard deviations less is held too few, which misses 1e-6 at most.
BITS = 256
#: A set's parities: bit i tells whether an odd number of its shingles fall into class i of so many. Those of two sets differ in no more places than the sets in shingles, so that
#: no true pair is ruled out by them; they tell sets of up to some thousand shingles apart.
PARITIES = 1024
#: Members of a band that all others in it are compared with first.
CENTRES = 3

_rng = np.random.default_rng(23)
_a = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_b = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_fold = _rng.integers(0, 2**62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b modulo 2**32, a odd, over a set's 32-bit shingles, in tiles: memory doesn't grow with the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        h = np.multiply.outer(_a, x[i : i + 1024])
        h += _b[:, None]
        np.minimum(best, h.min(axis=1), out=best)
    return best


def shingle_sets(column, k: int):
    """(first row, [sorted different 64-bit shingles of each row]) by block of a pyarrow string column."""
    for i, n, data, offsets in blocks(column):
        words, _, _, first = hash_words(data, offsets)
        h, row = hash_shingles(words, first, k)
        ends = np.searchsorted(row, np.arange(n + 1))
        yield i, [np.unique(h[ends[r] : ends[r + 1]]) for r in range(n)]


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, in two longs."""
    k1 = [int(s.sum(dtype=np.uint64)) for s in sets]
    k2 = [int((s * (s >> np.uint64(17) | np.uint64(1))).sum(dtype=np.uint64)) for s in sets]
    return np.array(k1, np.uint64).view(np.int64), np.array(k2, np.uint64).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128 bits that name the set), bands (a hash of each band's minima, then four longs of one bit of each of 256 minima and sixteen of parities; empty for an empty set)."""
    schema = StructType([docs.schema["doc_id"]]).add("n_shingles", LongType()).add("k1", LongType()).add("k2", LongType()).add("bands", ArrayType(LongType()))

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for i, sets in shingle_sets(batch.column(1), k):
                k1, k2 = _names(sets)
                bands, known = [], {}
                for s, key in zip(sets, zip(k1, k2)):
                    if not len(s):
                        bands.append(np.zeros(0, np.int64))
                        continue
                    if key not in known:
                        least = minima(s)
                        cells = (least.astype(np.uint64).reshape(BANDS, ROWS) * _fold).sum(axis=1, dtype=np.uint64)
                        odd = np.bincount((s % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                        known[key] = np.concatenate([cells.view(np.int64), np.packbits((least[:BITS] >> np.uint32(7) & np.uint32(1)).astype(bool)).view(np.int64), np.packbits(odd.astype(bool)).view(np.int64)])
                    bands.append(known[key])
                ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))], names=schema.names)

    return docs.mapInArrow(tidy(made), schema)


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, k1, k2, s: the sorted shingles as bytes."""
    schema = StructType([docs.schema["doc_id"]]).add("k1", LongType()).add("k2", LongType()).add("s", BinaryType())

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for i, sets in shingle_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), *map(pa.array, _names(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)

    return docs.mapInArrow(tidy(made), schema)


def alike(x, y, nx, ny, similarity: float):
    """Column: whether two arrays of signature bits agree as often as those of sets of that similarity do, and their parities, of sets of nx and ny shingles, allow it."""
    p, percent = (1 + similarity) / 2, round(similarity * 100)
    differ = lambda i, j: sum((F.bit_count(x[n].bitwiseXOR(y[n])) for n in range(i, j)), F.lit(0))
    split, end = BITS // 64, (BITS + PARITIES) // 64
    likely = differ(0, split) <= BITS - int(BITS * p - 5 * (BITS * p * (1 - p)) ** 0.5)
    return likely & (differ(split, end) * (100 + percent) <= (nx + ny) * (100 - percent))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), a table that is read more than once, those whose whole sets (id, s) reach the similarity. The pairs of a centre that has many are dealt over many tasks."""
    percent, total = round(similarity * 100), pairs.agg(F.count("*")).scalar()
    of = lambda e: sets.select(F.col("id").alias(e), F.col("s").alias("s" + e))
    one = salted_join(pairs, of("a"), ["a"], "b", pairs.groupBy("a").agg(F.count("*").alias("n")), total)
    both = salted_join(one, of("b"), ["b"], "a", pairs.groupBy("b").agg(F.count("*").alias("n")), total).select("a", "b", "sa", "sb")

    def checked(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.mapInArrow(tidy(checked), pairs.select("a", "b").schema)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root (the least id reachable) of every id in links (a, b), by large-star and small-star rounds until neither changes the links.

    A node's least neighbour comes from a grouped minimum joined back, never from a gathered list, so a hub's links stay many rows. The links of each round are a small table in
    the shared folder."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = stamp(edges)

    def with_least(rows: DataFrame, total: int) -> DataFrame:
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return salted_join(rows, least.select("u", "m"), ["u"], "v", least.select("u", "n"), total)

    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each larger neighbour points to the least, the node itself included
        large = with_least(both, 2 * last[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.keep(large.distinct())
        small = with_least(large, last[0])  # large has no more rows than edges
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        scratch.drop(edges, large)
        edges, now = new, stamp(new)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def near_components(docs: DataFrame, k: int = 5, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links, itself included), kept (it is that id) of each row of `docs`.

    Documents link if the Jaccard similarity of their sets of different k-word shingles (A-Z as a-z; fewer words: all as one) reaches the bound.
    1. One read gives each set's size, name and band hashes. Equal sets become one class, led by its least id.
    2. Leaders that share a band are candidates. First each is compared with three centres of each of its bands, the same for most bands of a group, which joins a large group of
       near copies through stars; then, within bands whose members lie in different components still, the pairs across components are. A pair is left out only if its ends are
       connected already, or their sizes, signature bits or parities rule it out. All others are confirmed on their whole sets.
    3. Components of the confirmed links by large-star and small-star; members follow their leader.

    Classes have numbers of their own, so that rows with one id but different texts stay apart, and rows without id link like any other.

    Cases: null or empty text or no words: no shingles, its own component. Repeated rows, equal sets: one class. Null id: never a component's name unless no member has an id.
    Very long texts: whole. Empty table: no rows. Other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    name = ["n_shingles", "k1", "k2"]
    scratch, texts = Scratch(spark), docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = scratch.keep(signatures(texts, k))
    classes = rows.where("n_shingles > 0").groupBy(*name).agg(F.min("doc_id").alias("leader"), F.count("*").alias("members"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()))
    led = lambda df, *keys: df.join(classes.select(*[F.col(x).alias("_" + x) for x in keys], "leader", "id"), reduce(Column.__and__, [F.col(x) == F.col("_" + x) for x in keys]) & F.col("doc_id").eqNullSafe(F.col("leader")))
    leaders = led(rows, *name).dropDuplicates(["id"]).select("id", F.col("n_shingles").alias("n"), "bands")
    leaders = scratch.keep(leaders)
    cells = leaders.select("id", "n", F.posexplode(F.slice("bands", 1, BANDS)).alias("band", "h")).select("id", "n", F.xxhash64("band", "h").alias("cell"))
    choose = [F.min("id").alias("c0"), *(F.min_by("id", F.xxhash64("id", F.lit(r))).alias(f"c{r}") for r in range(1, CENTRES))]
    centres = cells.groupBy("cell").agg(F.count("*").alias("m"), *choose).where("m > 1").drop("m")
    cells = scratch.keep(cells.join(centres, "cell"))
    wanted = scratch.keep(cells.select("id").distinct())
    bits = scratch.keep(leaders.select("id", "n", F.slice("bands", BANDS + 1, (BITS + PARITIES) // 64).alias("bits")).join(wanted, "id", "left_semi"))
    scratch.drop(leaders)
    sized = lambda a, b: (F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9)
    stars = cells.select("id", F.explode(F.array_distinct(F.array(*[f"c{r}" for r in range(CENTRES)]))).alias("c")).where("id <> c")
    stars = stars.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    of = lambda s: bits.select(F.col("id").alias(s), F.col("n").alias("n" + s), F.col("bits").alias("bits" + s))
    near = sized(F.col("na"), F.col("nb")) & alike(F.col("bitsa"), F.col("bitsb"), F.col("na"), F.col("nb"), similarity)
    pairs = scratch.keep(stars.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b"))

    # texts of leaders that share a band: a filter lets few others by, and the join lets none
    there = membership(classes.join(wanted, "id", "left_semi").select(F.xxhash64("leader").alias("h")), scratch)
    sets = led(whole_sets(texts.where(is_in(F.xxhash64("doc_id"), there)), k), "k1", "k2").join(wanted, "id", "left_semi")
    sets = scratch.keep(sets.select("id", "s").dropDuplicates(["id"]))
    links = scratch.keep(confirmed(pairs, sets, similarity))

    roots = scratch.keep(components(links, scratch))
    placed = scratch.keep(cells.select("cell", "id").join(roots, "id", "left").select("cell", "id", F.coalesce("root", "id").alias("root")))
    split = placed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    # a pair across components shares split cells only, and is compared in the least of them, so that it's made once however many bands it shares
    split = placed.join(split, "cell", "left_semi").groupBy("id", "root").agg(F.collect_set("cell").alias("cells"))  # BANDS at most
    placed = split.join(bits, "id").select("*", F.explode("cells").alias("cell"))
    x, y = (placed.select("cell", *[F.col(c).alias(c + s) for c in ("n", "root", "bits", "cells")], F.col("id").alias(s)) for s in "ab")
    once = F.array_min(F.array_intersect("cellsa", "cellsb")) == F.col("cell")
    across = x.join(y, "cell").where((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb")) & near & once).select("a", "b")
    across = scratch.keep(across.join(pairs, ["a", "b"], "left_anti"))
    more = scratch.keep(confirmed(across, sets, similarity))
    scratch.drop(cells, wanted, bits, sets, pairs, across)
    roots = scratch.keep(components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more), scratch))

    whole = scratch.keep(classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    labels = whole.groupBy("root").agg(F.min("leader").alias("component"), F.count("*").alias("n"))
    n_rows = rows.agg(F.count("*")).scalar()
    whole = salted_join(whole, labels.select("root", "component"), ["root"], "id", labels.select("root", "n"), whole.agg(F.count("*")).scalar()).select(*name, "component")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    some = salted_join(rows.where("n_shingles > 0").select("doc_id", *name, F.monotonically_increasing_id().alias("_spread")), whole, name, "_spread", classes.select(*name, F.col("members").alias("n")), n_rows)
    out = none.union(some.select("doc_id", "n_shingles", "component"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, one document of each component left (that of the least id; of rows that ids don't tell apart, the first by hash), with all their columns.

    Cases: as in near_components; rows alike in all, or without id, leave one."""
    keyed, key = with_row_key(docs, doc_id)
    gone = near_components(keyed, k, similarity, key, text).where("NOT kept").select("doc_id")
    return without_rows(keyed, gone, key).drop(key)
