"""Exact dedup by progressive refinement: length, prefix hash, full hash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import Scratch, is_in, membership, salted_join, without_spaces

PREFIX = 256
#: Always true. As it reads the row numbers, the filter beside it stays above the column that it tests; below it would compute the shape several times.
NUMBERED = "_tie >= 0"


def _shape(text: str) -> list[Column]:
    """Length and prefix hash of a text without white space."""
    norm = without_spaces(F.col(text))
    return [F.length(norm).alias("_len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("_prefix")]


def _shared(docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """The shapes that several rows have, as a filter: a row that it rules out has no equal.

    Rows are grouped by length; those whose length others have by length and prefix hash. The groups of more than one row are kept in a filter of fixed size, so that neither
    step, nor the one that reads whole texts, joins rows to groups: a common length stays where it lies."""
    narrow = scratch.keep(docs.select(*_shape(text)))
    several = lambda df, *keys: membership(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(F.xxhash64(*keys).alias("h")), scratch)
    lengths = several(narrow, "_len")
    prefixes = several(narrow.where(is_in(F.xxhash64("_len"), lengths)), "_len", "_prefix")
    scratch.drop(narrow)
    return prefixes


def _numbered(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """Columns of `docs`, a number for each row, which tells rows alike in all else apart, and the hash of its shape."""
    return docs.select(*columns, F.monotonically_increasing_id().alias("_tie"), F.xxhash64(*_shape(text)).alias("_h"))


def _hashed(docs: DataFrame, shared: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """Rows that share their shape with others, their whole texts hashed."""
    some = _numbered(docs, text, F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *more).where(is_in(F.col("_h"), shared))
    return some.withColumns({"_chars": F.length(F.coalesce(some["_text"], F.lit(""))), "_full": F.sha2(without_spaces(some["_text"]), 256)}).drop("_h", "_text")


def _groups(hashed: DataFrame) -> DataFrame:
    """_full, n, keep_id, _best (the number of the row that stays)."""
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_tie").alias("t"))).alias("b")
    return hashed.groupBy("_full").agg(F.count("*").alias("n"), best).select("_full", "n", F.col("b.i").alias("keep_id"), F.col("b.t").alias("_best"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept; with `digest` also text_sha256 (of the text without white space) of every row, for which all texts are hashed.

    Texts are equal if they are identical without white space. Of equal texts the one with most code points, then the smallest id stays. A row alone with its length, or with its
    length and prefix hash, is judged where it lies. Only the others' whole texts are hashed, and only narrow rows are shuffled. A group that holds many of the rows is
    dealt over many tasks.

    Cases: null text: empty. Empty texts: equal to each other. Repeated rows (same id and text): each counts in group_size, one of them is kept. Null id: sorts last. Very long
    texts: whole. Empty table: no rows. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    shared = _shared(docs, text, scratch)
    hashed = scratch.keep(_hashed(docs, shared, doc_id, text))
    groups = scratch.keep(_groups(hashed))
    of = groups.select("_full", F.col("n").cast("long").alias("group_size"), "keep_id", "_best")
    judged = salted_join(hashed, of, ["_full"], "_tie", groups.select("_full", "n"), hashed.agg(F.count("*")).scalar())
    judged = judged.select("doc_id", "keep_id", "group_size", (F.col("_best") == F.col("_tie")).alias("kept"), *([F.col("_full").alias("text_sha256")] if digest else []))
    full = [F.sha2(without_spaces(F.col(text)), 256).alias("text_sha256")] if digest else []
    alone = _numbered(docs, text, F.col(doc_id).alias("doc_id"), *full).where(~is_in(F.col("_h"), shared) & F.expr(NUMBERED))
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *(["text_sha256"] if digest else [])).union(judged)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, one row of each group of equal texts left, with all their columns. Cases as in exact_groups; rows alike in all, null ids too, leave one."""
    scratch = Scratch(docs.sparkSession)
    shared = _shared(docs, text, scratch)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_all")
    hashed = scratch.keep(_hashed(docs, shared, doc_id, text, whole))
    best = _groups(hashed).select(F.col("_best").alias("_tie"))
    alone = _numbered(docs, text, whole).where(~is_in(F.col("_h"), shared) & F.expr(NUMBERED))
    return alone.select("_all.*").union(hashed.join(best, "_tie", "left_semi").select("_all.*"))
