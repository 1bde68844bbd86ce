"""Queries over the corpus tables, one for each operator, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import with_row_key
from chainloom.llm import exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, quality, secrets, tokens, url_filters


def vocabulary() -> str:
    """The tokenizer file of the public set that the box offers."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = with_row_key(_read(spark, sf_dir, "documents"))
    mixed = mixing.mix_report(mixing.fair_mix(docs, key=key))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary(), payload="crc32")


def quality_model(spark: SparkSession, sf_dir: str):
    labels = _read(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.fit(_read(spark, sf_dir, "documents"), labels)


#: Documents that score less are rejected.
ACCEPT = 0.3


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= ACCEPT).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"), digest=True)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_read(spark, sf_dir, "documents"), k=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_pack, op3_quality, op4_line_dedup, op5_fingerprints, op6_url_filter, op7_secrets, op8_exact_dedup, op9_near_dedup, op10_token_counts)
}

#: The rest: op2 and op10 tokenize, op3 and op6 learn, op4, op5, op7 and op9 have no SQL form that whole tables allow. Tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR || '/17'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS stop FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM c
  WINDOW b AS (ORDER BY stop, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= stop THEN level END) OVER () * w, cap)) AS target FROM l),
q AS (SELECT d.*, source_size, target, k, (sum(size) OVER (PARTITION BY d.source, k ORDER BY h, doc_id) - size + k * source_size)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS k)),
v AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - before)) AS served, (before + size) / target AS finish FROM q WHERE size > 0 AND target > 0 AND before / target < 1),
p AS (SELECT doc_id, source, k, size AS words, finish FROM v WHERE finish <= 1 UNION ALL SELECT doc_id, source, k, served, 1.0 FROM v WHERE finish > 1 AND served > 0 UNION ALL SELECT doc_id, source, k, size - served, finish FROM v WHERE finish > 1 AND size > served),
r AS (SELECT doc_id, words, (SELECT round(sum(target))::BIGINT FROM t) - (sum(words) OVER (ORDER BY finish, source IS NULL, source, doc_id, k) - words) AS room FROM p),
x AS (SELECT doc_id, sum(least(words, room))::BIGINT AS taken FROM r WHERE room > 0 GROUP BY doc_id)
SELECT d.doc_id, d.source, d.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.doc_id = x.doc_id""",
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, h AS text_sha256 FROM g""",
}
