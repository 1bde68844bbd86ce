"""Queries over all rows, and validators that see what is wrong anywhere."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainloom import registry
from chainloom.operators import index, views
from chainloom.sources.chain import Chain
from chainloom.streaming import live

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("tx_by_hash_cascade", "orders"), ("receipt_by_hash_cascade", "orders"), ("bitmap_member", "lineitem")])
def test_all_rows_are_looked_up(spark, name, table):
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert registry.QUERIES[name](spark, SMALL).count() == n


@pytest.mark.parametrize("kind", ["log:Address", "log:Topic3", "tx:To", "block:Miner", "trace:From"])
def test_bitmap_validate_sees_a_wrong_bit_of_any_filter(spark, kind):
    """One row of a value is put where none is: the count of its page stays, a bit does not."""
    f = index.all_filters(Chain(spark, SMALL))
    value, least = f.where(F.col("kind") == kind).agg(F.min(F.struct("value", "id")).alias("m")).first().m
    hit = (F.col("kind") == kind) & (F.col("value") == value) & (F.col("id") == least)
    wrong = f.withColumn("id", F.when(hit, F.lit(30_000)).otherwise(F.col("id")))
    assert {r.side: r.n for r in index.bitmap_differences(f, index.words(wrong)).collect()} == {"missing": 1, "orphaned": 1}


def test_contiguity_between_chunks(spark):
    """Gaps before blocks 1024 and 5000, the latter after chunks without a block, and an overlap within a chunk."""
    rows, at = [], 0
    for b in [*range(1020, 1030), *range(5000, 5003)]:
        at += (b in (1024, 5000)) - (b == 1027)
        rows.append((b, "tx", 3, at))
        at += 3
    rows += [(b, "log", 2, 2 * b) for b in range(1000, 3100)]
    got = index.contiguity(spark.createDataFrame(rows, "block_number long, family string, n long, first long")).collect()
    assert {r.family: r.violations for r in got} == {"tx": 3, "log": 0}


@pytest.mark.parametrize("name, table", [("block_receipts", "orders"), ("asof_id_to_block", "lineitem")])
def test_all_blocks_and_ids(spark, name, table):
    assert registry.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_receipts_that_do_not_match_the_transactions(spark):
    class Short(Chain):
        receipts = Chain(spark, SMALL).receipts.where("tx_id <> 777")

    with pytest.raises(Exception, match="number of receipts and txs mismatch"):
        views.block_receipts(Short(spark, SMALL)).collect()


def test_all_subscribers_and_addresses(spark):
    assert registry.QUERIES["subscription_fanout"](spark, SMALL).where("subscriber > 100").count() > 0
    assert registry.QUERIES["txpool_by_address"](spark, "/root/testdata/sf0.01").where("address >= 20").count() > 0


def test_fanout_keeps_heads_and_no_deliveries(spark):
    """Deliveries are the product of heads and subscribers; what the stream leaves in the shared folder is one row a head."""
    def kept():
        return {p for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("stream-*")}

    live.drain(Chain(spark, SMALL), live.heads(live.feed(live.event_stream(Chain(spark, SMALL)))))  # sets the folder
    before = kept()
    got = registry.QUERIES["subscription_fanout"](spark, SMALL)
    (new,) = kept() - before
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{new}/out").count() == 188 < got.count() == got.distinct().count()


@pytest.mark.parametrize("frontier", [0, 1, 63, 64, 65, 1000, 65536, 65600, 200_000])
def test_words_are_cut_at_the_frontier(spark, frontier):
    ids = [0, 1, 62, 63, 64, 65, 999, 1000, 65535, 65536, 65599, 65600, 131072]
    filters = spark.createDataFrame([(i, "k", "v") for i in ids], "id long, kind string, value string")
    got = index.cut_words(index.words(filters), frontier).selectExpr("page * 65536 + word * 64 AS base", "bits").collect()
    assert sorted(r.base + b for r in got for b in range(64) if r.bits >> b & 1) == [i for i in ids if i < frontier]
