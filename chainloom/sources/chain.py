"""The chain-shaped tables, derived from the raw tables by projections and one window each."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("Call", "StaticCall", "DelegateCall", "CallCode", "Create", "Create2", "SelfDestruct")


class Chain:
    """Lazily built DataFrames over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")

    @cached_property
    def blocks(self) -> DataFrame:
        df = self.raw("orders").selectExpr("o_orderkey div 10 AS block_number").distinct()
        return df.selectExpr(
            "block_number", "sha2(concat('block:', block_number), 256) AS block_hash", "CASE WHEN block_number = 0 THEN repeat('0', 64) ELSE sha2(concat('block:', block_number - 1), 256) END AS parent_hash",
            "1000 + block_number % 97 AS base_fee", "30000000L AS gas_limit", "block_number % 100 AS miner",
        )

    @cached_property
    def txs(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS tx_id", "o_orderkey div 10 AS block_number", "o_orderkey % 10 AS tx_index", "sha2(concat('tx:', o_orderkey), 256) AS tx_hash", "o_custkey AS sender",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 100 END AS to_addr", "substr(o_orderpriority, 1, 1) AS selector", "1000 + o_orderkey % 301 AS max_fee",
            "o_orderkey % 53 AS priority_fee", "o_orderstatus <> 'F' AS status",
        )

    @cached_property
    def tx_logs(self) -> DataFrame:
        """Logs with their position in the transaction; no block-wide number."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long") - 1
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("tx_id"), pos.alias("pos"), F.col("l_suppkey").alias("address"), F.col("l_returnflag").alias("topic0"), F.col("l_linestatus").alias("topic1"),
            F.col("l_partkey").cast("string").alias("topic2"), F.col("l_linenumber").cast("string").alias("topic3"), F.col("l_extendedprice").alias("data"), F.col("l_partkey").alias("part"),
            F.col("l_linenumber").alias("line"), F.expr("l_orderkey div 10").alias("block_number"), (F.col("l_orderkey") % 10).alias("tx_index"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("block_number").orderBy("tx_id", "pos")).cast("long") - 1
        return self.tx_logs.withColumn("log_index", number)

    @cached_property
    def receipts(self) -> DataFrame:
        n = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.count("*").alias("n"))
        df = self.raw("orders").select(F.col("o_orderkey").alias("tx_id")).join(n, "tx_id", "left").selectExpr("tx_id", "tx_id div 10 AS block_number", "tx_id % 10 AS tx_index", "21000 + 1000 * coalesce(n, 0) AS gas_used", "coalesce(n, 0) AS log_count")
        return df.withColumn("cumulative", F.sum("gas_used").over(Window.partitionBy("block_number").orderBy("tx_id")))

    @cached_property
    def traces(self) -> DataFrame:
        kinds = ", ".join(f"'{k}'" for k in KINDS)
        df = self.tx_logs.selectExpr("tx_id", "pos", "CASE WHEN pos = 0 THEN 0 ELSE 1 + (pos - 1) % 3 END AS depth", "CASE WHEN topic0 = 'R' THEN 2 ELSE 0 END AS status", f"array({kinds})[line % 7] AS kind", "address AS from_addr", "part", "data")
        return df.withColumn("to_addr", F.expr("CASE WHEN kind LIKE 'Create%' AND status <> 0 THEN NULL ELSE part END"))

    @cached_property
    def feed(self) -> DataFrame:
        return feed(self.raw("events"))

    @cached_property
    def pool(self) -> DataFrame:
        return pool(self.raw("events"))

    @cached_property
    def accounts(self) -> DataFrame:
        per = self.raw("orders").groupBy(F.col("o_custkey").alias("address"), F.expr("o_orderkey div 10").alias("block_number")).agg(F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents"), F.count("*").alias("n"))
        w = Window.partitionBy("address").orderBy("block_number")
        return per.select("address", "block_number", F.sum("cents").over(w).alias("balance"), F.sum("n").over(w).alias("nonce"))

    @cached_property
    def replicas(self) -> DataFrame:
        df = self.blocks.withColumn("replica", F.explode(F.array(*map(F.lit, "abc")))).where("NOT (replica = 'b' AND block_number % 37 = 5)")
        mark = lambda m, r: f"CASE WHEN replica = 'c' AND block_number % {m} = {r} THEN 'x' ELSE '' END"
        return df.selectExpr("replica", "block_number AS n", f"concat({mark(41, 7)}, block_hash) AS header", f"concat({mark(43, 8)}, 'r', block_number) AS receipts", f"concat({mark(47, 9)}, 't', block_number) AS traces", "parent_hash", "block_number % 5 + CASE WHEN replica = 'c' AND block_number % 94 = 9 THEN 1 ELSE 0 END AS outputs")


def feed(events: DataFrame) -> DataFrame:
    """Block events of a batch or a stream."""
    state = F.expr("CASE event_type WHEN 'view' THEN 'Proposed' WHEN 'click' THEN 'Voted' WHEN 'purchase' THEN 'Finalized' WHEN 'signup' THEN 'Verified' ELSE 'Gap' END")
    return events.select(F.col("event_id").alias("seq"), F.expr("event_id div 3").alias("block_number"), state.alias("commit_state"), "ts")


def pool(events: DataFrame) -> DataFrame:
    """Mempool events of a batch or a stream."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'view' THEN 'Insert' WHEN 'click' THEN 'Commit' WHEN 'error' THEN 'Drop' ELSE 'Evict' END")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("address"), F.expr("event_id div 4").alias("tx"), kind.alias("kind"), "ts")
