"""Fees: history with gas-weighted rewards, fee rules, gas estimates and budgets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.registry import query

PERCENTILES = (10.0, 50.0, 90.0)


def rewards(txs: DataFrame, percentiles=PERCENTILES) -> DataFrame:
    """block_number, p, reward. txs: block_number, tx_index, gas, tip, block_gas. Transactions in order of (tip, tx_index); the reward is the tip of the one at the number of
    transactions with less gas before them than round(block_gas * p / 100), the last at most. A block's transactions are a bounded group."""
    w = Window.partitionBy("block_number").orderBy("tip", "tx_index")
    df = txs.withColumn("before", F.coalesce(F.sum("gas").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("block_number")))
    df = df.withColumn("p", F.explode(F.array(*map(F.lit, percentiles))))
    at = F.least(F.count_if(F.col("before") < F.round(F.col("block_gas") * F.col("p") / 100)), F.first("n") - 1)
    tips = F.transform(F.array_sort(F.collect_list(F.struct("i", "tip"))), lambda x: x["tip"])
    return df.groupBy("block_number", "p").agg(F.get(tips, at.cast("int")).alias("reward"))


def _block_txs(c):
    r = c.receipts.select("tx_id", "gas_used")
    df = c.txs.join(r, "tx_id").join(c.blocks.select("block_number", "base_fee"), "block_number")
    df = df.selectExpr("block_number", "tx_index", "gas_used AS gas", "least(priority_fee, max_fee - base_fee) AS tip")
    return df.withColumn("block_gas", F.sum("gas").over(Window.partitionBy("block_number")))


_rw = """bt AS (SELECT block_number, tx_index, gas_used AS gas, least(priority_fee, max_fee - base_fee) AS tip FROM txs JOIN receipts USING (tx_id, block_number, tx_index) JOIN blocks USING (block_number)),
ord AS (SELECT *, coalesce(sum(gas) OVER (PARTITION BY block_number ORDER BY tip, tx_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, row_number() OVER (PARTITION BY block_number ORDER BY tip, tx_index) - 1 AS i,
 sum(gas) OVER (PARTITION BY block_number) AS bg, count(*) OVER (PARTITION BY block_number) AS n FROM bt),
idx AS (SELECT block_number, p, least(count(*) FILTER (bef < round(bg * p / 100)), max(n) - 1) AS k FROM ord, (VALUES (10.0::DOUBLE), (50.0), (90.0)) v(p) GROUP BY 1, 2),
rw AS (SELECT idx.block_number, p, tip AS reward FROM idx JOIN ord ON ord.block_number = idx.block_number AND ord.i = idx.k)"""


@query("fee_rewards", f", {_rw} SELECT * FROM rw")
def fee_rewards(c):
    return rewards(_block_txs(c))


MAX_BLOCKS, MAX_PERCENTILES = 1024, 100


def check_history(count: int, percentiles) -> None:
    """Refuses what a fee history may not be asked for."""
    if not 0 <= count <= MAX_BLOCKS:
        raise ValueError(f"block count must be between 1 and {MAX_BLOCKS}")
    if len(percentiles) > MAX_PERCENTILES:
        raise ValueError(f"number of reward percentiles must be less than or equal to {MAX_PERCENTILES}")
    if any(not 0 <= p <= 100 for p in percentiles):
        raise ValueError("reward percentiles must be between 0-100")
    if list(percentiles) != sorted(percentiles):
        raise ValueError("reward percentiles must be sorted")


def history(blocks: DataFrame, txs: DataFrame, newest, count: int, percentiles=PERCENTILES) -> DataFrame:
    """block_number, base_fee, gas_used_ratio, rewards (comma-joined, by percentile) of the `count` blocks up to `newest`, a column; then one row more with the next block's base fee,
    or the last one's where there is none yet."""
    check_history(count, percentiles)
    within = (F.col("block_number") <= newest) & (F.col("block_number") > newest - count)
    blocks, some = blocks.select("block_number", "base_fee", "gas_limit"), txs.where(within)
    gas = some.groupBy("block_number").agg(F.sum("gas").alias("gas"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "reward"))), lambda x: x["reward"]), ",")
    tips = rewards(some, percentiles).groupBy("block_number").agg(listed.alias("rewards"))
    out = blocks.where(within).join(gas, "block_number", "left").join(tips, "block_number", "left")
    out = out.select("block_number", "base_fee", (F.coalesce("gas", F.lit(0)) / F.col("gas_limit")).alias("gas_used_ratio"), "rewards")
    last = blocks.where((F.col("block_number") == newest) | (F.col("block_number") == newest + 1)).agg(F.max_by("base_fee", "block_number").alias("base_fee"))
    return out.union(last.select((newest + 1).alias("block_number"), "base_fee", F.lit(None).cast("double"), F.lit(None).cast("string"))) if count else out.limit(0)


@query("fee_history", f""", {_rw}, g AS (SELECT block_number, CAST(sum(gas) AS BIGINT) AS gas FROM bt GROUP BY 1), h AS (SELECT max(block_number) AS head FROM blocks)
 SELECT block_number, base_fee, gas / 30000000.0::DOUBLE AS gas_used_ratio, string_agg(reward, ',' ORDER BY p) AS rewards FROM blocks JOIN g USING (block_number) JOIN rw USING (block_number), h WHERE block_number > head - {MAX_BLOCKS} GROUP BY ALL
 UNION ALL SELECT head + 1, base_fee, NULL, NULL FROM blocks, h WHERE block_number = head""")
def fee_history(c):
    """The longest history that may be asked for, up to the newest block."""
    head = c.raw("orders").agg(F.max(F.expr("o_orderkey div 10")).alias("head")).scalar()
    return history(c.blocks, _block_txs(c), head, MAX_BLOCKS)


@query("gas_price", "SELECT arg_max(base_fee, block_number) + 2000000000 AS price FROM blocks")
def gas_price(c):
    return c.blocks.agg((F.max_by("base_fee", "block_number") + 2_000_000_000).alias("price"))


@query("fee_fill", "SELECT tx_id, CASE WHEN tx_id % 4 = 0 THEN greatest(max_fee, base_fee) WHEN max_fee < base_fee THEN NULL ELSE least(max_fee, base_fee + priority_fee) END AS price, CASE WHEN tx_id % 4 <> 0 AND max_fee < base_fee THEN 'max fee below base fee' WHEN max_fee < priority_fee THEN 'max fee below tip' END AS error FROM txs JOIN blocks USING (block_number)")
def fee_fill(c):
    """Every fourth transaction counts as legacy."""
    return c.txs.join(c.blocks, "block_number").selectExpr("tx_id", "CASE WHEN tx_id % 4 = 0 THEN greatest(max_fee, base_fee) WHEN max_fee < base_fee THEN NULL ELSE least(max_fee, base_fee + priority_fee) END AS price", "CASE WHEN tx_id % 4 <> 0 AND max_fee < base_fee THEN 'max fee below base fee' WHEN max_fee < priority_fee THEN 'max fee below tip' END AS error")


@query("gas_allowance", "SELECT c_custkey AS address, CASE WHEN c_acctbal <= 0 THEN NULL ELSE least(CAST(floor(c_acctbal * 100) AS BIGINT) // 3, 30000) END AS gas FROM customer")
def gas_allowance(c):
    return c.raw("customer").selectExpr("c_custkey AS address", "CASE WHEN c_acctbal <= 0 THEN NULL ELSE least(CAST(floor(c_acctbal * 100) AS BIGINT) div 3, 30000) END AS gas")


@query("gas_math", "SELECT tx_id, gas_used * 64 // 63 AS grossed, gas_used - gas_used // 64 AS passed, round(gas_used / 30000000.0::DOUBLE, 6) AS ratio, least(gas_used + 9223372036854000000, 9223372036854775807) AS capped FROM receipts")
def gas_math(c):
    return c.receipts.selectExpr("tx_id", "gas_used * 64 div 63 AS grossed", "gas_used - gas_used div 64 AS passed", "round(gas_used / 30000000.0D, 6) AS ratio", "coalesce(try_add(gas_used, 9223372036854000000), 9223372036854775807) AS capped")


@query("gas_estimate_bisect", """, half(gas, lo, hi) AS (SELECT DISTINCT gas_used, CAST(20999 AS BIGINT), CAST(30000000 AS BIGINT) FROM receipts UNION ALL
 SELECT gas, CASE WHEN (lo + hi) // 2 >= gas THEN lo ELSE (lo + hi) // 2 END, CASE WHEN (lo + hi) // 2 >= gas THEN (lo + hi) // 2 ELSE hi END FROM half WHERE (hi - lo) / hi >= 0.015::DOUBLE)
 SELECT tx_id, hi AS estimate FROM receipts JOIN half ON gas = gas_used WHERE (hi - lo) / hi < 0.015::DOUBLE""")
def gas_estimate_bisect(c):
    """The limit found by halving until the span is under 1.5 % of it. One fold per transaction, no iteration of jobs."""
    step = "aggregate(sequence(1, 60), named_struct('lo', 20999L, 'hi', 30000000L), (s, i) -> if((s.hi - s.lo) / s.hi < 0.015D, s, if((s.hi + s.lo) div 2 >= gas_used, named_struct('lo', s.lo, 'hi', (s.hi + s.lo) div 2), named_struct('lo', (s.hi + s.lo) div 2, 'hi', s.hi))))"
    return c.receipts.withColumn("s", F.expr(step)).selectExpr("tx_id", "s.hi AS estimate")


@query("access_list_merge", "SELECT address, string_agg(part, ',' ORDER BY part) AS keys FROM (SELECT DISTINCT address, part FROM logs0) GROUP BY 1")
def access_list_merge(c):
    return c.raw("lineitem").selectExpr("l_suppkey AS address", "l_partkey AS part").distinct().groupBy("address").agg(F.array_join(F.array_sort(F.collect_list("part")).cast("array<string>"), ",").alias("keys"))


@query("simulate_gas_budget", "SELECT block_number, tx_index, cumulative > 250000 AS over, count(*) OVER (PARTITION BY block_number) <= 2000 AS calls_ok FROM receipts")
def simulate_gas_budget(c):
    return c.receipts.select("block_number", "tx_index", (F.col("cumulative") > 250000).alias("over"), (F.count("*").over(Window.partitionBy("block_number")) <= 2000).alias("calls_ok"))


@query("transfer_affordable", "SELECT tx_id, balance >= 5000000 AS affordable FROM txs JOIN accounts a ON a.address = sender AND a.block_number = txs.block_number")
def transfer_affordable(c):
    a = c.accounts.select(F.col("address").alias("sender"), "block_number", "balance")
    return c.txs.join(a, ["sender", "block_number"]).select("tx_id", (F.col("balance") >= 5_000_000).alias("affordable"))


@query("tx_validate", "SELECT tx_id, CASE WHEN to_addr IS NULL AND selector = '1' THEN 'undecodable' WHEN tx_id % 11 = 0 THEN 'not replay protected' WHEN tx_id % 13 = 0 THEN 'wrong chain id' END AS reason FROM txs")
def tx_validate(c):
    return c.txs.selectExpr("tx_id", "CASE WHEN to_addr IS NULL AND selector = '1' THEN 'undecodable' WHEN tx_id % 11 = 0 THEN 'not replay protected' WHEN tx_id % 13 = 0 THEN 'wrong chain id' END AS reason")


@query("call_stats", "SELECT event_type, count(*) AS total, max(value) AS oldest FROM events GROUP BY 1")
def call_stats(c):
    return c.raw("events").groupBy("event_type").agg(F.count("*").alias("total"), F.max("value").alias("oldest"))
