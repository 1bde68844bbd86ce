"""Views of blocks, transactions, receipts and logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainloom.operators.lookup import _case, block_cascade
from chainloom.registry import query

_before = lambda part, *order: Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
EFFECTIVE = "least(max_fee, base_fee + priority_fee)"


@query("tx_view", f"SELECT tx_hash, block_hash, block_number, tx_index, sender, to_addr, {EFFECTIVE} AS price FROM txs JOIN blocks USING (block_number)")
def tx_view(c):
    return c.txs.join(c.blocks, "block_number").selectExpr("tx_hash", "block_hash", "block_number", "tx_index", "sender", "to_addr", f"{EFFECTIVE} AS price")


@query("receipt_gas_used", "SELECT tx_id, cumulative - lag(cumulative, 1, 0) OVER (PARTITION BY block_number ORDER BY tx_index) AS gas FROM receipts")
def receipt_gas_used(c):
    return c.receipts.select("tx_id", (F.col("cumulative") - F.lag("cumulative", 1, 0).over(Window.partitionBy("block_number").orderBy("tx_index"))).alias("gas"))


@query("receipt_view", f"SELECT tx_hash, tx_index, sender, to_addr, CASE WHEN to_addr IS NULL THEN sha256('create:' || tx_id) END AS contract_address, gas_used, {EFFECTIVE} AS price, status FROM txs JOIN receipts USING (tx_id, block_number, tx_index) JOIN blocks USING (block_number)")
def receipt_view(c):
    df = c.txs.join(c.receipts.drop("block_number", "tx_index"), "tx_id").join(c.blocks, "block_number")
    return df.selectExpr("tx_hash", "tx_index", "sender", "to_addr", "CASE WHEN to_addr IS NULL THEN sha2(concat('create:', tx_id), 256) END AS contract_address", "gas_used", f"{EFFECTIVE} AS price", "status")


@query("starting_log_index", "SELECT tx_id, CAST(coalesce(sum(log_count) OVER (PARTITION BY block_number ORDER BY tx_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM receipts")
def starting_log_index(c):
    return c.receipts.select("tx_id", F.coalesce(F.sum("log_count").over(_before("block_number", "tx_index")), F.lit(0)).alias("first"))


@query("log_view", "SELECT tx_id, pos, s.first + pos AS log_index, address, topic0 FROM logs0 JOIN (SELECT tx_id, CAST(coalesce(sum(log_count) OVER (PARTITION BY block_number ORDER BY tx_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM receipts) s USING (tx_id)")
def log_view(c):
    return c.tx_logs.join(starting_log_index(c), "tx_id").select("tx_id", "pos", (F.col("first") + F.col("pos")).alias("log_index"), "address", "topic0")


@query("log_index_consistency", "SELECT block_number, count(*) AS n_logs, max(log_index) AS last, max(log_index) + 1 = count(*) AS consistent FROM logs GROUP BY 1")
def log_index_consistency(c):
    return c.logs.groupBy("block_number").agg(F.count("*").alias("n_logs"), F.max("log_index").alias("last"), (F.max("log_index") + 1 == F.count("*")).alias("consistent"))


@query("block_full", "SELECT block_number, string_agg(tx_index || ':' || tx_hash || ':' || sender, ',' ORDER BY tx_index) AS body FROM txs GROUP BY 1")
def block_full(c):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "tx_hash", "sender"))), lambda x: F.concat_ws(":", x["tx_index"], x["tx_hash"], x["sender"])), ",")
    return c.txs.groupBy("block_number").agg(body.alias("body"))


@query("block_hashes", "SELECT block_number, string_agg(tx_hash, ',' ORDER BY tx_index) AS hashes FROM txs GROUP BY 1")
def block_hashes(c):
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "tx_hash"))), lambda x: x["tx_hash"]), ",")
    return c.txs.groupBy("block_number").agg(hashes.alias("hashes"))


@query("block_tx_count", "SELECT block_number, '0x' || lower(to_hex(count(*))) AS n FROM txs GROUP BY 1")
def block_tx_count(c):
    return c.txs.groupBy("block_number").agg(F.concat(F.lit("0x"), F.lower(F.hex(F.count("*")))).alias("n"))


@query("block_size", "SELECT block_number, CAST(sum(CASE WHEN n < 56 THEN 1 + n WHEN n < 256 THEN 2 + n ELSE 3 + n END) AS BIGINT) AS size FROM (SELECT block_number, length(tx_hash) + length(CAST(sender AS VARCHAR)) AS n FROM txs) GROUP BY 1")
def block_size(c):
    n = F.length("tx_hash") + F.length(F.col("sender").cast("string"))
    return c.txs.select("block_number", n.alias("n")).groupBy("block_number").agg(F.sum(F.expr("CASE WHEN n < 56 THEN 1 + n WHEN n < 256 THEN 2 + n ELSE 3 + n END")).alias("size"))


@query("log_json_len", """SELECT tx_id, pos, length('{"address":' || address || ',"topics":["' || topic0 || '","' || topic1 || '","' || topic2 || '","' || topic3 || '"]}') AS n FROM logs0""")
def log_json_len(c):
    return c.tx_logs.select("tx_id", "pos", F.length(F.to_json(F.struct("address", F.array("topic0", "topic1", "topic2", "topic3").alias("topics")))).cast("long").alias("n"))


@query("raw_hex", "SELECT tx_id, lower(hex(tx_id || ':' || sender)) AS raw FROM txs")
def raw_hex(c):
    return c.txs.select("tx_id", F.lower(F.hex(F.concat_ws(":", "tx_id", "sender"))).alias("raw"))


@query("resolve_tags", "SELECT max(block_number) FILTER (commit_state = 'Proposed') AS latest, max(block_number) FILTER (commit_state = 'Voted') AS safe, max(block_number) FILTER (commit_state = 'Finalized') AS finalized, CAST(0 AS BIGINT) AS earliest FROM feed")
def resolve_tags(c):
    top = lambda s: F.max(F.when(F.col("commit_state") == s, F.col("block_number")))
    return c.feed.agg(top("Proposed").alias("latest"), top("Voted").alias("safe"), top("Finalized").alias("finalized"), F.lit(0).cast("long").alias("earliest"))


@query("commit_heads", "SELECT commit_state, max(block_number) AS head FROM feed GROUP BY 1")
def commit_heads(c):
    return c.feed.groupBy("commit_state").agg(F.max("block_number").alias("head"))


@query("latest_block", "SELECT max(block_number) AS latest FROM blocks")
def latest_block(c):
    return c.raw("orders").agg(F.max(F.expr("o_orderkey div 10")).alias("latest"))


@query("block_receipts", f"SELECT block_number, tx_index, tx_hash, gas_used, cumulative, {_case} AS source FROM txs JOIN receipts USING (tx_id, block_number, tx_index)")
def block_receipts(c):
    """The receipts of every block, by position, from the first source that has the block. A block whose transactions and receipts differ in number is an error, as in the reference."""
    at = ["block_number", "tx_index"]
    t, r = c.txs.select(*at, "tx_hash"), c.receipts.select(*at, "gas_used", "cumulative")
    both = t.join(r, at, "full").join(block_cascade(c), "block_number", "left")
    gas = F.when(F.col("tx_hash").isNull() | F.col("gas_used").isNull(), F.raise_error(F.lit("number of receipts and txs mismatch"))).otherwise(F.col("gas_used"))
    return both.select(*at, "tx_hash", gas.alias("gas_used"), "cumulative", "source")


@query("block_bundle", "SELECT t.block_number, t.tx_index, t.tx_hash, r.gas_used, count(f.pos) AS frames FROM txs t JOIN receipts r USING (tx_id) LEFT JOIN traces f USING (tx_id) GROUP BY ALL")
def block_bundle(c):
    frames = c.raw("lineitem").groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.count("*").alias("frames"))
    return c.txs.join(c.receipts.select("tx_id", "gas_used"), "tx_id").join(frames, "tx_id", "left").select("block_number", "tx_index", "tx_hash", "gas_used", F.coalesce("frames", F.lit(0)).alias("frames"))
