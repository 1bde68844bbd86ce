"""Log search: range scan, data skipping, lossy prefix index, size limits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainloom.registry import query

FROM, TO, ADDRESSES, TOPIC0, MAX_RANGE = 10, 400, (1, 2, 3, 5, 8), ("A", "R"), 1000
_in = lambda c, v: f"{c} IN ({', '.join(map(repr, v))})"
F1 = f"{_in('address', ADDRESSES)} AND {_in('topic0', TOPIC0)}"
RANGE = f"block_number BETWEEN {FROM} AND {TO}"
COLUMNS = ["block_number", "log_index", "tx_index", "address", "topic0", "topic1", "topic2", "topic3", "data"]
_sql = f"SELECT {', '.join(COLUMNS)} FROM logs WHERE {RANGE} AND {F1}"


class RangeError(ValueError):
    pass


def resolve_range(start: int, end: int, head: int, most: int = MAX_RANGE) -> tuple[int, int]:
    """The inclusive range to read: the end stops at the head; the difference, not the count, is limited."""
    end = min(end, head)
    if start > head:
        raise RangeError("block not found")
    if start > end:
        raise RangeError("invalid block range")
    if end - start > most:
        raise RangeError(f"block range is limited to {most}")
    return start, end


def scan(logs, start: int, end: int, addresses=(), topics=()):
    """Logs of a block range whose address is one of `addresses` and whose topic i is one of topics[i]; an empty set matches any."""
    df = logs.where(F.col("block_number").between(start, end))
    if addresses:
        df = df.where(F.col("address").isin(*addresses))
    for i, any_of in enumerate(topics):
        if any_of:
            df = df.where(F.col(f"topic{i}").isin(*any_of))
    return df


@query("get_logs", _sql)
def get_logs(c):
    return scan(c.logs, FROM, TO, ADDRESSES, [TOPIC0]).select(COLUMNS).orderBy("block_number", "log_index")


@query("get_logs_bloom_pruned", _sql)
def get_logs_bloom_pruned(c):
    """Blocks that hold a wanted address and a wanted topic at all are found first from two narrow columns; only their logs are numbered."""
    raw = c.raw("lineitem").where(f"l_orderkey BETWEEN {FROM * 10} AND {TO * 10 + 9}").selectExpr("l_orderkey div 10 AS block_number", "l_suppkey AS address", "l_returnflag AS topic0")
    may = raw.groupBy("block_number").agg(F.max(F.col("address").isin(*ADDRESSES)).alias("a"), F.max(F.col("topic0").isin(*TOPIC0)).alias("t")).where("a AND t").select("block_number")
    return scan(c.logs.join(may, "block_number", "left_semi"), FROM, TO, ADDRESSES, [TOPIC0]).select(COLUMNS)


@query("log_prefix_index", "SELECT tx_id, string_agg(left(lower(to_hex(address)), 2) || ':' || topic0, ',' ORDER BY pos) AS prefixes FROM logs0 GROUP BY 1")
def log_prefix_index(c):
    one = F.concat(F.substring(F.lower(F.hex("address")), 1, 2), F.lit(":"), "topic0")
    return c.tx_logs.select("tx_id", "pos", one.alias("p")).groupBy("tx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]), ",").alias("prefixes"))


def candidates(c):
    """Transactions with a wanted address in one log and a wanted topic in one, perhaps another: a superset, to be checked again."""
    logs = c.raw("lineitem").where(f"l_orderkey BETWEEN {FROM * 10} AND {TO * 10 + 9}")
    return logs.groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.max(F.col("l_suppkey").isin(*ADDRESSES)).alias("a"), F.max(F.col("l_returnflag").isin(*TOPIC0)).alias("t")).where("a AND t").select("tx_id")


@query("log_index_candidates", f"SELECT tx_id FROM logs WHERE {RANGE} GROUP BY 1 HAVING bool_or({_in('address', ADDRESSES)}) AND bool_or({_in('topic0', TOPIC0)})")
def log_index_candidates(c):
    return candidates(c)


@query("get_logs_indexed", _sql)
def get_logs_indexed(c):
    return scan(c.logs, FROM, TO, ADDRESSES, [TOPIC0]).join(candidates(c), "tx_id", "left_semi").select(COLUMNS)


@query("index_dry_run_diff", f"SELECT 'missing' AS side, block_number, count(*) AS n, string_agg(DISTINCT tx_id, ',' ORDER BY tx_id) AS txs FROM logs WHERE {RANGE} AND {F1} AND tx_id % 7 = 4 GROUP BY block_number")
def index_dry_run_diff(c):
    """Logs found with and without an index that has lost a part of the transactions, by block."""
    whole = scan(c.logs, FROM, TO, ADDRESSES, [TOPIC0])
    found = whole.join(candidates(c).where("tx_id % 7 <> 4"), "tx_id", "left_semi")
    by = ["tx_id", *COLUMNS]
    sides = [a.select(by).exceptAll(b.select(by)).withColumn("side", F.lit(side)) for a, b, side in ((whole, found, "missing"), (found, whole, "extra"))]
    txs = F.array_join(F.array_sort(F.collect_set("tx_id")).cast("array<string>"), ",")  # ten of a block at most
    return sides[0].union(sides[1]).groupBy("side", "block_number").agg(F.count("*").alias("n"), txs.alias("txs"))


_outcome = f"CASE WHEN a > head THEN 'block not found' WHEN least(b, head) < a THEN 'invalid block range' WHEN least(b, head) - a > {MAX_RANGE} THEN 'block range is limited to {MAX_RANGE}' ELSE 'ok' END"


@query("log_range_resolve", f"SELECT id, a AS from_block, CASE WHEN outcome = 'ok' THEN least(b, head) END AS to_block, outcome FROM (SELECT *, {_outcome} AS outcome FROM (SELECT o_orderkey AS id, o_orderkey // 8 AS a, o_orderkey // 8 + o_custkey * 37 % 1500 - 100 AS b, (SELECT max(block_number) FROM blocks) AS head FROM orders))")
def log_range_resolve(c):
    """Each request's range, or the error that it gets, by the rules of `resolve_range`."""
    head = c.raw("orders").agg(F.max(F.expr("o_orderkey div 10")).alias("head"))
    asked = c.raw("orders").selectExpr("o_orderkey AS id", "o_orderkey div 8 AS a", "o_orderkey div 8 + o_custkey * 37 % 1500 - 100 AS b").withColumn("head", head.scalar())
    return asked.withColumn("outcome", F.expr(_outcome)).selectExpr("id", "a AS from_block", "CASE WHEN outcome = 'ok' THEN least(b, head) END AS to_block", "outcome")


@query("log_response_limit", f"""SELECT block_number, n, total, total > 20000 AS over, blocks >= 10 AND total >= 4096 AND total * 391.0 / blocks > 2 * 20000 - 20000 * blocks / 391.0 AS stop FROM
 (SELECT block_number, n, CAST(sum(n) OVER w AS BIGINT) AS total, row_number() OVER w AS blocks FROM (SELECT block_number, CAST(sum(length(topic2) + 20) AS BIGINT) AS n FROM logs0l GROUP BY 1) WINDOW w AS (ORDER BY block_number))""".replace("logs0l", f"(SELECT tx_id // 10 AS block_number, topic2 FROM logs0 WHERE tx_id // 10 BETWEEN {FROM} AND {TO})"))
def log_response_limit(c):
    """Running response size, and whether it is already certain to exceed the limit; the window sees one row per block of a limited range."""
    per = c.raw("lineitem").where(f"l_orderkey BETWEEN {FROM * 10} AND {TO * 10 + 9}").groupBy(F.expr("l_orderkey div 10").alias("block_number")).agg(F.sum(F.length(F.col("l_partkey").cast("string")) + 20).alias("n"))
    w = Window.orderBy("block_number")
    df = per.withColumn("total", F.sum("n").over(w)).withColumn("blocks", F.row_number().over(w))
    return df.selectExpr("block_number", "n", "total", "total > 20000 AS over", "blocks >= 10 AND total >= 4096 AND total * 391.0 / blocks > 2 * 20000 - 20000 * blocks / 391.0 AS stop")
