"""Write semantics as set operations, and the sinks themselves."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.registry import query


def keep_latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key, by partial aggregation rather than a window."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[x for x in df.columns if x not in key]), order).alias("_v")).select(*key, "_v.*")


def no_clobber(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


@query("upsert_keep_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def upsert_keep_latest(c):
    return keep_latest(c.raw("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def _halves(c):
    t = c.raw("orders").selectExpr("o_orderkey AS k", "o_orderstatus AS v")
    return t.where("k % 3 <> 0"), t.where("k % 2 = 0").withColumn("v", F.lit("new"))


_h = "old AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, 'new' AS v FROM orders WHERE o_orderkey % 2 = 0)"


@query("put_noclobber", f", {_h} FROM old UNION ALL (FROM new WHERE k NOT IN (SELECT k FROM old))")
def put_noclobber(c):
    return no_clobber(*_halves(c), ["k"])


@query("put_overwrite", f", {_h} FROM new UNION ALL (FROM old WHERE k NOT IN (SELECT k FROM new))")
def put_overwrite(c):
    old, new = _halves(c)
    return no_clobber(new, old, ["k"])


@query("migrate_merge_keep_existing", f", {_h} SELECT count(*) AS merged, count(*) FILTER (v = 'new') AS copied FROM (FROM old UNION ALL (FROM new WHERE k NOT IN (SELECT k FROM old)))")
def migrate_merge_keep_existing(c):
    return put_noclobber(c).agg(F.count("*").alias("merged"), F.count_if(F.expr("v = 'new'")).alias("copied"))


@query("keyset_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 200 ORDER BY o_orderkey LIMIT 50")
def keyset_page(c):
    return c.raw("orders").where("o_orderkey > 200").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(50)


@query("chunk_reassemble", "SELECT p_partkey, p_name AS value FROM part")
def chunk_reassemble(c):
    """Values cut into parts of five characters and put together again in order."""
    cut = F.expr("transform(sequence(0, greatest(length(p_name) - 1, 0) div 5), i -> substr(p_name, CAST(i * 5 + 1 AS INT), 5))")
    parts = c.raw("part").select("p_partkey", F.posexplode(cut).alias("i", "c"))
    return parts.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "").alias("value"))


@query("pk_violation_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violation_check(c):
    return c.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


_received = "received AS (SELECT block_number, block_hash, CASE WHEN block_number % 59 = 11 THEN 'x' || parent_hash ELSE parent_hash END AS parent_hash FROM blocks WHERE block_number % 61 <> 7)"


@query("chain_continuity", f", {_received} SELECT b.block_number, CASE WHEN p.block_number IS NULL THEN 'gap' ELSE 'parent hash' END AS fault FROM received b LEFT JOIN received p ON p.block_number = b.block_number - 1 WHERE b.block_number > (SELECT min(block_number) FROM received) AND (p.block_number IS NULL OR p.block_hash <> b.parent_hash)")
def chain_continuity(c):
    """What an ordered append refuses, over a chain with lost blocks and wrong parents. A join on the number before replaces one window over all blocks."""
    got = c.blocks.where("block_number % 61 <> 7").selectExpr("block_number", "block_hash", "CASE WHEN block_number % 59 = 11 THEN concat('x', parent_hash) ELSE parent_hash END AS parent_hash")
    return continuity(got)


def continuity(blocks: DataFrame) -> DataFrame:
    """block_number, fault of every block but the first whose predecessor is lacking or has another hash than its parent hash."""
    prev = blocks.selectExpr("block_number + 1 AS block_number", "block_hash AS before")
    least = blocks.agg(F.min("block_number")).scalar()
    faults = blocks.join(prev, "block_number", "left").where(F.col("block_number") > least).where("before IS NULL OR before <> parent_hash")
    return faults.selectExpr("block_number", "CASE WHEN before IS NULL THEN 'gap' ELSE 'parent hash' END AS fault")


@query("contiguous_frontier", "SELECT coalesce(min(event_id) FILTER (event_type = 'error') - 1, max(event_id)) AS frontier FROM events")
def contiguous_frontier(c):
    return c.raw("events").agg(F.coalesce(F.min(F.when(F.col("event_type") == "error", F.col("event_id"))) - 1, F.max("event_id")).alias("frontier"))


@query("tx_index_repr", "SELECT tx_id, CASE WHEN log_count > 4 THEN 'reference' ELSE 'inline' END AS repr FROM receipts")
def tx_index_repr(c):
    return c.receipts.select("tx_id", F.when(F.col("log_count") > 4, "reference").otherwise("inline").alias("repr"))


@query("incremental_file_set", "SELECT page_id, url FROM pages WHERE page_id % 4 <> 0 AND NOT starts_with(url, 'http://')")
def incremental_file_set(c):
    p = c.raw("pages").select("page_id", "url")
    known = p.where("page_id % 4 = 0").select("page_id")
    return p.where(~F.col("url").startswith("http://")).join(known, "page_id", "left_anti")


@query("batch_take_while", "SELECT conv_id, turn, size FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS size FROM conversations) WHERE size <= 500")
def batch_take_while(c):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.raw("conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("size")).where("size <= 500")


THRESHOLD, RECOVERY = 2, "1 day"


class Breaker:
    """Closed until `threshold` failures in a row; open until `recovery` has passed, calls going elsewhere meanwhile; then half-open for one call, which closes or opens it again."""

    def __init__(self, threshold: int, recovery):
        self.threshold, self.recovery, self.state, self.failures, self.opened = threshold, recovery, "closed", 0, None

    def call(self, at, bad: bool) -> str:
        """The state after a call at a time, whose outcome counts if the breaker lets it through."""
        if self.state == "open":
            if at - self.opened < self.recovery:
                return "open"
            self.state = "half-open"
        if not bad:
            self.state, self.failures, self.opened = "closed", 0, None
        else:
            self.failures += 1
            if self.state == "half-open" or self.failures >= self.threshold:
                self.state, self.opened = "open", at
        return self.state


def breaker_states(calls: DataFrame, threshold: int = THRESHOLD, recovery: str = RECOVERY) -> DataFrame:
    """source, event_id, state after each call. calls: source, ts, event_id, bad. A source's calls are read in order as a stream, so that none are gathered."""

    def states(batches):
        import pandas as pd
        import pyarrow as pa

        source, breaker = None, None
        for batch in batches:
            out = []
            for s, at, bad in zip(*(batch.column(k).to_pylist() for k in ("source", "ts", "bad"))):
                if breaker is None or s != source:
                    source, breaker = s, Breaker(threshold, pd.Timedelta(recovery))
                out.append(breaker.call(at, bad))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("event_id"), pa.array(out, pa.string())], names=["source", "event_id", "state"])

    rows = calls.select("source", "ts", "event_id", "bad").repartition("source").sortWithinPartitions("source", "ts", "event_id")
    return rows.mapInArrow(states, "source long, event_id long, state string")


@query("circuit_breaker_states", f""", ev AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 st(user_id, r, event_id, state, failures, opened) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 'closed', 0, CAST(NULL AS TIMESTAMP) FROM (SELECT DISTINCT user_id FROM ev) UNION ALL
 SELECT user_id, ev.r, ev.event_id, CASE WHEN shut THEN 'open' WHEN NOT bad THEN 'closed' WHEN state = 'open' OR failures + 1 >= {THRESHOLD} THEN 'open' ELSE 'closed' END,
 CASE WHEN shut THEN failures WHEN bad THEN failures + 1 ELSE 0 END, CASE WHEN shut THEN opened WHEN bad AND (state = 'open' OR failures + 1 >= {THRESHOLD}) THEN ts END
 FROM (SELECT ev.*, state, failures, opened, state = 'open' AND ts - opened < INTERVAL {RECOVERY} AS shut FROM st JOIN ev ON ev.user_id = st.user_id AND ev.r = st.r + 1) ev)
 SELECT user_id AS source, event_id, state FROM st WHERE r > 0""")
def circuit_breaker_states(c):
    return breaker_states(c.raw("events").select(F.col("user_id").alias("source"), "ts", "event_id", (F.col("event_type") == "error").alias("bad")))


def write_archive(df: DataFrame, path: str, block: str = "block_number", span: int = 1_000_000) -> None:
    """Blocks in folders of a million each, Parquet with zstd."""
    df.withColumn("span", F.expr(f"{block} div {span}")).repartition("span").sortWithinPartitions(block).write.mode("overwrite").option("compression", "zstd").partitionBy("span").parquet(path)
