"""The live loops: block events, subscriptions, the mempool, tailing into an index; each as a stream, or as the batch that the stream converges to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.registry import query
from chainloom.sources.chain import Chain, feed, pool


def event_stream(c: Chain, files: int = 16) -> DataFrame:
    """The events as a file stream; `files` bounds a trigger."""
    schema = c.raw("events").schema
    return c.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{c.dir}/events.parquet*")


def drain(c: Chain, stream: DataFrame, mode: str = "append", numbered: bool = False) -> DataFrame:
    """Runs a stream over all that is there, each batch into a table of its own under the shared folder: a batch that is run again replaces itself. numbered: `batch` is the number of
    the batch that wrote a row."""
    sc = c.spark.sparkContext
    if not sc.getCheckpointDir():
        folder = c.spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # one process may do with a folder of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chainloom-"))
    root = f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch", F.lit(number)) if numbered else batch
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return c.spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out").select(*stream.columns)


def drain_updates(c: Chain, stream: DataFrame, key: str) -> DataFrame:
    """Runs a streaming aggregate over all that is there: each batch writes the keys that it changed, and a key's last state counts."""
    numbered = drain(c, stream.withColumn("batch", F.lit(0)), "update", numbered=True)
    state = F.struct(*[c for c in stream.columns if c != key])
    return numbered.groupBy(key).agg(F.max_by(state, "batch").alias("_v")).select(key, "_v.*").select(*stream.columns)


@query("stream_block_events", "SELECT seq, block_number, commit_state FROM feed")
def stream_block_events(c):
    return drain(c, feed(event_stream(c)).select("seq", "block_number", "commit_state"))


@query("stream_index_foreachbatch", "SELECT block_number, count(*) AS n, max(seq) AS last FROM feed GROUP BY 1")
def stream_index_foreachbatch(c):
    """Tailing: each batch writes its own partial index; partial counts and frontiers merge on read, so a repeated batch changes nothing."""
    return drain(c, feed(event_stream(c)).select("block_number", "seq")).groupBy("block_number").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(c):
    e = event_stream(c).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drain(c, g.select("w.start", "event_type", "n"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_session", "SELECT user_id, count(DISTINCT g) AS sessions FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1")
def stream_session(c):
    e = c.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("stream_gap_detect", "SELECT seq FROM feed WHERE commit_state = 'Gap'")
def stream_gap_detect(c):
    return drain(c, feed(event_stream(c)).where("commit_state = 'Gap'").select("seq"))


@query("buffer_latest_block", "SELECT block_number, max(seq) AS seq, arg_max(commit_state, seq) AS state FROM feed WHERE commit_state IN ('Proposed', 'Voted', 'Finalized') GROUP BY 1")
def buffer_latest_block(c):
    """A block proposed again replaces the earlier one: the state is kept per block, and each batch gives what it changed."""
    f = feed(event_stream(c)).where("commit_state IN ('Proposed', 'Voted', 'Finalized')")
    return drain_updates(c, f.groupBy("block_number").agg(F.max("seq").alias("seq"), F.max_by("commit_state", "seq").alias("state")), "block_number")


@query("ring_buffer", "SELECT block_number, seq FROM (SELECT block_number, max(seq) AS seq FROM feed GROUP BY 1) ORDER BY seq DESC LIMIT 1024")
def ring_buffer(c):
    return c.feed.groupBy("block_number").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(1024)


@query("ws_new_heads", "SELECT seq, block_number FROM feed WHERE commit_state = 'Proposed'")
def ws_new_heads(c):
    return drain(c, heads(feed(event_stream(c))))


def heads(events: DataFrame) -> DataFrame:
    return events.where("commit_state = 'Proposed'").select("seq", "block_number")


@query("ws_logs", "SELECT f.seq, l.block_number, l.log_index FROM feed f JOIN logs l USING (block_number) WHERE commit_state = 'Proposed' AND address < 4")
def ws_logs(c):
    """Each new head joined with the logs of its block as it comes: a stream against a table."""
    return drain(c, heads(feed(event_stream(c))).join(c.logs.where("address < 4"), "block_number").select("seq", "block_number", "log_index"))


@query("ws_all_states_logs", "SELECT f.seq, f.commit_state, l.block_number, l.log_index FROM feed f JOIN logs l USING (block_number) WHERE commit_state <> 'Gap' AND address < 3")
def ws_all_states_logs(c):
    return drain(c, feed(event_stream(c)).where("commit_state <> 'Gap'").join(c.logs.where("address < 3"), "block_number").select("seq", "commit_state", "block_number", "log_index"))


@query("subscription_fanout", "SELECT c_custkey AS subscriber, seq FROM feed JOIN customer ON c_custkey % 50 = block_number % 50 WHERE commit_state = 'Proposed'")
def subscription_fanout(c):
    """The stream keeps each head once; heads meet their subscribers as the result is read. Kept deliveries would fill the shared folder with the product of the two tables, which the
    result is."""
    return deliveries(drain(c, heads(feed(event_stream(c)))), c.raw("customer").select(F.col("c_custkey").alias("subscriber"))).select("subscriber", "seq")


#: A topic has many heads and many subscribers: its heads are dealt over so many tasks, each of which reads all its subscribers.
DEALS = 16


def deliveries(new: DataFrame, subs: DataFrame) -> DataFrame:
    """Each head with every subscriber of its topic, of which there are 50. By merge, which neither broadcasts the subscribers nor holds a task's whole output; a task holds one deal of
    a topic's heads and repeats it for each subscriber, which columns of a file hold in little room."""
    new = new.select("seq", F.col("block_number") % 50, F.pmod(F.xxhash64("seq"), F.lit(DEALS))).toDF("seq", "topic", "deal")
    subs = subs.select("subscriber", F.col("subscriber") % 50, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))).toDF("subscriber", "topic", "deal")
    return subs.hint("merge").join(new.hint("merge"), ["topic", "deal"])


_status = "CASE arg_max(kind, seq) WHEN 'Insert' THEN 'Tracked' WHEN 'Commit' THEN 'Committed' WHEN 'Drop' THEN 'Dropped' ELSE 'Evicted' END"


@query("txpool_status", f"SELECT tx, {_status} AS status FROM pool GROUP BY 1")
def txpool_status(c):
    """The last event of a transaction decides. The state is one row per transaction, so a hot one is no long list."""
    return drain_updates(c, status_of(pool(event_stream(c))), "tx")


def status_of(events: DataFrame) -> DataFrame:
    return events.groupBy("tx").agg(F.expr(_status.replace("arg_max", "max_by")).alias("status"))


@query("txpool_by_address", f"SELECT DISTINCT address, tx, status FROM pool JOIN (SELECT tx, {_status} AS status FROM pool GROUP BY 1) USING (tx)")
def txpool_by_address(c):
    return c.pool.select("address", "tx").distinct().join(status_of(c.pool), "tx").select("address", "tx", "status")


@query("txpool_snapshot", "SELECT coalesce(k.tx, s.tx) AS tx, CASE WHEN k.tx IS NULL THEN 'inserted' WHEN s.tx IS NULL THEN 'removed' ELSE 'tracked' END AS change FROM (SELECT DISTINCT tx FROM pool WHERE tx % 3 <> 0) k FULL JOIN (SELECT DISTINCT tx FROM pool WHERE tx % 2 = 0) s ON k.tx = s.tx")
def txpool_snapshot(c):
    t = c.pool.select("tx").distinct()
    known, snap = t.where("tx % 3 <> 0").withColumn("k", F.lit(1)), t.where("tx % 2 = 0").withColumn("s", F.lit(1))
    return known.join(snap, "tx", "full").selectExpr("tx", "CASE WHEN k IS NULL THEN 'inserted' WHEN s IS NULL THEN 'removed' ELSE 'tracked' END AS change")


@query("txpool_ttl", "SELECT tx, min(ts) AS first_seen FROM pool GROUP BY 1 HAVING min(ts) > (SELECT max(ts) - INTERVAL 15 MINUTE FROM events)")
def txpool_ttl(c):
    now = c.raw("events").agg((F.max("ts") - F.expr("INTERVAL 15 MINUTES")).alias("x"))
    return c.pool.groupBy("tx").agg(F.min("ts").alias("first_seen")).where(F.col("first_seen") > now.scalar())


@query("txpool_dedup", "SELECT tx, min(seq) AS seq FROM pool WHERE kind = 'Insert' GROUP BY 1")
def txpool_dedup(c):
    return drain_updates(c, pool(event_stream(c)).where("kind = 'Insert'").groupBy("tx").agg(F.min("seq").alias("seq")), "tx")


@query("tx_sync_interval_join", "SELECT tx, min(f.seq) AS included FROM pool p JOIN feed f ON f.block_number = p.tx AND f.ts BETWEEN p.ts - INTERVAL 12 HOUR AND p.ts + INTERVAL 12 HOUR WHERE p.kind = 'Insert' AND commit_state = 'Proposed' GROUP BY 1")
def tx_sync_interval_join(c):
    p = c.pool.where("kind = 'Insert'").select("tx", F.col("ts").alias("sent"))
    f = c.feed.where("commit_state = 'Proposed'").select(F.col("block_number").alias("tx"), "seq", "ts")
    within = (F.col("ts") >= F.col("sent") - F.expr("INTERVAL 12 HOURS")) & (F.col("ts") <= F.col("sent") + F.expr("INTERVAL 12 HOURS"))
    return p.join(f, "tx").where(within).groupBy("tx").agg(F.min("seq").alias("included"))
