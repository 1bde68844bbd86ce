"""Call traces: addresses in the call tree, reverted ancestors, parents, order of logs."""

from pyspark.sql import functions as F

from chainloom.registry import query

def trees(c):
    """One row per transaction: its frames in order. A transaction's frames are a bounded list."""
    f = F.array_sort(F.collect_list(F.struct("pos", "depth", "status", "kind", "from_addr", "to_addr")))
    return c.traces.groupBy("tx_id").agg(f.alias("f"))


def addressed(c):
    """Each frame with its trace address: the path of sibling numbers from the root, built by one fold over the depths."""
    fold = """aggregate(f, named_struct('path', cast(array() as array<int>), 'out', cast(array() as array<array<int>>)),
      (s, x) -> named_struct(
        'path', if(x.depth = 0, cast(array() as array<int>), concat(slice(s.path, 1, cast(x.depth - 1 as int)), array(coalesce(get(s.path, cast(x.depth - 1 as int)) + 1, 0)))),
        'out', concat(s.out, array(if(x.depth = 0, cast(array() as array<int>), concat(slice(s.path, 1, cast(x.depth - 1 as int)), array(coalesce(get(s.path, cast(x.depth - 1 as int)) + 1, 0)))))))).out"""
    df = trees(c).withColumn("a", F.expr(fold))
    return df.select("tx_id", F.explode(F.arrays_zip("f", "a")).alias("x")).select("tx_id", "x.f.*", F.col("x.a").alias("address"))


# In these traces depths run 0, 1, 2, 3, 1, 2, 3, ...: frame i > 0 hangs under child (i - 1) div 3 of the root.
_address = "CASE WHEN pos = 0 THEN '' ELSE ((pos - 1) // 3) || CASE depth WHEN 1 THEN '' WHEN 2 THEN '.0' ELSE '.0.0' END END"
_reverted = """EXISTS (SELECT 1 FROM traces p WHERE p.tx_id = t.tx_id AND p.status <> 0 AND p.pos < t.pos AND (p.pos = 0 OR ((p.pos - 1) // 3 = (t.pos - 1) // 3 AND p.depth < t.depth)))"""


@query("trace_address", f"SELECT tx_id, pos, {_address} AS address FROM traces")
def trace_address(c):
    return addressed(c).select("tx_id", "pos", F.array_join(F.col("address").cast("array<string>"), ".").alias("address"))


def with_reverted(c):
    """A fold keeps, for each depth of the open path, whether that frame or one above it failed."""
    fold = """aggregate(f, named_struct('bad', cast(array() as array<boolean>), 'out', cast(array() as array<boolean>)),
      (s, x) -> named_struct(
        'bad', concat(slice(s.bad, 1, cast(x.depth as int)), array(coalesce(get(s.bad, cast(x.depth - 1 as int)), false) or x.status <> 0)),
        'out', concat(s.out, array(coalesce(get(s.bad, cast(x.depth - 1 as int)), false))))).out"""
    df = trees(c).withColumn("r", F.expr(fold))
    return df.select("tx_id", F.explode(F.arrays_zip("f", "r")).alias("x")).select("tx_id", "x.f.*", F.col("x.r").alias("reverted"))


@query("ancestor_reverted", f"SELECT tx_id, pos, {_reverted} AS reverted FROM traces t")
def ancestor_reverted(c):
    return with_reverted(c).select("tx_id", "pos", "reverted")


_moves = "('Call', 'Create', 'Create2', 'SelfDestruct')"


@query("has_transfer", f"SELECT t.tx_id, pos, NOT {_reverted} AND x.status AND t.status = 0 AND kind IN {_moves} AS transfer FROM traces t JOIN txs x USING (tx_id)")
def has_transfer(c):
    df = with_reverted(c).join(c.txs.select("tx_id", F.col("status").alias("ok")), "tx_id")
    return df.selectExpr("tx_id", "pos", f"NOT reverted AND ok AND status = 0 AND kind IN {_moves} AS transfer")


@query("call_tree_parent", "SELECT tx_id, pos, CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN 0 ELSE pos - 1 END AS parent FROM traces")
def call_tree_parent(c):
    """The latest earlier frame one level up: a fold keeps the open frame of each depth."""
    fold = """aggregate(f, named_struct('open', cast(array() as array<bigint>), 'out', cast(array() as array<bigint>)),
      (s, x) -> named_struct('open', concat(slice(s.open, 1, cast(x.depth as int)), array(x.pos)), 'out', concat(s.out, array(get(s.open, cast(x.depth - 1 as int)))))).out"""
    return trees(c).withColumn("p", F.expr(fold)).select("tx_id", F.explode(F.arrays_zip("f", "p")).alias("x")).select("tx_id", "x.f.pos", F.col("x.p").alias("parent"))


@query("trace_log_order", f"SELECT tx_id, pos, row_number() OVER (PARTITION BY tx_id ORDER BY pos) - 1 AS emitted FROM traces")
def trace_log_order(c):
    """Logs in the order of emission: one log per frame before its children, sorted by 2a + 1 for each step of the address, then the log's even place."""
    key = "concat(transform(address, a -> 2 * a + 1), array(0, 0))"
    df = addressed(c).withColumn("k", F.expr(key)).groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("k", "pos"))).alias("s"))
    return df.select("tx_id", F.posexplode("s").alias("emitted", "x")).select("tx_id", "x.pos", F.col("emitted").cast("long").alias("emitted"))


@query("trace_top_call", "SELECT tx_id, kind, from_addr, to_addr FROM traces WHERE depth = 0")
def trace_top_call(c):
    return c.traces.where("depth = 0").select("tx_id", "kind", "from_addr", "to_addr")


@query("trace_frames", "SELECT tx_id, pos, depth, kind FROM traces WHERE tx_id // 10 = 9")
def trace_frames(c):
    from chainloom.sources.chain import Chain

    class Some(Chain):
        def raw(self, table):
            df = super().raw(table)
            return df.where("l_orderkey BETWEEN 90 AND 99") if table == "lineitem" else df

    return Some(c.spark, c.dir).traces.select("tx_id", "pos", "depth", "kind")


@query("call_frame_view", "SELECT tx_id, pos, kind, to_addr, CASE WHEN kind <> 'StaticCall' THEN data END AS value, CASE status WHEN 0 THEN NULL WHEN 2 THEN 'reverted' WHEN 3 THEN 'out of gas' WHEN 18 THEN 'reserve balance' ELSE 'error' END AS error FROM traces")
def call_frame_view(c):
    return c.traces.selectExpr("tx_id", "pos", "kind", "to_addr", "CASE WHEN kind <> 'StaticCall' THEN data END AS value", "CASE status WHEN 0 THEN NULL WHEN 2 THEN 'reverted' WHEN 3 THEN 'out of gas' WHEN 18 THEN 'reserve balance' ELSE 'error' END AS error")


@query("create_output_backfill", "SELECT tx_id, pos, coalesce(p_type, '0x') AS output FROM traces LEFT JOIN part ON p_partkey = to_addr WHERE kind LIKE 'Create%'")
def create_output_backfill(c):
    code = c.raw("part").select(F.col("p_partkey").alias("to_addr"), "p_type")
    return c.traces.where("kind LIKE 'Create%'").join(code, "to_addr", "left").select("tx_id", "pos", F.coalesce("p_type", F.lit("0x")).alias("output"))
