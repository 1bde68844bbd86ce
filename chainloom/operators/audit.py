"""Replica audit: compare, group, choose, explain, repair."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.registry import query

REPLICAS = ("a", "b", "c")
CHUNK = 1000
CONTENT = ("header", "receipts", "traces")
_all = "allr AS (SELECT block_number AS n, r AS replica, header, receipts, traces, outputs FROM blocks CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(r) LEFT JOIN replicas ON n = block_number AND replica = r)"
_grp = f"{_all}, grp AS (SELECT n, header, receipts, traces, max(outputs) AS outputs, count(*) AS size, min(replica) AS first FROM allr WHERE header IS NOT NULL GROUP BY n, header, receipts, traces), good AS (SELECT n, arg_min(first, (-outputs, -size, first)) AS replica FROM grp GROUP BY 1)"
_reason = "CASE WHEN {a}.header <> {b}.header THEN 'Header' WHEN {a}.receipts <> {b}.receipts THEN 'ReceiptsContents' WHEN {a}.traces <> {b}.traces THEN 'TracesContents' END"
_flt = f"{_grp}, flt AS (SELECT x.n, x.replica, CASE WHEN x.header IS NULL THEN 'Missing' ELSE {_reason.format(a='x', b='g')} END AS kind FROM allr x JOIN good USING (n) JOIN allr g ON g.n = x.n AND g.replica = good.replica)"


def matrix(c) -> DataFrame:
    """A row per block and replica, null content where the replica lacks the block."""
    every = c.blocks.select(F.col("block_number").alias("n"), F.explode(F.array(*map(F.lit, REPLICAS))).alias("replica"))
    return every.join(c.replicas, ["n", "replica"], "left")


def groups(c):
    return c.replicas.groupBy("n", *CONTENT).agg(F.max("outputs").alias("outputs"), F.count("*").alias("size"), F.min("replica").alias("first"))


def good(c):
    """The replica to trust: the first of the group of equal content with most trace outputs that aren't empty; of several, the largest."""
    r = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("outputs"), F.desc("size"), "first"))
    return groups(c).withColumn("r", r).where("r = 1").select("n", F.col("first").alias("replica"), *CONTENT)


def faults(c) -> DataFrame:
    g = good(c).select("n", F.col("replica").alias("good"), *[F.col(x).alias(f"g_{x}") for x in CONTENT])
    kind = "CASE WHEN header IS NULL THEN 'Missing' WHEN header <> g_header THEN 'Header' WHEN receipts <> g_receipts THEN 'ReceiptsContents' WHEN traces <> g_traces THEN 'TracesContents' END"
    return matrix(c).join(g, "n").selectExpr("n", "replica", "good", f"{kind} AS kind").where("kind IS NOT NULL")


@query("replica_matrix", f", {_all} SELECT n, replica, header IS NOT NULL AS present FROM allr")
def replica_matrix(c):
    return matrix(c).select("n", "replica", F.col("header").isNotNull().alias("present"))


@query("replica_groups", f", {_grp} SELECT n, first, size FROM grp")
def replica_groups(c):
    return groups(c).select("n", "first", "size")


@query("good_replica", f", {_grp} SELECT n, replica FROM good")
def good_replica(c):
    return good(c).select("n", "replica")


@query("replica_faults", f", {_flt} SELECT n, replica, kind FROM flt WHERE kind IS NOT NULL")
def replica_faults(c):
    return faults(c).select("n", "replica", "kind")


@query("inconsistency_reason", f", {_flt} SELECT n, replica, kind FROM flt WHERE kind <> 'Missing'")
def inconsistency_reason(c):
    return faults(c).where("kind <> 'Missing'").select("n", "replica", "kind")


@query("fault_summary", f", {_flt} SELECT replica, kind, count(*) AS n FROM flt WHERE kind IS NOT NULL GROUP BY ALL")
def fault_summary(c):
    return faults(c).groupBy("replica", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("kind"))


def islands(df, part: str, n: str = "n", chunk: int = CHUNK) -> DataFrame:
    """Runs of following numbers as (part, lo, hi). Within chunks of 1000 numbers first, then touching runs of neighbouring chunks are joined: no window holds a whole part's rows."""
    df = df.select(part, n).distinct().withColumn("_c", F.expr(f"{n} div {chunk}"))
    df = df.withColumn("_g", F.col(n) - F.row_number().over(Window.partitionBy(part, "_c").orderBy(n)))
    runs = df.groupBy(part, "_c", "_g").agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    w = Window.partitionBy(part).orderBy("lo")
    runs = runs.withColumn("_new", F.when(F.col("lo") == F.lag("hi").over(w) + 1, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w))
    return runs.groupBy(part, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")


_isl = f"{_flt}, isl AS (SELECT replica, min(n) AS lo, max(n) AS hi FROM (SELECT *, n - row_number() OVER (PARTITION BY replica ORDER BY n) AS g FROM flt WHERE kind IS NOT NULL) GROUP BY replica, g)"


@query("fault_ranges", f", {_isl} SELECT * FROM isl")
def fault_ranges(c):
    return islands(faults(c), "replica")


@query("fault_ranges_text", f", {_isl} SELECT replica, string_agg(CASE WHEN lo = hi THEN '' || lo ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM isl GROUP BY 1")
def fault_ranges_text(c):
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return islands(faults(c), "replica").select("replica", "lo", one.alias("t")).groupBy("replica").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "t"))), lambda x: x["t"]), ", ").alias("ranges"))


@query("fault_chunks_in_range", f", {_flt} SELECT DISTINCT replica, n // {CHUNK} * {CHUNK} AS chunk FROM flt WHERE kind IS NOT NULL AND n // {CHUNK} * {CHUNK} + {CHUNK} > 500 AND n // {CHUNK} * {CHUNK} <= 3000")
def fault_chunks_in_range(c):
    return faults(c).select("replica", F.expr(f"n div {CHUNK} * {CHUNK}").alias("chunk")).where(f"chunk + {CHUNK} > 500 AND chunk <= 3000").distinct()


@query("parent_hash_faults", f"SELECT replica, n FROM (SELECT replica, n, parent_hash, lag(n) OVER w AS pn, lag(header) OVER w AS ph FROM replicas WINDOW w AS (PARTITION BY replica, n // {CHUNK} ORDER BY n)) WHERE pn = n - 1 AND parent_hash <> ph")
def parent_hash_faults(c):
    """Within chunks of 1000 blocks, as the checker compares them."""
    w = Window.partitionBy("replica", F.expr(f"n div {CHUNK}")).orderBy("n")
    df = c.replicas.withColumn("pn", F.lag("n").over(w)).withColumn("ph", F.lag("header").over(w))
    return df.where("pn = n - 1 AND parent_hash <> ph").select("replica", "n")


@query("verify_block", f", {_all} SELECT n, replica, CASE WHEN header IS NULL THEN 'missing' WHEN header LIKE 'x%' THEN 'header' WHEN receipts LIKE 'x%' THEN 'receipts root' WHEN traces LIKE 'x%' THEN 'traces' ELSE 'ok' END AS result FROM allr")
def verify_block(c):
    """The first check that fails."""
    return matrix(c).selectExpr("n", "replica", "CASE WHEN header IS NULL THEN 'missing' WHEN header LIKE 'x%' THEN 'header' WHEN receipts LIKE 'x%' THEN 'receipts root' WHEN traces LIKE 'x%' THEN 'traces' ELSE 'ok' END AS result")


@query("recheck_diff", f", {_flt}, f AS (SELECT n, replica FROM flt WHERE kind IS NOT NULL), old AS (SELECT n, replica FROM f WHERE n % 2 = 0 UNION SELECT n + 1, replica FROM f WHERE n % 5 = 0) SELECT n, replica, 'fixed' AS change FROM (FROM old EXCEPT FROM f) UNION ALL SELECT n, replica, 'new' FROM (FROM f EXCEPT FROM old)")
def recheck_diff(c):
    f = faults(c).select("n", "replica")
    old = f.where("n % 2 = 0").union(f.where("n % 5 = 0").selectExpr("n + 1 AS n", "replica")).distinct()
    return old.subtract(f).withColumn("change", F.lit("fixed")).union(f.subtract(old).withColumn("change", F.lit("new")))


@query("fault_fix_plan", f", {_flt} SELECT f.n, f.replica, f.kind, g.replica AS source, CASE WHEN g.size < 2 THEN 'no good replica' ELSE 'fixable' END AS plan FROM flt f JOIN (SELECT n, arg_min(first, (-outputs, -size, first)) AS replica, max(size) AS size FROM grp GROUP BY 1) g USING (n) WHERE f.kind IS NOT NULL")
def fault_fix_plan(c):
    size = groups(c).groupBy("n").agg(F.max("size").alias("size"))
    return faults(c).join(size, "n").selectExpr("n", "replica", "kind", "good AS source", "CASE WHEN size < 2 THEN 'no good replica' ELSE 'fixable' END AS plan")


@query("replica_repaired", f", {_grp} SELECT x.n, x.replica, g.header, g.receipts, g.traces FROM allr x JOIN good USING (n) JOIN allr g ON g.n = x.n AND g.replica = good.replica")
def replica_repaired(c):
    return matrix(c).select("n", "replica").join(good(c).drop("replica"), "n").select("n", "replica", *CONTENT)


@query("inspect_block", f", {_flt} SELECT n, replica, coalesce(kind, 'ok') AS state FROM flt WHERE n IN (5, 7, 8, 9, 42)")
def inspect_block(c):
    f = faults(c).select("n", "replica", "kind")
    return matrix(c).select("n", "replica").where("n IN (5, 7, 8, 9, 42)").join(f, ["n", "replica"], "left").select("n", "replica", F.coalesce("kind", F.lit("ok")).alias("state"))


@query("checker_status", "SELECT replica, max(n) AS latest, (SELECT max(n) FROM replicas) - max(n) AS lag FROM replicas GROUP BY 1")
def checker_status(c):
    per = c.replicas.groupBy("replica").agg(F.max("n").alias("latest"))
    return per.select("replica", "latest", (F.max("latest").over(Window.partitionBy()) - F.col("latest")).alias("lag"))  # three rows


@query("check_window", "SELECT min(latest) AS checked, max(greatest(latest - 1000, 0)) AS upto FROM (SELECT replica, max(n) AS latest FROM replicas GROUP BY 1)")
def check_window(c):
    return c.replicas.groupBy("replica").agg(F.max("n").alias("latest")).agg(F.min("latest").alias("checked"), F.max(F.greatest(F.col("latest") - 1000, F.lit(0))).alias("upto"))


@query("checker_chunks", f", {_flt} SELECT n // {CHUNK} * {CHUNK} AS chunk, replica, count(*) AS blocks, count(kind) AS faults FROM flt GROUP BY ALL")
def checker_chunks(c):
    f = faults(c).select("n", "replica", "kind")
    return matrix(c).select("n", "replica").join(f, ["n", "replica"], "left").groupBy(F.expr(f"n div {CHUNK} * {CHUNK}").alias("chunk"), "replica").agg(F.count("*").alias("blocks"), F.count("kind").alias("faults"))
