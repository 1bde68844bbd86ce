"""Point, batch, range and as-of lookups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainloom.registry import query

KEYS = (7, 3, 7, 999999999, 12, 3)
_keys = "(VALUES " + ", ".join(f"({i}, {k})" for i, k in enumerate(KEYS)) + ") k(i, tx_id)"


def keys(c):
    return c.spark.createDataFrame(list(enumerate(KEYS)), "i int, tx_id long")


@query("meta_get", "SELECT tx_id, tx_hash FROM txs WHERE tx_id = 7")
def meta_get(c):
    return c.txs.where("tx_id = 7").select("tx_id", "tx_hash").limit(1)


@query("meta_get_many", f"SELECT i, k.tx_id, tx_hash FROM {_keys} LEFT JOIN txs USING (tx_id)")
def meta_get_many(c):
    """Order and repeats of the request are kept by its position; a miss is null. The request is a small local table."""
    found = c.txs.where(F.col("tx_id").isin(*set(KEYS))).select("tx_id", "tx_hash")
    return keys(c).join(found, "tx_id", "left").select("i", "tx_id", "tx_hash").orderBy("i")


@query("meta_scan_asc", "SELECT tx_id, priority_fee FROM txs WHERE tx_id BETWEEN 20 AND 60 ORDER BY tx_id")
def meta_scan_asc(c):
    return c.txs.where("tx_id BETWEEN 20 AND 60").select("tx_id", "priority_fee").orderBy("tx_id")


@query("meta_scan_desc_limit", "SELECT tx_id, priority_fee FROM txs WHERE tx_id BETWEEN 20 AND 600 ORDER BY tx_id DESC LIMIT 5")
def meta_scan_desc_limit(c):
    return c.txs.where("tx_id BETWEEN 20 AND 600").select("tx_id", "priority_fee").orderBy(F.desc("tx_id")).limit(5)


@query("seek_le", "SELECT tx_id, tx_hash FROM txs WHERE tx_id <= 1234 ORDER BY tx_id DESC LIMIT 1")
def seek_le(c):
    return c.txs.where("tx_id <= 1234").select("tx_id", "tx_hash").orderBy(F.desc("tx_id")).limit(1)


@query("tx_lookup_bulk", f"SELECT DISTINCT tx_id, tx_hash, sender FROM txs WHERE tx_id IN {KEYS}")
def tx_lookup_bulk(c):
    return c.txs.join(F.broadcast(keys(c).select("tx_id").distinct()), "tx_id", "left_semi").select("tx_id", "tx_hash", "sender")  # six keys


@query("prefix_scan", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'a')")
def prefix_scan(c):
    return c.raw("part").where(F.col("p_name").startswith("a")).select("p_partkey", "p_name")


@query("tx_by_hash", "SELECT tx_hash, block_number, tx_index, sender FROM txs WHERE tx_hash = sha256('tx:7')")
def tx_by_hash(c):
    return c.txs.where(F.col("tx_hash") == F.sha2(F.lit("tx:7"), 256)).select("tx_hash", "block_number", "tx_index", "sender")


@query("block_by_hash", "SELECT block_number, block_hash, count(*) AS txs FROM blocks JOIN txs USING (block_number) WHERE block_hash = sha256('block:9') GROUP BY ALL")
def block_by_hash(c):
    return c.blocks.where(F.col("block_hash") == F.sha2(F.lit("block:9"), 256)).join(c.txs, "block_number").groupBy("block_number", "block_hash").agg(F.count("*").alias("txs"))


@query("tx_by_block_index", "SELECT tx_hash, sender FROM txs WHERE block_number = 9 AND tx_index = 4")
def tx_by_block_index(c):
    return c.raw("orders").where("o_orderkey = 94").selectExpr("sha2(concat('tx:', o_orderkey), 256) AS tx_hash", "o_custkey AS sender")


def cascade(key, *sources):
    """Each key from the first source that has it: the least priority wins."""
    tagged = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    df = tagged[0]
    for s in tagged[1:]:
        df = df.unionByName(s)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("source"))).where("_r = 1").drop("_r")


def _tiers(c, *columns):
    """Buffer: the newest tenth of blocks; live database: the newer half; archive: all."""
    head = c.raw("orders").agg(F.max(F.expr("o_orderkey div 10")).alias("head"))
    t = c.txs.select("block_number", *columns)
    at = lambda share: t.where(F.col("block_number") >= head.select((F.col("head") * share).alias("x")).scalar()).drop("block_number")
    return at(0.9), at(0.5), t.drop("block_number")


_case = "CASE WHEN block_number >= 0.9 * (SELECT max(block_number) FROM txs) THEN 0 WHEN block_number >= 0.5 * (SELECT max(block_number) FROM txs) THEN 1 ELSE 2 END"


@query("source_cascade", f"SELECT tx_id, {_case} AS source FROM txs")
def source_cascade(c):
    return cascade("tx_id", *_tiers(c, "tx_id"))


@query("tx_by_hash_cascade", f"SELECT tx_hash, sender, {_case} AS source FROM txs")
def tx_by_hash_cascade(c):
    return _txs_by_hash(c).drop("tx_id")


def _txs_by_hash(c):
    """Every transaction from the first tier that has its hash."""
    return cascade("tx_hash", *_tiers(c, "tx_id", "tx_hash", "sender"))


@query("receipt_by_hash_cascade", f"SELECT tx_hash, gas_used, {_case} AS source FROM txs JOIN receipts USING (tx_id, block_number, tx_index)")
def receipt_by_hash_cascade(c):
    return _receipts_by_hash(c).drop("tx_id")


def _receipts_by_hash(c):
    """Every receipt by its transaction's hash, from the first tier that has it."""
    return _txs_by_hash(c).join(c.receipts.select("tx_id", "gas_used"), "tx_id").select("tx_id", "tx_hash", "gas_used", "source")


@query("block_cascade", f"SELECT DISTINCT block_number, {_case} AS source FROM txs")
def block_cascade(c):
    head = c.raw("orders").agg(F.max(F.expr("o_orderkey div 10")).alias("head"))
    b = c.blocks.select("block_number")
    at = lambda share: b.where(F.col("block_number") >= head.select((F.col("head") * share).alias("x")).scalar())
    return cascade("block_number", at(0.9), at(0.5), b)


def as_of(events, order, queries, at, key, values):
    """For each query the newest event of its key not after it: one shuffle by key of both, then the last non-null before."""
    e = events.select(key, F.col(order).alias("_at"), F.lit(0).alias("_q"), F.struct(*values).alias("_v"))
    q = queries.withColumn("_row", F.struct(*queries.columns)).select(key, F.col(at).alias("_at"), F.lit(1).alias("_q"), "_row")
    w = Window.partitionBy(key).orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(q, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_q = 1").select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def _asof(name, column, value):
    sql = f"SELECT c_custkey AS address, q AS at_block, {value.replace('VALUE', column)} AS {name} FROM (SELECT c_custkey, c_custkey % 50 + 10 AS q FROM customer) ASOF LEFT JOIN accounts ON c_custkey = address AND q >= block_number"

    @query(f"{name}_asof", sql)
    def f(c):
        want = c.raw("customer").selectExpr("c_custkey AS address", "c_custkey % 50 + 10 AS at_block")
        got = as_of(c.accounts, "block_number", want, "at_block", "address", [column])
        return got.select("address", "at_block", F.expr(value.replace("VALUE", column)).alias(name))


_asof("balance", "balance", "coalesce(VALUE, 0)")
_asof("nonce", "nonce", "coalesce(VALUE, 0)")
_asof("code", "nonce", "CASE WHEN VALUE % 3 = 0 THEN 'contract' ELSE '0x' END")
_asof("storage", "balance", "coalesce(VALUE % 1000, 0)")


@query("asof_id_to_block", "SELECT id, block_number FROM (SELECT CAST(range AS BIGINT) AS id FROM range((SELECT count(*) FROM lineitem))) ASOF JOIN (SELECT block_number, CAST(sum(n) OVER (ORDER BY block_number) - n AS BIGINT) AS first FROM (SELECT block_number, count(*) AS n FROM logs GROUP BY 1)) ON id >= first")
def asof_id_to_block(c):
    """The block of every log id. Ranges and ids meet by page of 65536 ids, so that no window holds more than a page."""
    from chainloom.operators.index import running_ranges

    n = c.raw("lineitem").groupBy(F.expr("l_orderkey div 10").alias("block_number")).agg(F.count("*").alias("n"))
    ranges = running_ranges(n).withColumn("page", F.explode(F.expr("sequence(first div 65536, (first + n - 1) div 65536)")))
    ids = c.spark.range(c.raw("lineitem").count()).selectExpr("id", "id div 65536 AS page")
    return as_of(ranges, "first", ids, "id", "page", ["block_number"]).select("id", "block_number")
