"""The family index: dense id ranges, filter extraction, inverted bitmaps, their reader and validator."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.registry import query

PAGE, HALF, ITEMS, WORD = 65536, 32768, 1024, 64


def running_ranges(counts: DataFrame, key: str = "block_number", chunk: int = 1024) -> DataFrame:
    """Each block's first id. Blocks are summed in chunks of 1024; one window runs over the chunks' sums, the other within each chunk."""
    df = counts.withColumn("_c", F.expr(f"{key} div {chunk}"))
    w = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("_c").agg(F.sum("n").alias("_n")).select("_c", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    own = Window.partitionBy("_c").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_i", F.coalesce(F.sum("n").over(own), F.lit(0))).join(sums, "_c").select(key, "n", (F.col("_o") + F.col("_i")).alias("first"))


def _family(c):
    txs = c.raw("orders").groupBy(F.expr("o_orderkey div 10").alias("block_number")).agg(F.count("*").alias("tx"))
    logs = c.raw("lineitem").groupBy(F.expr("l_orderkey div 10").alias("block_number")).agg(F.count("*").alias("log"))
    return txs.join(logs, "block_number", "left").select("block_number", "tx", F.coalesce("log", F.lit(0)).alias("log"))


_ranges = """fam AS (SELECT block_number, 'tx' AS family, count(*) AS n FROM txs GROUP BY 1 UNION ALL SELECT b.block_number, 'log', count(l.tx_id) FROM blocks b LEFT JOIN logs l USING (block_number) GROUP BY 1),
rng AS (SELECT block_number, family, n, CAST(sum(n) OVER (PARTITION BY family ORDER BY block_number) - n AS BIGINT) AS first FROM fam)"""


def ranges(c):
    fam = _family(c)
    one = lambda f: running_ranges(fam.select("block_number", F.col(f).alias("n"))).select("block_number", F.lit(f).alias("family"), "n", "first")
    return one("tx").union(one("log"))


@query("family_ranges", f", {_ranges} SELECT * FROM rng")
def family_ranges(c):
    return ranges(c)


@query("family_block_index", f", {_ranges} SELECT family, first, block_number FROM rng WHERE n > 0")
def family_block_index(c):
    return ranges(c).where("n > 0").select("family", "first", "block_number")


@query("family_rows", "SELECT t.tx_id, tx_hash, pos, address, kind, depth FROM txs t JOIN logs0 USING (tx_id) JOIN (SELECT tx_id, pos, kind, depth FROM traces) USING (tx_id, pos)")
def family_rows(c):
    """Transactions with their logs and frames; logs and frames share one scan and window."""
    frames = c.traces.select("tx_id", "pos", F.col("from_addr").alias("address"), "kind", "depth")
    return c.txs.select("tx_id", "tx_hash").join(frames, "tx_id").select("tx_id", "tx_hash", "pos", "address", "kind", "depth")


def extract(df, id_, **kinds):
    """One row (id, kind, value) per filter value that a row has: a Generate, no join."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    return df.select(F.col(id_).alias("id"), F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("f")).select("id", "f.kind", "f.value")


def log_filters(c):
    return extract(log_ids(c), "id", Address=F.col("address"), Topic0=F.col("topic0"), Topic1=F.col("topic1"), Topic2=F.col("topic2"), Topic3=F.col("topic3"))


def log_ids(c):
    """Dense log ids: the block's first id plus the number within the block."""
    first = ranges(c).where("family = 'log'").select("block_number", "first")
    return c.logs.join(first, "block_number").withColumn("id", F.col("first") + F.col("log_index"))


_ids = "ids AS (SELECT *, row_number() OVER (ORDER BY block_number, log_index) - 1 AS id FROM logs)"
_flog = "flog AS (" + " UNION ALL ".join(f"SELECT id, '{k}' AS kind, CAST({v} AS VARCHAR) AS value FROM ids" for k, v in (("Address", "address"), ("Topic0", "topic0"), ("Topic1", "topic1"), ("Topic2", "topic2"), ("Topic3", "topic3"))) + ")"


@query("filters_log", f", {_ids}, {_flog} SELECT * FROM flog")
def filters_log(c):
    return log_filters(c)


@query("filters_tx", "SELECT tx_id AS id, 'From' AS kind, CAST(sender AS VARCHAR) AS value FROM txs UNION ALL SELECT tx_id, 'To', CAST(to_addr AS VARCHAR) FROM txs WHERE to_addr IS NOT NULL UNION ALL SELECT tx_id, 'Selector', selector FROM txs")
def filters_tx(c):
    return extract(c.txs, "tx_id", From=F.col("sender"), To=F.col("to_addr"), Selector=F.col("selector"))


@query("filters_block", "SELECT block_number AS id, 'Miner' AS kind, CAST(miner AS VARCHAR) AS value FROM blocks")
def filters_block(c):
    return extract(c.blocks, "block_number", Miner=F.col("miner"))


@query("filters_trace", "SELECT tx_id AS id, 'From' AS kind, CAST(from_addr AS VARCHAR) AS value FROM traces UNION ALL SELECT tx_id, 'To', CAST(to_addr AS VARCHAR) FROM traces WHERE to_addr IS NOT NULL UNION ALL SELECT tx_id, 'TopLevel', '1' FROM traces WHERE depth = 0")
def filters_trace(c):
    return extract(c.traces, "tx_id", From=F.col("from_addr"), To=F.col("to_addr"), TopLevel=F.when(F.col("depth") == 0, F.lit("1")))


def words(filters):
    """The inverted index: for each filter value and page of 65536 ids the 64-bit words that hold any, as rows (kind, value, page, word, bits). Built with partial aggregation. A
    value seen once costs one row, a page full of it 1024; words combine without decoding, and no row grows with a value's ids."""
    df = filters.selectExpr("kind", "value", f"id div {PAGE} AS page", f"(id % {PAGE}) div {WORD} AS word", f"shiftleft(1L, CAST(id % {WORD} AS INT)) AS bit")
    return df.groupBy("kind", "value", "page", "word").agg(F.bit_or("bit").alias("bits"))


def cut_words(held, frontier: int):
    """Words with the bits of ids below the frontier alone."""
    base = f"page * {PAGE} + word * {WORD}"
    mask = f"CASE WHEN {base} + {WORD} <= {frontier} THEN -1L ELSE shiftrightunsigned(-1L, CAST({WORD} - {frontier} + {base} AS INT)) END"
    return held.where(f"{base} < {frontier}").withColumn("bits", F.expr(f"bits & ({mask})")).where("bits <> 0")


def _low(filters):
    return filters.where("kind IN ('Topic0', 'Topic1')")


@query("bitmap_pages", f", {_ids}, {_flog} SELECT kind, value, id // {PAGE} AS page, (id % {PAGE}) // {HALF} AS half, count(*) AS n FROM flog GROUP BY ALL")
def bitmap_pages(c):
    return words(log_filters(c)).groupBy("kind", "value", "page", F.expr(f"word div {HALF // WORD}").alias("half")).agg(F.sum(F.bit_count("bits")).alias("n"))


@query("bitmap_page_stats", f", {_ids}, {_flog} SELECT kind, value, id // {PAGE} AS page, count(*) AS n FROM flog GROUP BY ALL")
def bitmap_page_stats(c):
    return log_filters(c).groupBy("kind", "value", F.expr(f"id div {PAGE}").alias("page")).agg(F.count("*").alias("n"))


@query("bitmap_or", f", {_ids} SELECT id // {PAGE} AS page, count(*) AS n FROM ids WHERE topic0 IN ('A', 'R') GROUP BY 1")
def bitmap_or(c):
    p = words(_low(log_filters(c)).where("kind = 'Topic0' AND value IN ('A', 'R')"))
    return p.groupBy("page", "word").agg(F.bit_or("bits").alias("bits")).groupBy("page").agg(F.sum(F.bit_count("bits")).alias("n"))


@query("bitmap_and", f", {_ids} SELECT id // {PAGE} AS page, count(*) AS n FROM ids WHERE topic0 IN ('A', 'R') AND topic1 = 'F' GROUP BY 1")
def bitmap_and(c):
    """OR within a filter's values, AND across filters; a word that lacks a filter holds nothing."""
    p = words(_low(log_filters(c)).where("(kind = 'Topic0' AND value IN ('A', 'R')) OR (kind = 'Topic1' AND value = 'F')"))
    each = p.groupBy("kind", "page", "word").agg(F.bit_or("bits").alias("bits"))
    both = each.groupBy("page", "word").agg(F.count("*").alias("k"), F.bit_count(F.bit_and("bits")).alias("n")).where("k = 2 AND n > 0")
    return both.groupBy("page").agg(F.sum("n").alias("n"))


@query("bitmap_member", f", {_ids} SELECT id, topic0 = 'R' AS member FROM ids")
def bitmap_member(c):
    """Every log id tested against the words of one value."""
    p = words(_low(log_filters(c)).where("kind = 'Topic0' AND value = 'R'")).select("page", "word", "bits")
    ids = log_ids(c).selectExpr("id", f"id div {PAGE} AS page", f"(id % {PAGE}) div {WORD} AS word")
    return ids.join(p, ["page", "word"], "left").select("id", F.expr(f"coalesce(shiftright(bits, CAST(id % {WORD} AS INT)) & 1 = 1, false)").alias("member"))


@query("bitmap_merge_committed", f", {_ids} SELECT topic0 AS value, count(*) AS n FROM ids GROUP BY 1")
def bitmap_merge_committed(c):
    """Pages of an index whose last flush failed: ids from the committed frontier on were written, under a wrong value at that. They are cut off before the flush is done again."""
    f, frontier = _low(log_filters(c)).where("kind = 'Topic0'"), 1000
    failed = f.where(f"id >= {frontier} AND id < {frontier} + 700").withColumn("value", F.lit("A"))
    held = cut_words(words(f.where(f"id < {frontier}").union(failed)), frontier)
    merged = held.union(words(f.where(f"id >= {frontier}"))).groupBy("value", "page", "word").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy("value").agg(F.sum(F.bit_count("bits")).alias("n"))


def all_filters(c):
    """The filters of all families, the kind led by its family: ids are of the family's own."""
    families = (("block", filters_block(c)), ("tx", filters_tx(c)), ("log", log_filters(c)), ("trace", filters_trace(c)))
    rows = [df.select("id", F.concat(F.lit(f"{family}:"), "kind").alias("kind"), "value") for family, df in families]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


_kinds = ("SELECT block_number AS id, 'block:Miner' AS kind, CAST(miner AS VARCHAR) AS value FROM blocks UNION ALL SELECT tx_id, 'tx:From', CAST(sender AS VARCHAR) FROM txs"
          " UNION ALL SELECT tx_id, 'tx:To', CAST(to_addr AS VARCHAR) FROM txs WHERE to_addr IS NOT NULL UNION ALL SELECT tx_id, 'tx:Selector', selector FROM txs UNION ALL SELECT id, 'log:' || kind, value FROM flog"
          " UNION ALL SELECT tx_id, 'trace:From', CAST(from_addr AS VARCHAR) FROM traces UNION ALL SELECT tx_id, 'trace:To', CAST(to_addr AS VARCHAR) FROM traces WHERE to_addr IS NOT NULL UNION ALL SELECT tx_id, 'trace:TopLevel', '1' FROM traces WHERE depth = 0")
_allf = f"{_ids}, {_flog}, allf AS (SELECT DISTINCT * FROM ({_kinds})), havef AS (SELECT DISTINCT id, kind, CASE WHEN id % 401 = 9 THEN 'wrong' ELSE value END AS value FROM allf WHERE id % 499 <> 7)"


def stored_filters(filters):
    """The filters as an index holds them that lost some ids and files others under a wrong value."""
    return filters.where("id % 499 <> 7").withColumn("value", F.expr("CASE WHEN id % 401 = 9 THEN 'wrong' ELSE value END"))


@query("bitmap_validate", f", {_allf} SELECT 'missing' AS side, count(*) AS n FROM (FROM allf EXCEPT FROM havef) UNION ALL SELECT 'orphaned', count(*) FROM (FROM havef EXCEPT FROM allf)")
def bitmap_validate(c):
    """Every filter of every family against an index with planted faults."""
    f = all_filters(c)
    return bitmap_differences(f, words(stored_filters(f)))


def bitmap_differences(wanted, stored):
    """Filters against words: bits that a filter should have set and hasn't, and bits set that no row has, word by word."""
    both = words(wanted).withColumnRenamed("bits", "w").join(stored.withColumnRenamed("bits", "h"), ["kind", "value", "page", "word"], "full")
    count = lambda x, y: F.coalesce(F.sum(F.expr(f"bit_count(coalesce({x}, 0L) & ~coalesce({y}, 0L))")), F.lit(0))
    return both.agg(count("w", "h").alias("missing"), count("h", "w").alias("orphaned")).select(F.expr("stack(2, 'missing', missing, 'orphaned', orphaned) AS (side, n)"))


@query("bitmap_diff_sample", f", {_ids} SELECT topic0 AS value, string_agg(id, ',' ORDER BY id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY topic0 ORDER BY id) AS r FROM ids) WHERE r <= 5 GROUP BY 1")
def bitmap_diff_sample(c):
    """The first five ids of each value: a ranked limit, no gathered list."""
    df = log_ids(c).select("topic0", "id").withColumn("r", F.row_number().over(Window.partitionBy("topic0").orderBy("id"))).where("r <= 5")
    return df.groupBy(F.col("topic0").alias("value")).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("sample"))


@query("bitmap_key", "SELECT tx_id, lower(lpad(to_hex(tx_id), 16, '0')) AS key FROM txs")
def bitmap_key(c):
    return c.txs.select("tx_id", F.lower(F.lpad(F.hex("tx_id"), 16, "0")).alias("key"))


def offsets(c):
    size = (F.length("topic2") + 40).alias("len")
    ids = log_ids(c).select("id", F.expr(f"id div {ITEMS}").alias("bucket"), size)
    w = Window.partitionBy("bucket").orderBy("id")
    return ids.withColumn("end", F.sum("len").over(w)).withColumn("start", F.col("end") - F.col("len"))


_off = f"off AS (SELECT id, id // {ITEMS} AS bucket, CAST(sum(length(topic2) + 40) OVER (PARTITION BY id // {ITEMS} ORDER BY id) AS BIGINT) AS \"end\", length(topic2) + 40 AS len FROM ids)"


@query("payload_offsets", f", {_ids}, {_off} SELECT id, bucket, \"end\" FROM off")
def payload_offsets(c):
    return offsets(c).select("id", "bucket", "end")


@query("byte_offsets", f", {_ids}, {_off} SELECT id, \"end\" - len AS start, \"end\" FROM off")
def byte_offsets(c):
    return offsets(c).select("id", "start", "end")


@query("payload_groups", f", {_ids}, {_off} SELECT bucket, count(*) AS n, CAST(sum(len) AS BIGINT) AS size FROM off GROUP BY 1")
def payload_groups(c):
    return offsets(c).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("len").alias("size"))


@query("payload_slice", "SELECT o_orderkey AS id, substr(o_orderpriority, 1 + CAST(o_orderkey % 3 AS INT), 4) AS part FROM orders WHERE o_orderkey % 3 + 4 <= length(o_orderpriority)")
def payload_slice(c):
    return c.raw("orders").where("o_orderkey % 3 + 4 <= length(o_orderpriority)").selectExpr("o_orderkey AS id", "substr(o_orderpriority, 1 + CAST(o_orderkey % 3 AS INT), 4) AS part")


@query("id_pages", f"SELECT tx_id, tx_id // {PAGE} * {PAGE} AS page, tx_id // {ITEMS} AS bucket FROM txs")
def id_pages(c):
    return c.txs.selectExpr("tx_id", f"tx_id div {PAGE} * {PAGE} AS page", f"tx_id div {ITEMS} AS bucket")


_stored = f"{_ranges}, stored AS (SELECT block_number, family, n, first + CASE WHEN family = 'log' AND block_number % 131 = 17 THEN 1 ELSE 0 END AS first FROM rng WHERE NOT (family = 'tx' AND block_number % 137 = 5))"


def stored_ranges(c):
    """The ranges as an index holds them that lost some rows of one family and has some of another wrong."""
    return ranges(c).where("NOT (family = 'tx' AND block_number % 137 = 5)").withColumn("first", F.col("first") + F.expr("CASE WHEN family = 'log' AND block_number % 131 = 17 THEN 1 ELSE 0 END"))


@query("validate_contiguity", f", {_stored} SELECT family, count(*) FILTER (first <> want) AS violations FROM (SELECT *, lag(first + n) OVER (PARTITION BY family ORDER BY block_number) AS want FROM stored) GROUP BY 1")
def validate_contiguity(c):
    return contiguity(stored_ranges(c))


def contiguity(ranges):
    """Each range begins where the one before it ends: within chunks of 1024 blocks by their rows, between chunks by one row for each, so no window holds all blocks."""
    df = ranges.withColumn("_c", F.expr("block_number div 1024")).withColumn("_end", F.col("first") + F.col("n"))
    inner = df.withColumn("want", F.lag("_end").over(Window.partitionBy("family", "_c").orderBy("block_number"))).select("family", "first", "want")
    chunks = df.groupBy("family", "_c").agg(F.min_by("first", "block_number").alias("first"), F.max_by("_end", "block_number").alias("_end"))
    outer = chunks.withColumn("want", F.lag("_end").over(Window.partitionBy("family").orderBy("_c"))).select("family", "first", "want")
    return inner.union(outer).groupBy("family").agg(F.count_if(F.expr("first <> want")).alias("violations"))


@query("validate_block_index", f", {_stored} SELECT 'missing' AS side, family, block_number FROM (SELECT family, block_number, first FROM rng WHERE n > 0 EXCEPT SELECT family, block_number, first FROM stored) UNION ALL SELECT 'wrong', family, block_number FROM (SELECT family, block_number, first FROM stored WHERE n > 0 EXCEPT SELECT family, block_number, first FROM rng)")
def validate_block_index(c):
    """First ids that the index lacks, and such as it has and no block begins with."""
    want, have = (df.where("n > 0").select("family", "block_number", "first") for df in (ranges(c), stored_ranges(c)))
    return want.exceptAll(have).select(F.lit("missing").alias("side"), "family", "block_number").union(have.exceptAll(want).select(F.lit("wrong").alias("side"), "family", "block_number"))


@query("validate_frontier", f", {_ranges} SELECT family, CAST(sum(n) AS BIGINT) AS next_id, max(first + n) AS frontier FROM rng GROUP BY 1")
def validate_frontier(c):
    return ranges(c).groupBy("family").agg(F.sum("n").alias("next_id"), F.max(F.col("first") + F.col("n")).alias("frontier"))


_soff = f"{_off}, soff AS (SELECT id, bucket, len, \"end\" - CASE WHEN id % 577 = 3 THEN 1 ELSE 0 END AS \"end\" FROM off)"


@query("validate_payload_bounds", f", {_ids}, {_soff} SELECT id FROM (SELECT *, coalesce(lag(\"end\") OVER (PARTITION BY bucket ORDER BY id), 0) AS before FROM soff) WHERE \"end\" - before <> len")
def validate_payload_bounds(c):
    """Items whose bounds don't hold as many bytes as they have, in an index with some ends wrong."""
    w = Window.partitionBy("bucket").orderBy("id")
    stored = offsets(c).withColumn("end", F.col("end") - F.expr("CASE WHEN id % 577 = 3 THEN 1 ELSE 0 END"))
    return stored.withColumn("before", F.lag("end", 1, 0).over(w)).where("end - before <> len").select("id")
