"""Scalar functions: hex, quantities, keys, envelopes, redaction."""

from pyspark.sql import functions as F

from chainloom.registry import query


@query("hex_roundtrip", "SELECT p_partkey, '0x' || lower(hex(p_name)) AS hexed, p_name AS back FROM part")
def hex_roundtrip(c):
    h = F.lower(F.hex("p_name"))
    return c.raw("part").select("p_partkey", F.concat(F.lit("0x"), h).alias("hexed"), F.unhex(h).cast("string").alias("back"))


@query("quantity_decode", "SELECT tx_id, '0x' || lower(to_hex(tx_id)) AS quantity, tx_id AS decoded FROM txs")
def quantity_decode(c):
    q = F.concat(F.lit("0x"), F.lower(F.hex("tx_id")))
    return c.txs.select("tx_id", q.alias("quantity"), F.conv(F.substring(q, 3, 16), 16, 10).cast("long").alias("decoded"))


@query("storage_key", "SELECT tx_id, lpad(lower(to_hex(tx_id)), 64, '0') AS key FROM txs")
def storage_key(c):
    return c.txs.select("tx_id", F.lpad(F.lower(F.hex("tx_id")), 64, "0").alias("key"))


@query("block_keys", "SELECT block_number, 'block/' || lpad(CAST(block_number AS VARCHAR), 12, '0') AS key FROM blocks")
def block_keys(c):
    return c.blocks.select("block_number", F.concat(F.lit("block/"), F.lpad(F.col("block_number").cast("string"), 12, "0")).alias("key"))


@query("tx_hash_sha2", "SELECT tx_id, tx_hash FROM txs")
def tx_hash_sha2(c):
    return c.txs.select("tx_id", "tx_hash")


@query("redact_url", "SELECT page_id, regexp_replace('mongodb://user:' || page_id || '@host', '://[^@]*@', '://***@') AS url FROM pages")
def redact_url(c):
    return c.raw("pages").select("page_id", F.regexp_replace(F.concat(F.lit("mongodb://user:"), "page_id", F.lit("@host")), "://[^@]*@", "://***@").alias("url"))


@query("derive_prefix", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS prefix FROM pages")
def derive_prefix(c):
    return c.raw("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("prefix"))


@query("jsonrpc_parse", "SELECT event_id, CASE WHEN json_extract_string(props, '$.jsonrpc') = '2.0' THEN 'ok' ELSE 'InvalidRequest' END AS code FROM events")
def jsonrpc_parse(c):
    return c.raw("events").select("event_id", F.when(F.get_json_object("props", "$.jsonrpc") == "2.0", "ok").otherwise("InvalidRequest").alias("code"))


@query("event_json", """SELECT event_id, '{"eventId":' || event_id || ',"eventType":"' || event_type || '"}' AS js FROM events""")
def event_json(c):
    return c.raw("events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("eventId"), F.col("event_type").alias("eventType"))).alias("js"))
