"""The chain-shaped tables as DuckDB common table expressions over the raw tables, written apart from the Spark code."""

KINDS = "['Call','StaticCall','DelegateCall','CallCode','Create','Create2','SelfDestruct']"

TABLES = f"""WITH RECURSIVE blocks AS (SELECT b AS block_number, sha256('block:' || b) AS block_hash, CASE WHEN b = 0 THEN repeat('0', 64) ELSE sha256('block:' || (b - 1)) END AS parent_hash,
 1000 + b % 97 AS base_fee, CAST(30000000 AS BIGINT) AS gas_limit, b % 100 AS miner FROM (SELECT DISTINCT o_orderkey // 10 AS b FROM orders)),
txs AS (SELECT o_orderkey AS tx_id, o_orderkey // 10 AS block_number, o_orderkey % 10 AS tx_index, sha256('tx:' || o_orderkey) AS tx_hash, o_custkey AS sender,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 100 END AS to_addr, substr(o_orderpriority, 1, 1) AS selector, 1000 + o_orderkey % 301 AS max_fee, o_orderkey % 53 AS priority_fee,
 o_orderstatus <> 'F' AS status FROM orders),
logs0 AS (SELECT l_orderkey AS tx_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos,
 l_suppkey AS address, l_returnflag AS topic0, l_linestatus AS topic1, CAST(l_partkey AS VARCHAR) AS topic2, CAST(l_linenumber AS VARCHAR) AS topic3, l_extendedprice AS data,
 l_partkey AS part, l_linenumber AS line FROM lineitem),
logs AS (SELECT *, tx_id // 10 AS block_number, tx_id % 10 AS tx_index, row_number() OVER (PARTITION BY tx_id // 10 ORDER BY tx_id, pos) - 1 AS log_index FROM logs0),
receipts AS (SELECT tx_id, tx_id // 10 AS block_number, tx_id % 10 AS tx_index, 21000 + 1000 * n AS gas_used, n AS log_count,
 CAST(sum(21000 + 1000 * n) OVER (PARTITION BY tx_id // 10 ORDER BY tx_id) AS BIGINT) AS cumulative
 FROM (SELECT o_orderkey AS tx_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)),
traces AS (SELECT *, CASE WHEN kind LIKE 'Create%' AND status <> 0 THEN NULL ELSE part END AS to_addr FROM (SELECT tx_id, pos, CASE WHEN pos = 0 THEN 0 ELSE 1 + (pos - 1) % 3 END AS depth,
 CASE WHEN topic0 = 'R' THEN 2 ELSE 0 END AS status, ({KINDS})[line % 7 + 1] AS kind, address AS from_addr, part, data FROM logs0)),
feed AS (SELECT event_id AS seq, event_id // 3 AS block_number, CASE event_type WHEN 'view' THEN 'Proposed' WHEN 'click' THEN 'Voted' WHEN 'purchase' THEN 'Finalized' WHEN 'signup' THEN 'Verified' ELSE 'Gap' END AS commit_state, ts FROM events),
pool AS (SELECT event_id AS seq, user_id AS address, event_id // 4 AS tx, CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'view' THEN 'Insert' WHEN 'click' THEN 'Commit' WHEN 'error' THEN 'Drop' ELSE 'Evict' END AS kind, ts FROM events),
accounts AS (SELECT o_custkey AS address, o_orderkey // 10 AS block_number, CAST(sum(CAST(round(sum(o_totalprice) * 100) AS BIGINT)) OVER w AS BIGINT) AS balance, CAST(sum(count(*)) OVER w AS BIGINT) AS nonce
 FROM orders GROUP BY 1, 2 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey // 10)),
replicas AS (SELECT r AS replica, block_number AS n, CASE WHEN r = 'c' AND block_number % 41 = 7 THEN 'x' || block_hash ELSE block_hash END AS header, CASE WHEN r = 'c' AND block_number % 43 = 8 THEN 'x' ELSE '' END || 'r' || block_number AS receipts,
 CASE WHEN r = 'c' AND block_number % 47 = 9 THEN 'x' ELSE '' END || 't' || block_number AS traces, parent_hash, block_number % 5 + CASE WHEN r = 'c' AND block_number % 94 = 9 THEN 1 ELSE 0 END AS outputs FROM blocks, (VALUES ('a'), ('b'), ('c')) v(r) WHERE NOT (r = 'b' AND block_number % 37 = 5))
"""
