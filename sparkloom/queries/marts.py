"""Reports: the analytical patterns of real projects, on the driver's tables."""

from __future__ import annotations

from .registry import Registry

Q = Registry()
D = "DECIMAL(18,2)"

_PRICING = f"""
WITH x AS (
  SELECT n_name, c_mktsegment, o_custkey,
         CAST(sum(CAST(l_extendedprice AS {D})) AS DECIMAL(38,2)) AS gross, count(*) AS lines, max(l_discount) AS best_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'
  GROUP BY n_name, c_mktsegment, o_custkey),
r AS (SELECT *, CAST(rank() OVER (PARTITION BY n_name ORDER BY gross DESC, o_custkey) AS BIGINT) AS place FROM x)
SELECT * FROM r WHERE place <= 3"""
Q.both("flagship_pricing", _PRICING)
Q.both("mart_abc_classes", f"""
WITH p AS (SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS {D})) AS DECIMAL(38,2)) AS rev FROM lineitem GROUP BY l_partkey),
r AS (SELECT l_partkey, rev, CAST(sum(rev) OVER (ORDER BY rev DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS upto, CAST(sum(rev) OVER () AS DECIMAL(38,2)) AS total FROM p)
SELECT l_partkey, rev, upto, CASE WHEN upto * 10 <= total * 8 THEN 'A' WHEN upto * 100 <= total * 95 THEN 'B' ELSE 'C' END AS class FROM r""")
Q.both("mart_quarters", f"""
WITH q AS (SELECT n_name, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(sum(CAST(o_totalprice AS {D})) AS DECIMAL(38,2)) AS rev
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT a.n_name, CAST(a.y AS BIGINT) AS y, CAST(a.q AS BIGINT) AS q, a.rev, CAST(sum(a.rev) OVER (PARTITION BY a.n_name, a.y ORDER BY a.q) AS DECIMAL(38,2)) AS ytd, b.rev AS year_before
FROM q a LEFT JOIN q b ON a.n_name = b.n_name AND a.q = b.q AND a.y = b.y + 1""")
Q.both("mart_rfm", f"""
WITH c AS (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS n, CAST(sum(CAST(o_totalprice AS {D})) AS DECIMAL(38,2)) AS spent FROM orders GROUP BY o_custkey)
SELECT o_custkey, n, spent, CAST(ntile(5) OVER (ORDER BY last, o_custkey) AS BIGINT) AS r, CAST(ntile(5) OVER (ORDER BY n, o_custkey) AS BIGINT) AS f, CAST(ntile(5) OVER (ORDER BY spent, o_custkey) AS BIGINT) AS m FROM c""")
Q.both("mart_top_parts_by_nation", f"""
WITH s AS (SELECT n_name, l_partkey, CAST(sum(CAST(l_extendedprice AS {D})) AS DECIMAL(38,2)) AS rev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY rev DESC, l_partkey) AS k FROM s)
SELECT n_name, l_partkey, rev FROM r WHERE k <= 3""")
Q.both("mart_cohorts", """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY o_custkey),
x AS (SELECT DISTINCT o.o_custkey, year(first) AS cohort, (year(o_orderdate) - year(first)) AS age FROM orders o JOIN f ON o.o_custkey = f.o_custkey)
SELECT CAST(cohort AS BIGINT) AS cohort, CAST(age AS BIGINT) AS age, count(*) AS customers FROM x GROUP BY cohort, age""")
Q.both("mart_moving_average", """
WITH m AS (SELECT l_partkey % 50 AS grp, CAST(date_trunc('month', l_shipdate) AS DATE) AS mon, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY 1, 2)
SELECT grp, mon, units, CAST(sum(units) OVER w AS DOUBLE) / count(*) OVER w AS avg3 FROM m WINDOW w AS (PARTITION BY grp ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
Q.sql("mart_json_attributes", "SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n, max(value) AS top FROM events GROUP BY 1", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
Q.both("mart_supplier_scorecard", f"""
WITH s AS (SELECT l_suppkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, CAST(sum(CAST(l_extendedprice AS {D})) AS DECIMAL(38,2)) AS gross FROM lineitem GROUP BY l_suppkey)
SELECT s_name, lines, returned, gross, CAST(rank() OVER (ORDER BY gross DESC, s_name) AS BIGINT) AS place FROM s JOIN supplier ON l_suppkey = s_suppkey""")
Q.both("mart_allocation", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, CAST(floor(l_extendedprice) AS BIGINT) AS w FROM lineitem),
o AS (SELECT l_orderkey, CAST(sum(w) AS BIGINT) AS total FROM l GROUP BY l_orderkey),
s AS (SELECT l.*, o.total, CAST(floor(CAST(w AS DOUBLE) * 1000 / o.total) AS BIGINT) AS base, (w * 1000) % o.total AS rest FROM l JOIN o ON l.l_orderkey = o.l_orderkey),
k AS (SELECT s.*, 1000 - CAST(sum(base) OVER (PARTITION BY l_orderkey) AS BIGINT) AS open, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS place FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, base + CASE WHEN place <= open THEN 1 ELSE 0 END AS cents FROM k""")
Q.sql("mart_expand_by_quantity", "SELECT l_orderkey, l_linenumber, CAST(box AS BIGINT) AS box FROM lineitem LATERAL VIEW explode(sequence(1, CAST(ceil(l_quantity / 10) AS INT))) b AS box", "SELECT l_orderkey, l_linenumber, unnest(range(1, CAST(ceil(l_quantity / 10) AS BIGINT) + 1)) AS box FROM lineitem")
Q.both("mart_price_spread", "SELECT p_brand, min(p_retailprice) AS lo, median(p_retailprice) AS mid, max(p_retailprice) AS hi, count(*) AS n FROM part GROUP BY p_brand")
Q.sql("mart_date_spine", "SELECT CAST(d AS DATE) AS d, count(o_orderkey) AS n FROM (SELECT explode(sequence(DATE'1998-01-01', DATE'1998-12-31', INTERVAL 1 DAY)) AS d) s LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d GROUP BY d", "SELECT CAST(d AS DATE) AS d, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY)) AS d) s LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY d")
Q.sql("mart_name_tokens", "SELECT token, count(*) AS n FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS token GROUP BY token", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token")
Q.both("mart_hierarchy", "WITH RECURSIVE h(k, lvl) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n_nationkey, lvl + 1 FROM h JOIN nation ON n_nationkey = k * 2 + 2) SELECT k, lvl FROM h")
Q.both("mart_last_order", "WITH r AS (SELECT c_custkey, c_name, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM customer JOIN orders ON c_custkey = o_custkey) SELECT c_custkey, c_name, o_orderkey, o_orderdate FROM r WHERE k = 1")
Q.both("mart_segment_year", f"SELECT c_mktsegment, CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(o_totalprice AS {D}) ELSE 0 END) AS DECIMAL(38,2)) AS y1997, CAST(sum(CASE WHEN year(o_orderdate) = 1998 THEN CAST(o_totalprice AS {D}) ELSE 0 END) AS DECIMAL(38,2)) AS y1998 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
Q.both("mart_conversation_turns", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS longest FROM conversations GROUP BY role")
