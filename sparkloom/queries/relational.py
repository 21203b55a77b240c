"""Scans, projections, filters, joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, quantified, shapes
from ..session import shared_folder
from .registry import Registry, use

Q = Registry()

# -- scans ---------------------------------------------------------------------------------------------------------
Q.both("a01_table_scan", "SELECT p_partkey, p_brand, p_size FROM part")
Q.both("a02_dummy_scan", "SELECT 1 AS one, 'x' AS x")
Q.both("a03_values", "SELECT * FROM (VALUES (1, 'a', CAST(1.50 AS DECIMAL(9,2))), (2, NULL, CAST(2.25 AS DECIMAL(9,2)))) AS t(a, b, c)")


@Q.frame("a04_lateral_values", "SELECT o_orderkey, v.k, v.x FROM orders, LATERAL (VALUES ('total', o_totalprice), ('tenth', o_totalprice / 10)) AS v(k, x)")
def lateral_values(t):
    rows = [[F.lit("total"), F.col("o_totalprice")], [F.lit("tenth"), F.col("o_totalprice") / 10]]
    return shapes.lateral_values(t.orders, rows, ["k", "x"]).select("o_orderkey", "k", "x")


@Q.frame("a05_generate_series", "SELECT CAST(generate_series AS BIGINT) AS i, 'up' AS way FROM generate_series(3, 17, 4) UNION ALL SELECT CAST(generate_series AS BIGINT), 'down' FROM generate_series(5, 1, -2) UNION ALL SELECT CAST(generate_series AS BIGINT), 'none' FROM generate_series(5, 1)")
def generate_series(t):
    made = [(shapes.series(t.spark, 3, 17, 4), "up"), (shapes.series(t.spark, 5, 1, -2), "down"), (shapes.series(t.spark, 5, 1), "none")]
    out = made[0][0].withColumn("way", F.lit("up"))
    for df, way in made[1:]:
        out = out.unionAll(df.withColumn("way", F.lit(way)))
    return out


@Q.frame("a05_series_per_row", "SELECT p_partkey, unnest(generate_series(CAST(1 AS BIGINT), CAST(p_size // 10 AS BIGINT))) AS i FROM part")
def series_per_row(t):
    return t.part.select("p_partkey", F.explode(shapes.series_column(F.lit(1).cast("bigint"), F.expr("p_size div 10"))).alias("i"))


@Q.frame("a06_range", "SELECT CAST(range AS BIGINT) AS i FROM range(2, 11, 3)")
def exclusive_range(t):
    return shapes.series(t.spark, 2, 11, 3, inclusive=False)


@Q.frame("a07_date_series", "SELECT CAST(generate_series AS DATE) AS d FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)")
def date_series(t):
    return shapes.date_series(t.spark, "2024-01-30", "2024-03-02")


Q.sql("a08_unnest", "SELECT vec_id, CAST(pos + 1 AS BIGINT) AS place, x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding) AS x FROM embeddings")
Q.both("a09_cte_scan", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), c AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT a.o_custkey, a.n, b.n AS again FROM c a JOIN c b ON a.o_custkey = b.o_custkey")


def _round_trip(form: str):
    def run(t):
        from ..sources import files

        path = shared_folder(t.spark, form)
        source = t.nation
        files.write(source, path, form, mode="overwrite")
        return files.read(t.spark, path, form, source.schema)

    return run


for _form, _id in (("csv", "a10_csv"), ("parquet", "a11_seed_store"), ("json", "a20_json"), ("orc", "a20_orc")):
    Q.frame(_id, "SELECT n_nationkey, n_name, n_regionkey FROM nation")(_round_trip(_form))


@Q.frame("a15_bulk_sink", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DECIMAL(38,2)) AS q FROM lineitem")
def bulk_sink(t):
    from ..sources import files

    path = shared_folder(t.spark, "bulk")
    files.bulk_copy(t.lineitem, path, t.lineitem.schema)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(38,2)").alias("q"))


@Q.frame("a16_value_conversion", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment FROM customer")
def value_conversion(t):
    from pyspark.sql import types as T

    from ..sources import files

    wanted = T.StructType([T.StructField("c_custkey", T.StringType()), T.StructField("c_acctbal", T.DecimalType(12, 2)), T.StructField("c_mktsegment", T.StringType())])
    return files.converted(t.customer, wanted)


_DESCRIBED = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS \"column\", column_type AS type, true AS nullable FROM (DESCRIBE {n})" for n in ("orders", "lineitem", "customer")
)


@Q.frame("a17_catalog_import", _DESCRIBED)
def catalog_import(t):
    from ..sources import files

    return files.import_catalog(t.spark, {n: f"{t.directory}/{n}.parquet" for n in ("orders", "lineitem", "customer")})


@Q.frame("a18_query_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def query_table(t):
    t.views("nation")
    return t.spark.sql("SELECT n_regionkey, count(*) AS n FROM IDENTIFIER(:tbl) GROUP BY n_regionkey", args={"tbl": "nation"})


# -- projection and predicates -------------------------------------------------------------------------------------
Q.sql("b01_projection", "SELECT * EXCEPT (p_name), p_size * 2 AS double_size FROM part", "SELECT * EXCLUDE (p_name), p_size * 2 AS double_size FROM part")


@Q.frame("b01_repeated_names", "SELECT n_name AS name, r_name AS name_2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def repeated_names(t):
    df = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return df.toDF(*shapes.distinct_names(["name", "name"]))


Q.both("b02_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_discount > 0.05 AND l_quantity < 10")
Q.both("b03_comparisons", "SELECT id, i = j AS eq, i <> j AS ne, i < j AS lt, i > j AS gt, i <= j AS le, i >= j AS ge FROM probe")
Q.both("b04_distinct_from", "SELECT id, i IS DISTINCT FROM j AS d, s IS NOT DISTINCT FROM 'abc' AS s_same FROM probe")
Q.both("b05_between", "SELECT id, i BETWEEN 0 AND 7 AS a, d NOT BETWEEN -1 AND 1 AS b FROM probe")
Q.both("b06_in_list", "SELECT id, i IN (7, 10) AS a, i NOT IN (7, NULL) AS b, s IN ('abc', 'ABC') AS c FROM probe")
Q.both("b07_logic", "SELECT id, i IS NULL AS a, NOT (i > 0) AS b, i > 0 AND j > 0 AS c, i > 0 OR j > 0 AS d, s IS NOT NULL AS e FROM probe")
Q.both("b08_case", "SELECT id, CASE WHEN i > 5 THEN 'big' WHEN i >= 0 THEN 'small' ELSE 'none' END AS a, CASE j WHEN 2 THEN 'two' WHEN 0 THEN 'zero' END AS b, CASE WHEN 1 = 1 THEN i ELSE 1 END AS c FROM probe")
Q.sql("b09_null_functions", "SELECT id, coalesce(i, j, -1) AS a, ifnull(s, 'none') AS b, nullif(j, 0) AS c, if(i > j, 'y', 'n') AS d FROM probe", "SELECT id, coalesce(i, j, -1) AS a, ifnull(s, 'none') AS b, nullif(j, 0) AS c, if(i > j, 'y', 'n') AS d FROM probe")
Q.both("b10_like", "SELECT id, s LIKE 'a%' AS a, s ILIKE 'a%' AS b, s NOT LIKE '_b%' AS c FROM probe")


@Q.frame("b11_qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    return shapes.qualify(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), {"rn": F.row_number().over(w)}, F.col("rn") == 1)


Q.both("b12_boolean_value", "SELECT o_orderkey, o_totalprice > 200000 AS large, (o_orderstatus = 'F') = (o_totalprice > 100000) AS agree FROM orders")


@Q.frame("b13_sample")
def sample(t):
    return shapes.sample_rows(t.orders, 0.1, 7)


@Q.frame("b13_limit_percent", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 PERCENT")
def limit_percent(t):
    return shapes.limit_percent(t.orders, 10, ["-o_totalprice", "o_orderkey"]).select("o_orderkey")


# -- joins -----------------------------------------------------------------------------------------------------------
Q.both("c01_inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
Q.both("c02_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
Q.both("c02_right_join", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 450000")
Q.both("c02_full_join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_acctbal < c_acctbal")
Q.both("c03_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
Q.both("c04_theta_join", "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal GROUP BY a.s_suppkey")
Q.both("c04_or_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey")


@Q.frame("c04_range_join", "SELECT p_partkey, v.band FROM part JOIN (VALUES (900.0, 1000.0, 'low'), (1000.5, 1200.0, 'mid'), (1200.5, NULL, 'high')) AS v(lo, hi, band) ON p_retailprice >= lo AND (hi IS NULL OR p_retailprice <= hi)")
def range_join(t):
    bands = shapes.values(t.spark, [(900.0, 1000.0, "low"), (1000.5, 1200.0, "mid"), (1200.5, None, "high")], ["lo", "hi", "band"], ["double", "double", "string"])
    return joins.range_join(t.part, bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "band")


_HISTORY = "SELECT o_custkey AS k, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS next_from, o_orderpriority AS band FROM (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey, o_orderdate)"
_INTERVAL = f"WITH h AS ({_HISTORY}) SELECT o_orderkey, band FROM orders LEFT JOIN h ON o_custkey = k AND o_orderdate >= valid_from AND (next_from IS NULL OR o_orderdate < next_from)"
Q.both("c05_interval_join", _INTERVAL)



def _shifted_orders(t):
    from ..functions.temporal import add_interval

    return t.orders.select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), add_interval(F.col("o_orderdate"), "25 years").alias("at"))


_ASOF_DUCK = "WITH o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, o_orderdate + INTERVAL 25 YEAR AS at FROM orders) SELECT o.o_orderkey, e.value AS last_value FROM o ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.at >= e.ts"


@Q.frame("c06_asof_lookup", _ASOF_DUCK)
def asof_lookup(t):
    return joins.asof_join(_shifted_orders(t), t.events, ["user_id"], "at", "ts", ["value"]).select("o_orderkey", F.col("value").alias("last_value"))


@Q.frame("c07_asof_join_salted", _ASOF_DUCK)
def asof_salted(t):
    return joins.asof_join(_shifted_orders(t), t.events, ["user_id"], "at", "ts", ["value"], salt_seconds=86_400 * 5).select("o_orderkey", F.col("value").alias("last_value"))


Q.both("c08_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
Q.both("c08_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
Q.both("c09_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
Q.both("c09_not_in_null_aware", "SELECT id FROM probe WHERE i NOT IN (SELECT j FROM probe WHERE j > 2)")
Q.both("c09_not_in_with_null", "SELECT id FROM probe WHERE j NOT IN (SELECT i FROM probe)")
Q.both("c10_semi_join", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
Q.both("c10_anti_join", "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49")
Q.both("c11_using", "SELECT user_id, a.event_id, b.event_id AS other FROM (SELECT * FROM events WHERE event_type = 'error' AND value > 150) a JOIN (SELECT * FROM events WHERE event_type = 'purchase' AND value > 150) b USING (user_id)")
Q.both("c11_natural", "SELECT r_name, n_name FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) AS n2 NATURAL JOIN region")
Q.both("c12_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
Q.both("c13_null_safe_key", "SELECT a.id AS a, b.id AS b FROM probe a JOIN probe b ON a.i IS NOT DISTINCT FROM b.i")
Q.both("c14_lateral_top", "SELECT n_name, x.c_custkey, x.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) x")
Q.both("c14_lateral_left", "SELECT r_name, x.n FROM region LEFT JOIN LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x ON true")


@Q.frame("c15_lateral_on", "SELECT r_name, x.top FROM region LEFT JOIN LATERAL (SELECT max(n_nationkey) AS top, n_regionkey FROM nation WHERE n_regionkey = r_regionkey GROUP BY n_regionkey) x ON x.top > r_regionkey + 20")
def lateral_on(t):
    top = t.nation.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("top"))
    return t.region.join(top, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("top") > F.col("r_regionkey") + 20), "left").select("r_name", "top")


Q.both("c16_single_row_cross", "SELECT s_suppkey, s_acctbal > m.top / 2 AS upper_half FROM supplier CROSS JOIN (SELECT max(s_acctbal) AS top FROM supplier) m")


@Q.frame("c17_hinted_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def hinted_join(t):
    return t.customer.join(joins.small_side(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@Q.frame("c17_salted_join", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS sizes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag")
def salted_join(t):
    joined = joins.salted_join(t.lineitem.withColumnRenamed("l_partkey", "k"), t.part.withColumnRenamed("p_partkey", "k"), ["k"], 4)
    return joined.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size").cast("bigint")).alias("sizes"))


# -- subqueries --------------------------------------------------------------------------------------------------------
Q.both("d01_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
Q.both("d02_exists", "SELECT count(*) AS n FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 499000)")
Q.both("d03_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS top FROM customer")


@Q.frame("d04_correlated_limit", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
def correlated_limit(t):
    """Spark's own plan for such a subquery sorts the table and then deals it by key, which loses the order; a ranked
    window keeps it."""
    best = shapes.distinct_on(t.orders, ["o_custkey"], ["-o_totalprice", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("best"))
    return t.customer.join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "best")


Q.both("d05_correlated_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > s_acctbal + 9000)")


@Q.frame("d06_any", "SELECT id, i < ANY (SELECT j FROM probe WHERE j > 0) AS lt, i = ANY (SELECT j FROM probe) AS eq, i <> ANY (SELECT j FROM probe WHERE j = 2) AS ne, j > ANY (SELECT i FROM probe) AS gt_null, i >= ANY (SELECT j FROM probe WHERE j > 99) AS none FROM probe")
def any_of(t):
    from .registry import probe

    p, j = probe(t), probe(t).select("j")
    out = quantified.any_of(p, "i", "<", j.where("j > 0"), "j", "lt")
    out = quantified.any_of(out, "i", "=", j, "j", "eq")
    out = quantified.any_of(out, "i", "<>", j.where("j = 2"), "j", "ne")
    out = quantified.any_of(out, "j", ">", probe(t).select(F.col("i").alias("k")), "k", "gt_null")
    out = quantified.any_of(out, "i", ">=", j.where("j > 99"), "j", "none")
    return out.select("id", "lt", "eq", "ne", "gt_null", "none")


@Q.frame("d07_all", "SELECT id, i > ALL (SELECT j FROM probe WHERE j < 2) AS gt, i <> ALL (SELECT j FROM probe) AS ne, j <= ALL (SELECT i FROM probe) AS le_null, i = ALL (SELECT j FROM probe WHERE j > 99) AS none FROM probe")
def all_of(t):
    from .registry import probe

    p, j = probe(t), probe(t).select("j")
    out = quantified.all_of(p, "i", ">", j.where("j < 2"), "j", "gt")
    out = quantified.all_of(out, "i", "<>", j, "j", "ne")
    out = quantified.all_of(out, "j", "<=", probe(t).select(F.col("i").alias("k")), "k", "le_null")
    out = quantified.all_of(out, "i", "=", j.where("j > 99"), "j", "none")
    return out.select("id", "gt", "ne", "le_null", "none")


@Q.frame("d08_row_in", "SELECT id, (i, j) IN (SELECT i, j FROM probe WHERE i IS NOT NULL AND id <> 3) AS r FROM probe")
def row_in(t):
    from .registry import probe

    return quantified.row_in(probe(t), ["i", "j"], probe(t).where("i IS NOT NULL AND id <> 3").select("i", "j"), "r", any_null_unknown=False).select("id", "r")


@Q.frame("d09_any_as_value", "SELECT o_orderkey, CASE WHEN o_totalprice > ALL (SELECT s_acctbal * 50 FROM supplier) THEN 'above' ELSE 'below' END AS place FROM orders")
def any_as_value(t):
    s = t.supplier.select((F.col("s_acctbal") * 50).alias("x"))
    return quantified.all_of(t.orders, "o_totalprice", ">", s, "x", "a").select("o_orderkey", F.when(F.col("a"), "above").otherwise("below").alias("place"))


Q.both("d10_aggregate_over_subquery", "SELECT r_name, CAST(sum(n) AS BIGINT) AS customers FROM (SELECT r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey) x GROUP BY r_name")
Q.both("d11_subquery_over_union", "SELECT n_name, count(x.k) AS n FROM nation LEFT JOIN (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000) x ON x.k = n_nationkey GROUP BY n_name")
Q.both("d12_subqueries_anywhere", "SELECT c_mktsegment, count(*) AS n, CASE WHEN count(*) > (SELECT count(*) / 5 FROM customer) THEN 'many' ELSE 'few' END AS size FROM customer GROUP BY c_mktsegment HAVING max(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)")
