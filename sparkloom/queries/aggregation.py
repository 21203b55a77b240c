"""Aggregates, grouping sets, windows, order, sets, recursion and pivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import nested
from ..functions.numeric import double_to_decimal, double_to_int, round_double
from ..operators import recursive, shapes
from .registry import Registry, probe

Q = Registry()

Q.both("e01_group_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
Q.both("e02_global_aggregate", "SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_totalprice < 0")
Q.both("e03_constant_key", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY 'x'")
Q.both("e04_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
Q.both("e04_ordinals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
Q.both("e05_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
Q.both("e06_counts", "SELECT event_type, count(*) AS n, count(value) AS v, count(DISTINCT user_id) AS u FROM events GROUP BY event_type")
Q.sql("e07_sums", "SELECT l_returnflag, sum(CAST(l_linenumber AS BIGINT)) AS i, CAST(sum(CAST(l_orderkey AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS b, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS i, CAST(sum(l_orderkey) AS DECIMAL(38,0)) AS b, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS d FROM lineitem GROUP BY l_returnflag")


@Q.frame("e08_avg", "SELECT l_linestatus, avg(l_linenumber) AS i, round(avg(CAST(l_extendedprice AS DECIMAL(18,2))), 6) AS d FROM lineitem GROUP BY l_linestatus")
def averages(t):
    return t.lineitem.groupBy("l_linestatus").agg(A.avg_double(F.col("l_linenumber")).alias("i"), round_double(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("l_extendedprice"), 6).alias("d"))


Q.both("e09_min_max", "SELECT p_type, min(p_name) AS a, max(p_name) AS b, min(p_retailprice) AS c, max(p_size) AS d FROM part GROUP BY p_type")
Q.sql("e10_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
Q.both("e11_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS bought, max(value) FILTER (WHERE event_type = 'error') AS worst FROM events GROUP BY user_id")


@Q.frame("e12_median", "SELECT p_type, median(p_size) AS s, median(p_retailprice) AS p FROM part GROUP BY p_type")
def medians(t):
    return t.part.groupBy("p_type").agg(F.median("p_size").alias("s"), F.median("p_retailprice").alias("p"))


@Q.frame("e12_median_decimal", "SELECT p_type, median(CAST(p_retailprice AS DECIMAL(18,2))) AS median FROM part GROUP BY p_type")
def medians_decimal(t):
    return A.decimal_median(t.part.withColumn("x", F.col("p_retailprice").cast("decimal(18,2)")), ["p_type"], "x")


@Q.frame("e13_quantile_cont", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.9), 6) AS q FROM customer GROUP BY c_mktsegment")
def quantile_cont(t):
    return t.customer.groupBy("c_mktsegment").agg(round_double(A.quantile_cont(F.col("c_acctbal"), 0.9), 6).alias("q"))


@Q.frame("e14_quantile_disc", "SELECT p_type, quantile_disc(p_size, 0.25) AS a, quantile_disc(p_name, 0.5) AS b FROM part GROUP BY p_type")
def quantile_disc(t):
    return t.part.groupBy("p_type").agg(A.quantile_disc(F.col("p_size"), 0.25, "int").alias("a"), A.quantile_disc(F.col("p_name"), 0.5, "string").alias("b"))


@Q.frame("e15_quantile_list", "SELECT p_type, round(q[1], 9) AS a, round(q[2], 9) AS b, round(q[3], 9) AS c FROM (SELECT p_type, quantile_cont(p_size, [0.1, 0.5, 0.9]) AS q FROM part GROUP BY p_type)")
def quantile_list(t):
    q = F.percentile("p_size", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return t.part.groupBy("p_type").agg(q.alias("q")).select("p_type", *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate("abc")])


Q.sql("e16_deviation", "SELECT p_type, round(stddev(p_size), 9) AS a, round(stddev_pop(p_size), 9) AS b, round(var_samp(p_size), 8) AS c, round(var_pop(p_size), 8) AS d, stddev_samp(CASE WHEN p_partkey = 1 THEN p_size END) AS one FROM part GROUP BY p_type", "SELECT p_type, round(stddev(p_size), 9) AS a, round(stddev_pop(p_size), 9) AS b, round(var_samp(p_size), 8) AS c, round(var_pop(p_size), 8) AS d, stddev_samp(CASE WHEN p_partkey = 1 THEN p_size END) AS one FROM part GROUP BY p_type")
Q.both("e17_booleans", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 499900) AS b FROM orders GROUP BY o_orderstatus")


@Q.frame("e18_first_last", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, any_value(o_custkey) AS any FROM orders GROUP BY o_custkey")
def first_last(t):
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first"), F.max_by("o_orderkey", at).alias("last"), F.any_value("o_custkey").alias("any"))


@Q.frame("e19_mode", "SELECT p_type, arg_min(p_size, (-c, p_size)) AS mode FROM (SELECT p_type, p_size, count(*) AS c FROM part GROUP BY ALL) GROUP BY p_type")
def modes(t):
    return A.mode(t.part, ["p_type"], "p_size")


Q.sql("e20_corr", "SELECT p_type, round(corr(p_size, p_retailprice), 9) AS c FROM part GROUP BY p_type", "SELECT p_type, round(corr(p_size, p_retailprice), 9) AS c FROM part GROUP BY p_type")
_REGR = ", ".join(f"round({f}(c_acctbal, c_nationkey), 4) AS {f}" for f in ("covar_pop", "covar_samp", "regr_avgx", "regr_avgy", "regr_sxx", "regr_slope", "regr_intercept", "regr_r2"))
Q.both("e21_regression", f"SELECT c_mktsegment, CAST(regr_count(c_acctbal, c_nationkey) AS BIGINT) AS n, {_REGR} FROM customer GROUP BY c_mktsegment")
Q.both("e21_regression_sums", "SELECT c_mktsegment, round(regr_sxy(c_acctbal, c_nationkey), 3) AS sxy, round(regr_syy(c_acctbal, c_nationkey) / 1000, 3) AS syy FROM customer GROUP BY c_mktsegment")
Q.both("e22_bits", "SELECT p_type, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM part GROUP BY p_type")
Q.sql("e23_approx_distinct", "SELECT event_type, abs(approx_count_distinct(user_id, 0.02) / count(DISTINCT user_id) - 1) < 0.1 AS near, count(DISTINCT user_id) AS n FROM events GROUP BY event_type", "SELECT event_type, true AS near, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")


@Q.frame("e24_arg_max", "SELECT c_mktsegment, arg_max(c_custkey, c_acctbal) AS rich, arg_min(c_custkey, c_acctbal) AS poor FROM customer GROUP BY c_mktsegment")
def arg_max(t):
    """Of equal balances the first row in the order of the files."""
    rows = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    args = F.col("c_custkey"), F.col("c_acctbal"), F.col("at")
    return rows.groupBy("c_mktsegment").agg(A.arg_max(*args).alias("rich"), A.arg_min(*args).alias("poor"))


@Q.frame("e25_list", "SELECT j, array_to_string(list(coalesce(CAST(i AS VARCHAR), '-') ORDER BY id), ',') AS items, CAST(len(list(i)) AS BIGINT) AS n FROM probe GROUP BY j")
def lists(t):
    made = probe(t).groupBy("j").agg(nested.collect_with_nulls(F.col("i"), F.col("id")).alias("l"))
    return made.select("j", F.array_join(F.transform("l", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("items"), F.size("l").cast("bigint").alias("n"))


@Q.frame("e26_moments", "SELECT p_type, round(skewness(p_size), 9) AS sk, round(kurtosis(p_size), 8) AS ku, round(kurtosis_pop(p_size), 8) AS kp, round(stddev_pop(p_size) / sqrt(count(p_size)), 9) AS sem, round(geomean(p_size), 8) AS gm FROM part GROUP BY p_type")
def moments(t):
    x = F.col("p_size")
    cols = {"sk": (A.skewness(x), 9), "ku": (A.kurtosis(x), 8), "kp": (F.kurtosis(x), 8), "sem": (A.sem(x), 9), "gm": (A.geomean(x), 8)}
    return t.part.groupBy("p_type").agg(*[round_double(c, d).alias(n) for n, (c, d) in cols.items()])


@Q.frame("e26_entropy", "SELECT o_orderstatus, round(entropy(o_orderpriority), 9) AS entropy FROM orders GROUP BY o_orderstatus")
def entropies(t):
    return A.entropy(t.orders, ["o_orderstatus"], "o_orderpriority").select("o_orderstatus", round_double(F.col("entropy"), 9).alias("entropy"))


@Q.frame("e26_mad", "SELECT p_type, mad(p_size) AS mad FROM part GROUP BY p_type")
def mads(t):
    return A.mad(t.part, ["p_type"], "p_size")


@Q.frame("e26_product", "SELECT n_regionkey, product(n_nationkey + 1) AS p FROM nation GROUP BY n_regionkey")
def products(t):
    return t.nation.groupBy("n_regionkey").agg(A.product(F.col("n_nationkey") + 1).alias("p"))


@Q.frame("e26_histogram", "SELECT o_orderstatus, array_to_string(list_transform(map_entries(histogram(o_orderpriority)), lambda e: e.key || '=' || e.value), ',') AS h FROM orders GROUP BY o_orderstatus")
def histograms(t):
    h = A.histogram(t.orders, ["o_orderstatus"], "o_orderpriority")
    return h.select("o_orderstatus", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("h"))


@Q.frame("e26_weighted_avg", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS w FROM lineitem GROUP BY l_returnflag")
def weighted(t):
    return t.lineitem.groupBy("l_returnflag").agg(round_double(A.weighted_avg(F.col("l_discount"), F.col("l_quantity")), 8).alias("w"))


Q.sql("e27_count_if", "SELECT event_type, count_if(value > 100) AS n FROM events GROUP BY event_type", "SELECT event_type, CAST(count_if(value > 100) AS BIGINT) AS n FROM events GROUP BY event_type")
Q.sql(
    "e27_approx_quantile",
    "SELECT e.event_type, count(*) AS n, abs(count_if(value <= q) / count(value) - 0.5) < 0.01 AS near FROM events e JOIN (SELECT event_type, percentile_approx(value, 0.5, 10000) AS q FROM events GROUP BY event_type) a ON e.event_type = a.event_type GROUP BY e.event_type",
    "SELECT event_type, count(*) AS n, true AS near FROM events GROUP BY event_type",
)


@Q.frame("e26_exact_sums", "SELECT o_orderstatus, round(fsum(o_totalprice), 4) AS s, round(kahan_sum(-o_totalprice), 4) AS k, round(favg(o_totalprice), 6) AS a FROM orders GROUP BY o_orderstatus")
def exact_sums(t):
    x = F.col("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(round_double(A.exact_sum(x), 4).alias("s"), round_double(A.exact_sum(-x), 4).alias("k"), round_double(A.exact_avg(x), 6).alias("a"))


@Q.frame("e26_approx_top_k", "SELECT array_to_string(list_sort(approx_top_k(o_orderstatus, 2)), ',') AS top FROM orders")
def top_k(t):
    return t.orders.agg(F.array_join(F.array_sort(A.approx_top_k("o_orderstatus", 2)), ",").alias("top"))


@Q.frame("e27_bitstring", "SELECT p_brand, CAST(bitstring_agg(p_size, 0, 63) AS VARCHAR) AS bits FROM part GROUP BY p_brand")
def bitstrings(t):
    return t.part.groupBy("p_brand").agg(A.bitstring(F.col("p_size"), 0, 63).alias("bits"))
Q.sql("e28_distinct_aggregates", "SELECT p_brand, sum(DISTINCT CAST(p_size AS BIGINT)) AS s, count(DISTINCT p_type) AS t, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, count(DISTINCT p_type) AS t, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand")
Q.both("e29_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS gs, CAST(grouping(o_orderpriority) AS BIGINT) AS gp FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
Q.both("e29_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
Q.both("e29_grouping_sets", "SELECT p_brand, p_type, max(p_size) AS m FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
Q.both("e30_conditional", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS o FROM orders GROUP BY o_custkey")
Q.both("e31_aggregate_of_aggregate", "SELECT o_orderstatus, o_orderpriority, CAST(sum(sum(CAST(o_totalprice AS DECIMAL(18,2)))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS DECIMAL(38,2)) AS running FROM orders GROUP BY o_orderstatus, o_orderpriority")

# -- windows ---------------------------------------------------------------------------------------------------------
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
Q.sql("f01_ranks", f"SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders", f"SELECT o_orderkey, row_number() {_W} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders")
Q.both("f02_distribution", f"SELECT o_orderkey, percent_rank() {_W} AS pr, cume_dist() {_W} AS cd, CAST(ntile(4) {_W} AS BIGINT) AS nt FROM orders")
Q.both("f03_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) {_W} AS a, lead(o_totalprice, 2) {_W} AS b, lag(o_orderstatus, 1, '-') {_W} AS c FROM orders")
Q.both("f04_values", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS a, last_value(o_totalprice) OVER w AS b, nth_value(o_totalprice, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
Q.both("f05_aggregates", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DECIMAL(38,2)) AS s, max(o_totalprice) OVER () AS m FROM orders")
Q.both("f06_null_order", "SELECT id, CAST(row_number() OVER (ORDER BY i NULLS LAST, id) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY i DESC NULLS LAST, id) AS BIGINT) AS b, CAST(row_number() OVER (ORDER BY i NULLS FIRST, id) AS BIGINT) AS c FROM probe")


@Q.frame("f07_frames", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS r, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS BIGINT) RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) AS g, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS d FROM orders")
def frames(t):
    """Doubles are rounded, not cut, when they become integers; NULLs come last."""
    key = Window.partitionBy("o_custkey")
    day = key.orderBy(F.col("o_orderdate").asc_nulls_last())
    dated = key.orderBy(F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last())
    priced = key.orderBy(double_to_int(F.col("o_totalprice"), "bigint").asc_nulls_last())
    rows = F.sum(double_to_decimal(F.col("o_totalprice"), 18, 2)).over(dated.rowsBetween(-2, 0)).cast("decimal(38,2)")
    n = F.count(F.lit(1))
    return t.orders.select("o_orderkey", rows.alias("r"), n.over(priced.rangeBetween(-50000, 50000)).alias("g"), n.over(day).alias("d"))


@Q.frame("f08_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def groups_frame(t):
    return shapes.groups_frame(t.part, ["p_brand"], "p_size", F.count(F.lit(1)), 1, 1, "n").select("p_partkey", "n")


@Q.frame("f09_last_ignore_nulls", "SELECT id, last_value(i IGNORE NULLS) OVER (ORDER BY id) AS a FROM probe")
def last_ignore(t):
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return probe(t).select("id", F.last("i", ignorenulls=True).over(w).alias("a"))


@Q.frame("f10_window_filter", "SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts) AS errors FROM events")
def window_filter(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select("event_id", F.count(F.when(F.col("event_type") == "error", 1)).over(w).alias("errors"))


@Q.frame("f10_exclude_current", "SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS m FROM supplier")
def exclude_current(t):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return t.supplier.select("s_suppkey", F.greatest(F.max("s_acctbal").over(before), F.max("s_acctbal").over(after)).alias("m"))


Q.both("f11_named_window", "SELECT s_suppkey, CAST(row_number() OVER w AS BIGINT) AS rn, max(s_acctbal) OVER w AS m FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
Q.both("f12_window_over_aggregate", "WITH m AS (SELECT date_trunc('month', o_orderdate) AS mon, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT mon, n, CAST(rank() OVER (ORDER BY n DESC, mon) AS BIGINT) AS rk FROM m) SELECT CAST(mon AS DATE) AS mon, n, rk, n - lag(n) OVER (ORDER BY mon) AS change FROM r")

# -- order, sets, recursion, pivots --------------------------------------------------------------------------------
Q.both("g01_order_by", "SELECT id, i, s FROM probe ORDER BY i DESC NULLS LAST, s NULLS LAST, id")
Q.both("g02_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")


@Q.frame("g03_top_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_per_group(t):
    return shapes.top_per_group(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], ["-p_retailprice", "p_partkey"], 3)


Q.both("g04_distinct", "SELECT DISTINCT p_type, p_brand FROM part")


@Q.frame("g05_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(t):
    return shapes.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["-o_orderdate", "o_orderkey"], grain=["o_orderkey"])


Q.both("h01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
Q.both("h01_union_all", "SELECT 'c' AS t, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier UNION ALL SELECT 'n', n_nationkey FROM nation")
Q.both("h02_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
Q.both("h02_except", "SELECT p_size AS k FROM part EXCEPT SELECT CAST(l_linenumber AS INT) FROM lineitem")
Q.both("h02_intersect_all", "SELECT p_type AS k FROM part WHERE p_size < 20 INTERSECT ALL SELECT p_type FROM part WHERE p_size > 25")
Q.both("h02_except_all", "SELECT p_type AS k FROM part EXCEPT ALL SELECT p_type FROM part WHERE p_size > 10")


@Q.frame("h03_union_by_name", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL BY NAME SELECT s_acctbal AS bal, s_suppkey AS k FROM supplier")
def union_by_name(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


_HALVES = "WITH RECURSIVE r(n, path) AS (SELECT CAST(24 AS BIGINT), CAST('24' AS STRING) UNION ALL SELECT n {0} 2, path || '>' || CAST(n {0} 2 AS STRING) FROM r WHERE n > 0) SELECT n, path FROM r"
Q.sql("h04_recursive_union_all", _HALVES.format("div"), _HALVES.format("//"))


@Q.frame("h05_recursive_union", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation UNION SELECT r.a, (n_nationkey * 7 + 3) % 25 FROM r JOIN nation ON r.b = n_nationkey) SELECT a, b FROM r")
def recursive_union(t):
    edge = t.nation.select(F.col("n_nationkey").alias("x"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("y"))
    return recursive.recursive_union(edge.toDF("a", "b"), lambda new: new.join(edge, new["b"] == edge["x"]).select(new["a"], edge["y"]))


@Q.frame("h06_recursive_types", "WITH RECURSIVE r(k, d, p) AS (SELECT n_nationkey, CAST(1 AS DECIMAL(12,4)), n_name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey, CAST(d / 2 AS DECIMAL(12,4)), p || '/' || n_name FROM r JOIN nation ON n_nationkey = k * 2 + 3 ) SELECT k, d, p FROM r")
def recursive_types(t):
    start = t.nation.where("n_nationkey < 3").select(F.col("n_nationkey").alias("k"), F.lit(1).cast("decimal(12,4)").alias("d"), F.col("n_name").alias("p"))
    n = t.nation
    return recursive.recursive_union_all(start, lambda r: r.join(n, n["n_nationkey"] == r["k"] * 2 + 3).select("n_nationkey", (F.col("d").cast("double") / 2).cast("decimal(12,4)"), F.concat("p", F.lit("/"), "n_name")))


Q.both("h07_ctes", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS c FROM a GROUP BY n) SELECT n, c, CAST(sum(c) OVER (ORDER BY n) AS BIGINT) AS running FROM b")


@Q.frame("i01_pivot", "SELECT * FROM (PIVOT (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(o_orderkey) GROUP BY o_orderpriority)")
def pivot(t):
    return shapes.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", {"n": F.count("o_orderkey")}, ["F", "O", "P"]).na.fill(0)


@Q.frame("i01_pivot_two_aggregates", "SELECT * FROM (PIVOT (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) ON l_linestatus IN ('F', 'O') USING count(*) AS n, max(l_quantity) AS m GROUP BY l_returnflag)")
def pivot_two(t):
    return shapes.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", {"n": F.count(F.lit(1)), "m": F.max("l_quantity")}, ["F", "O"])


@Q.frame("i02_unpivot", "UNPIVOT (SELECT id, i, j FROM probe) ON i, j INTO NAME k VALUE v")
def unpivot(t):
    return shapes.unpivot(probe(t).select("id", "i", "j"), ["id"], ["i", "j"], "k", "v")


@Q.frame("i03_dynamic_pivot", "SELECT * FROM (PIVOT (SELECT user_id, event_type, event_id FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(event_id) GROUP BY user_id)")
def dynamic_pivot(t):
    return shapes.pivot(t.events, ["user_id"], "event_type", {"n": F.count("event_id")}).na.fill(0)
