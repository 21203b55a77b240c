"""Loads, inputs, macros, graphs, offline runs, comparison and streams, as queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import compare, graph, loads, models, planner, refresh, runner
from .. import session
from ..session import Tables
from ..streaming import windows
from .registry import Registry

Q = Registry()


def shared_folder(t: Tables) -> str:
    return session.shared_folder(t.spark, "loads")


def _changed(t: Tables) -> DataFrame:
    """A tenth of the orders with another price, and some new ones."""
    old = t.orders.where("o_orderkey % 10 = 3").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    new = t.orders.where("o_orderkey % 100 = 7").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return old.unionAll(new)


_CHANGED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 = 7"


@Q.frame("n01_full_replace", "SELECT * FROM nation WHERE n_regionkey = 2")
def full_replace(t):
    table = loads.Table(t.spark, shared_folder(t))
    loads.full_replace(table, t.nation)
    loads.full_replace(table, t.nation.where("n_regionkey = 2"))
    return table.read()


@Q.frame("n02_delete_insert_by_key", f"WITH s AS ({_CHANGED}) SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s")
def delete_insert(t):
    table = loads.Table(t.spark, shared_folder(t))
    loads.full_replace(table, t.orders)
    loads.delete_insert_by_key(table, _changed(t), ["o_orderkey"])
    return table.read()


@Q.frame("n03_merge_by_key", f"WITH s AS ({_CHANGED}) SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s")
def merge(t):
    table = loads.Table(t.spark, shared_folder(t))
    loads.full_replace(table, t.orders)
    for _ in range(2):  # a second run changes nothing
        loads.merge_by_key(table, _changed(t), ["o_orderkey"])
    return table.read()


@Q.frame("n04_delete_insert_by_range", "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def delete_insert_range(t):
    table, base = loads.Table(t.spark, shared_folder(t)), t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    loads.full_replace(table, base)
    loads.delete_insert_by_range(table, base.withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderdate", dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1), dt.timedelta(days=400))
    return table.read()


@Q.frame("n05_watermark_append", "SELECT event_id, ts, value FROM events")
def watermark_append(t):
    table, base = loads.Table(t.spark, shared_folder(t)), t.events.select("event_id", "ts", "value")
    loads.watermark_append(table, base.where("ts < TIMESTAMP_NTZ'2024-01-10 00:00:00'"), "ts")
    loads.watermark_append(table, base.where("ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'"), "ts")
    loads.watermark_append(table, base, "ts")
    return table.read()


@Q.frame("n05_watermark_lookback", "SELECT event_id, ts, CASE WHEN ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20') - INTERVAL 2 DAY THEN value + 1 ELSE value END AS value FROM events")
def watermark_lookback(t):
    table, base = loads.Table(t.spark, shared_folder(t)), t.events.select("event_id", "ts", "value")
    loads.watermark_append(table, base.where("ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'"), "ts")
    loads.watermark_append(table, base.withColumn("value", F.col("value") + 1), "ts", lookback="2 days")
    return table.read()


@Q.frame("n06_durations", "SELECT r_regionkey, TIMESTAMP '2024-03-31 10:00:00' - INTERVAL 1 MONTH AS m, TIMESTAMP '2024-03-31 10:00:00' - INTERVAL 90 MINUTE AS h, CAST(DATE '2024-03-31' - INTERVAL 2 WEEK AS DATE) AS w FROM region")
def durations(t):
    at, d = F.lit("2024-03-31 10:00:00").cast("timestamp_ntz"), F.lit("2024-03-31").cast("date")
    back = lambda text, c, date=False: loads.Lookback.parse(text).before(c, date)
    return t.region.select("r_regionkey", back("1 month", at).alias("m"), back("90 minutes", at).alias("h"), back("2 weeks", d, True).alias("w"))


@Q.frame("n07_implicit_load", "SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer")
def implicit_load(t):
    table = loads.Table(t.spark, shared_folder(t))
    model = models.Model("customer", kind="incremental_by_unique_key", grain=["c_custkey"])
    loads.implicit_load(table, model, t.customer)
    loads.implicit_load(table, model, t.customer.withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return table.read()


@Q.frame("n08_copy_slices", "SELECT o_orderkey, o_totalprice, 'a' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice + 1, 'b' FROM orders WHERE o_orderstatus = 'O'")
def copy_slices(t):
    table, base = loads.Table(t.spark, shared_folder(t)), t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    part = lambda s, add=0: base.where(F.col("o_orderstatus") == s).select("o_orderkey", (F.col("o_totalprice") + add).alias("o_totalprice"))
    loads.copy_slices(table, {"a": part("F"), "b": part("O")}, "origin")
    loads.copy_slices(table, {"b": part("O", 1)}, "origin")
    return table.read()


@Q.frame("n09_view", "SELECT n_name FROM nation WHERE n_regionkey = 4")
def view(t):
    loads.implicit_load(None, models.Model("mart.v_nation", kind="view"), t.nation.where("n_regionkey = 4"))
    return t.spark.sql("SELECT n_name FROM mart_v_nation")


@Q.frame("o01_inputs_resolvers", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def inputs(t):
    t.views("orders")
    known = refresh.resolve_inputs(
        t.spark, [refresh.Input("days", "INTEGER", 30), refresh.Input("top", "TIMESTAMP")],
        [refresh.Resolver(["top"], "SELECT max(o_orderdate) AS top FROM orders", on_null="skip_load")], {},
    )
    since = known["top"] - dt.timedelta(days=known["days"])
    return t.orders.where(F.col("o_orderdate") >= F.lit(since)).agg(F.count(F.lit(1)).alias("n"))


@Q.frame("o04_parameters", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def parameters(t):
    t.views("customer")
    text, args = models.bind("SELECT c_custkey, c_acctbal FROM ${project.source} WHERE c_mktsegment = ${model.segment} AND c_acctbal > ${model.least}", {"project": {"source": "customer"}, "model": {"segment": "BUILDING", "least": 5000}}, frozenset({"project.source"}))
    return t.spark.sql(text, args=args)


@Q.frame("o05_scalar_macros", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,2)) AS net FROM lineitem")
def scalar_macros(t):
    t.views("lineitem")
    made = [models.Macro("net_price", {"p": "DOUBLE", "d": "DOUBLE"}, "money(p * (1 - d))"), models.Macro("money", {"x": "DOUBLE"}, "CAST(sign(x) * floor(abs(x) * 100 + 0.5) / 100 AS DECIMAL(18,2))")]
    models.create_macros(t.spark, made)
    return t.spark.sql("SELECT l_orderkey, l_linenumber, net_price(l_extendedprice, l_discount) AS net FROM lineitem")


@Q.frame("o06_table_macros", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def table_macros(t):
    t.views("nation", "region")
    models.create_macros(t.spark, [models.Macro("nations_of", {"name": "VARCHAR"}, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = name", table=True)])
    return t.spark.sql("SELECT * FROM nations_of('ASIA')")


def project() -> list[models.Model]:
    col = models.Column
    return [
        models.Model("raw.orders", columns=[col("id", "INTEGER", False), col("user_id", "INTEGER", False), col("order_date", "DATE"), col("status", "VARCHAR(20)")], grain=["id"], kind="mapped", tags=["raw"]),
        models.Model("raw.payments", columns=[col("id", "INTEGER", False), col("order_id", "INTEGER", False), col("amount_cents", "INTEGER")], grain=["id"], kind="mapped", tags=["raw"]),
        models.Model("mart.paid", "SELECT order_id, sum(amount_cents) AS cents FROM raw_payments GROUP BY order_id", columns=[col("order_id", "INTEGER"), col("cents", "BIGINT")], reads=["raw.payments"], kind="full"),
        models.Model("mart.orders", "SELECT o.id, o.status, coalesce(p.cents, 0) AS cents FROM raw_orders o LEFT JOIN mart_paid p ON p.order_id = o.id", columns=[col("id", "INTEGER"), col("status", "VARCHAR"), col("cents", "BIGINT")], reads=["raw.orders", "mart.paid"], kind="incremental_by_unique_key", grain=["id"], tags=["mart"]),
        models.Model("mart.report", "SELECT status, count(*) AS n FROM mart_orders GROUP BY status", columns=[col("status", "VARCHAR"), col("n", "BIGINT")], reads=["mart.orders"], tags=["mart"]),
    ]


@Q.frame("p01_graph_levels", "SELECT * FROM (VALUES ('raw.orders', 0), ('raw.payments', 0), ('mart.paid', 1), ('mart.orders', 2), ('mart.report', 3)) AS v(model, level)")
def graph_levels(t):
    return t.spark.createDataFrame(list(graph.Graph(project()).levels().items()), "model string, level int")


@Q.frame("p02_selectors", "SELECT * FROM (VALUES ('+mart.orders', 'mart.orders,mart.paid,raw.orders,raw.payments'), ('raw.payments+1', 'mart.paid,raw.payments'), ('tag:mart,kind:view', 'mart.report'), ('@mart.paid', 'mart.orders,mart.paid,mart.report,raw.orders,raw.payments')) AS v(selector, models)")
def selectors(t):
    g = graph.Graph(project())
    return t.spark.createDataFrame([(s, ",".join(sorted(g.select(s)))) for s in ("+mart.orders", "raw.payments+1", "tag:mart,kind:view", "@mart.paid")], "selector string, models string")


@Q.frame("p03_lineage", "SELECT * FROM (VALUES ('c_name', 'c_name'), ('total', 'o_totalprice'), ('share', 'c_acctbal,o_totalprice'), ('key', 'c_custkey,o_custkey')) AS v(output, inputs)")
def lineage(t):
    t.views("orders", "customer")
    df = t.spark.sql(
        "WITH o AS (SELECT * FROM orders), k AS (SELECT o_custkey AS k FROM o UNION ALL SELECT c_custkey FROM customer) "
        "SELECT c_name, sum(o_totalprice) AS total, max(o_totalprice / c_acctbal) AS share, max(k) AS key FROM o JOIN customer ON o_custkey = c_custkey JOIN k ON k = c_custkey GROUP BY c_name"
    )
    return t.spark.createDataFrame([(k, ",".join(v)) for k, v in graph.lineage(df).items()], "output string, inputs string")


@Q.frame("p04_slice_pushdown", "SELECT * FROM (VALUES ('plain', ''), ('aggregate', 'aggregate_output'), ('key', ''), ('limit', 'limit'), ('other_side', ''), ('cte', 'aggregate_output,limit'), ('distinct_on', 'distinct_on'), ('distinct', ''), ('union', 'limit'), ('window', 'window_partition'), ('window_value', 'window_output'), ('window_key', '')) AS v(shape, blockers)")
def slices(t):
    from pyspark.sql import Window

    t.views("orders")
    o = t.orders
    made = {
        "plain": (o.where("o_totalprice > 1"), "o_orderstatus"), "aggregate": (o.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s")), "s"), "limit": (o.limit(5), "o_orderstatus"),
        "window": (o.select("o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rn")), "o_orderstatus"),
        "window_value": (o.select(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rn")), "rn"),
        "window_key": (o.select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rn")), "o_custkey"),
        "key": (o.groupBy((F.col("o_custkey") + 1).alias("k")).count(), "k"),
        "distinct_on": (o.dropDuplicates(["o_custkey"]), "o_orderstatus"), "distinct": (o.select("o_orderstatus", "o_custkey").distinct(), "o_custkey"),
        "union": (o.select("o_orderstatus").union(o.limit(3).select("o_orderpriority")), "o_orderstatus"),
        "other_side": (o.join(t.customer.limit(5).select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")), "o_orderstatus"),
        "cte": (t.spark.sql("WITH a AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey), b AS (SELECT top * 2 AS twice FROM a LIMIT 5) SELECT twice FROM b"), "twice"),
    }
    return t.spark.createDataFrame([(k, ",".join(graph.slice_blockers(df, c))) for k, (df, c) in made.items()], "shape string, blockers string")


@Q.frame("p06_refresh", "SELECT * FROM (VALUES ('raw.orders', 'ok'), ('raw.payments', 'failed: broken'), ('mart.paid', 'skipped: raw.payments is not loaded'), ('mart.orders', 'skipped: mart.paid is not loaded'), ('mart.report', 'skipped: mart.orders is not loaded')) AS v(model, state)")
def refresh_states(t):
    def load(m):
        if m.name == "raw.payments":
            raise RuntimeError("broken")

    return t.spark.createDataFrame(list(refresh.refresh(project(), load, parallel=2).items()), "model string, state string")


@Q.frame("p08_schema_changes", "SELECT * FROM (VALUES ('add', 'd', 'safe'), ('rename', 'b', 'safe'), ('widen', 'a', 'safe'), ('narrow', 'c', 'lossy'), ('drop', 'z', 'destructive')) AS v(action, col, risk)")
def schema_changes(t):
    from pyspark.sql import types as T

    make = lambda **f: T.StructType([T.StructField(n, x) for n, x in f.items()])
    have = make(a=T.IntegerType(), old=T.StringType(), c=T.DoubleType(), z=T.DateType())
    want = make(a=T.LongType(), b=T.StringType(), c=T.IntegerType(), d=T.DateType())
    return t.spark.createDataFrame([(x.action, x.column, x.risk) for x in refresh.schema_changes(want, have, {"b": "old"})], "action string, col string, risk string")


def _mart() -> list[models.Model]:
    c = models.Column
    return [
        models.Model("customer", "SELECT * FROM raw.customer", [c("c_custkey", "BIGINT"), c("c_name", "VARCHAR"), c("c_vip", "BOOLEAN")], ["c_custkey"], "full"),
        models.Model("orders", "SELECT * FROM raw.orders", [c("o_orderkey", "DECIMAL(20,0)"), c("o_custkey", "BIGINT"), c("o_state", "VARCHAR"), c("o_totalprice", "DOUBLE")], ["o_orderkey"], "incremental_by_unique_key"),
        models.Model("nation", "SELECT * FROM raw.nation", kind="full"),
        models.Model("region", "SELECT * FROM raw.region", kind="full"),
        models.Model("spent", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", kind="view", reads=["orders"]),
        models.Model("report", "SELECT * FROM customer JOIN spent ON o_custkey = c_custkey", kind="full", reads=["customer", "spent"]),
    ]


@Q.frame("p08_plan", """
WITH c AS (SELECT column_name AS n FROM (DESCRIBE customer)), o AS (SELECT column_name AS n FROM (DESCRIBE orders)), fixed(model, result, rule, risk, detail) AS (VALUES
  ('customer', 'question', 'history', 'safe', 'c_vip'), ('customer', 'ddl', 'add', 'safe', 'c_vip'), ('nation', 'question', 'adopt', 'safe', ''), ('region', 'block', 'not adopted', 'safe', ''),
  ('orders', 'ddl', 'widen', 'safe', 'o_orderkey'), ('orders', 'ddl', 'rename', 'safe', 'o_state'), ('orders', 'load', 'routine', 'safe', ''), ('spent', 'ddl', 'create', 'safe', ''), ('report', 'skip', 'upstream', 'safe', 'customer'))
SELECT * FROM fixed UNION ALL SELECT 'customer', 'ddl', 'drop', 'destructive', n FROM c WHERE n NOT IN ('c_custkey', 'c_name')
UNION ALL SELECT 'orders', 'ddl', 'drop', 'destructive', n FROM o WHERE n NOT IN ('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice')""")
def planned(t):
    """The tables' own schemas against models that declare other columns."""
    live = {n: getattr(t, n).schema for n in ("customer", "orders", "nation", "region")}
    recorded = {m.name: planner.Recorded(refresh.shape_hash(live[m.name]), planner.definition_hash(m)) for m in _mart() if m.name in ("customer", "orders")}
    answers = planner.Answers(adopt={"region": False}, renames={"orders": {"o_state": "o_orderstatus"}})
    steps = planner.plan(_mart(), live, recorded, answers)
    return t.spark.createDataFrame([(s.model, s.result, s.rule, s.risk, s.detail) for s in steps], "model string, result string, rule string, risk string, detail string")


@Q.frame("p10_recorded_run", """
SELECT 'customer' AS model, 'ok' AS state, count(*) AS n_rows, 0 AS above FROM customer UNION ALL SELECT 'orders', 'ok', count(*), 0 FROM orders UNION ALL SELECT 'nation', 'ok', count(*), 0 FROM nation
UNION ALL SELECT 'region', 'failed: no region', NULL, 0 UNION ALL SELECT 'spent', 'ok', count(DISTINCT o_custkey), 1 FROM orders
UNION ALL SELECT 'report', 'ok', count(*), 3 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def recorded_run(t):
    """A run over whole tables, read back from the tracking tables: states, rows loaded and models needed."""
    folder = f"{shared_folder(t)}/tracking-{uuid.uuid4().hex}"
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))

    def load(m):
        if m.name == "region":
            raise RuntimeError("no region")
        return spent if m.name == "spent" else t.customer.join(spent, F.col("o_custkey") == F.col("c_custkey")) if m.name == "report" else getattr(t, m.name)

    refresh.recorded_refresh(t.spark, folder, _mart(), load)
    above = refresh.tracked(t.spark, folder, "dependencies").groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("above"))
    ran = refresh.tracked(t.spark, folder, "run_models").join(above, "model", "left")
    return ran.select("model", "state", F.col("rows").alias("n_rows"), F.coalesce("above", F.lit(0)).alias("above"))


@Q.frame("q01_sample_run")
def sample_run(t):
    run = runner.SampleRun(t.spark, project(), seed=3)
    state = run.run()
    return t.spark.createDataFrame([(m, s, run.results[m].count() if m in run.results else -1) for m, s in state.items()], "model string, state string, n long")


@Q.frame("q03_seeds")
def seeds(t):
    return runner.seeded(t.spark, 1000, lambda i: {"i": i, "r": runner.rnd(i, "price", 1), "k": runner.pick(i, "kind", 5, 1)})


@Q.frame("q04_model_test", "SELECT 'orders without payments' AS name, 0 AS problems")
def model_test(t):
    case = runner.Case(
        "orders without payments", {"raw.orders": [{"id": 1, "user_id": 1, "status": "new"}, {"id": 2, "user_id": 1}], "raw.payments": [{"id": 1, "order_id": 1, "amount_cents": 250}, {"id": 2, "order_id": 1, "amount_cents": 50}]},
        expect=[{"id": 1, "status": "new", "cents": 300}, {"id": 2, "status": None, "cents": 0}], violations="SELECT * FROM result WHERE cents < 0",
    )
    return t.spark.createDataFrame([(case.name, len(runner.run_case(t.spark, project(), "mart.orders", case)))], "name string, problems int")


@Q.frame("q05_metadata_rules", "SELECT 'models have a grain' AS rule, count(*) AS n FROM (VALUES (1), (2)) v(x)")
def metadata_rules(t):
    rule = runner.Rule("models have a grain", "SELECT model FROM meta_models WHERE model NOT IN (SELECT model FROM meta_grain)")
    return runner.run_rules(t.spark, project(), [rule]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.orders
    right = t.orders.where("o_orderkey % 97 <> 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return left, right.unionAll(t.orders.where("o_orderkey % 500 = 2").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


_VERSIONS = "l AS (SELECT * FROM orders), r AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 5 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 500 = 2)"


@Q.frame("r02_keyed_diff", f"WITH {_VERSIONS} SELECT count(*) FILTER (WHERE r.o_orderkey IS NULL) AS only_left, count(*) FILTER (WHERE l.o_orderkey IS NULL) AS only_right, count(*) FILTER (WHERE l.o_orderkey = r.o_orderkey) AS matched, count(*) FILTER (WHERE l.o_totalprice <> r.o_totalprice) AS differing, CAST(0 AS BIGINT) AS d_o_custkey, CAST(0 AS BIGINT) AS d_o_orderstatus, count(*) FILTER (WHERE l.o_totalprice <> r.o_totalprice) AS d_o_totalprice, CAST(0 AS BIGINT) AS d_o_orderdate, CAST(0 AS BIGINT) AS d_o_orderpriority FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey")
def keyed_diff(t):
    return compare.keyed_summary(*_versions(t), ["o_orderkey"])


@Q.frame("r03_differing_rows", f"WITH {_VERSIONS} SELECT l.o_orderkey, l.o_totalprice AS l_o_totalprice, r.o_totalprice AS r_o_totalprice FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE l.o_totalprice <> r.o_totalprice")
def differing(t):
    return compare.differing_rows(*_versions(t), ["o_orderkey"]).select("o_orderkey", "l_o_totalprice", "r_o_totalprice")


@Q.frame("r03_column_stats", "SELECT 'n_nationkey' AS \"column\", count(n_nationkey) AS nonnull, CAST(min(n_nationkey) AS VARCHAR) AS least, CAST(max(n_nationkey) AS VARCHAR) AS greatest FROM nation UNION ALL SELECT 'n_name', count(n_name), min(n_name), max(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation")
def column_stats(t):
    return compare.column_stats(t.nation)


@Q.frame("r04_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return compare.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@Q.frame("r05_digest_diff", f"WITH {_VERSIONS} SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN r.o_orderkey IS NULL THEN 'only_left' WHEN l.o_orderkey IS NULL THEN 'only_right' ELSE 'differs' END AS status, CASE WHEN l.o_orderkey = r.o_orderkey THEN 'o_totalprice' ELSE '' END AS columns FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_totalprice <> r.o_totalprice")
def digest_diff(t):
    return compare.digest_diff(*_versions(t), ["o_orderkey"])


@Q.frame("r05_digest_diff_null_keys", "WITH l AS (SELECT c_nationkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k FROM customer), r AS (SELECT c_nationkey, CASE WHEN c_custkey % 10 = 3 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) SELECT k, 'only_left' AS status, '' AS columns FROM l WHERE k IS NULL UNION ALL SELECT k, 'only_right', '' FROM r WHERE k IS NULL UNION ALL SELECT l.k, 'differs', 'c_name' FROM l JOIN r ON l.k = r.k WHERE l.c_name <> r.c_name")
def digest_diff_null_keys(t):
    left = t.customer.select("c_nationkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("k"))
    right = t.customer.select("c_nationkey", F.when(F.col("c_custkey") % 10 == 3, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("k"))
    return compare.digest_diff(left, right, ["k"])


_AGG = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total"


@Q.frame("s01_tumbling", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, {_AGG} FROM events GROUP BY ALL")
def tumbling(t):
    return windows.tumbling(t.events, "ts", "1 hour", ["event_type"])


@Q.frame("s02_sliding", f"SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, {_AGG} FROM (SELECT value, unnest([time_bucket(INTERVAL '15 minutes', ts) - to_minutes(k * 15) for k in [0, 1, 2, 3]]) AS w FROM events) GROUP BY ALL")
def sliding(t):
    return windows.sliding(t.events, "ts", "1 hour", "15 minutes")


@Q.frame("s03_sessions", f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, {_AGG} FROM k GROUP BY user_id, s")
def sessions(t):
    return windows.sessions(t.events, "ts", "6 hours", ["user_id"])


@Q.frame("s04_streamed_tumbling", f"WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY AS window_end, event_type, {_AGG} FROM events GROUP BY ALL) SELECT * FROM w")
def streamed(t):
    folder = shared_folder(t)
    name = f"loom_{uuid.uuid4().hex}"
    source = f"{folder}/in"
    t.events.repartition(2).write.parquet(source)
    made = windows.tumbling(windows.stream(t.spark, source, t.events.schema), "ts", "1 day", ["event_type"], late="40 days")
    return windows.run_to_end(made, name, f"{folder}/state", mode="complete")


@Q.frame("s05_streamed_dedup", "SELECT DISTINCT event_id FROM events")
def streamed_dedup(t):
    folder = shared_folder(t)
    t.events.unionAll(t.events.where("event_id % 3 = 0")).repartition(2).write.parquet(f"{folder}/in")
    made = windows.deduplicated(windows.stream(t.spark, f"{folder}/in", t.events.schema), "ts", ["event_id"], late="40 days").select("event_id")
    return windows.run_to_end(made, f"loom_{uuid.uuid4().hex}", f"{folder}/state")


@Q.frame("s06_streamed_load", "SELECT event_id, ts, value FROM events")
def streamed_load(t):
    folder = shared_folder(t)
    t.events.select("event_id", "ts", "value").repartitionByRange(3, "ts").write.parquet(f"{folder}/in")
    table = loads.Table(t.spark, f"{folder}/table")
    source = windows.stream(t.spark, f"{folder}/in", t.events.select("event_id", "ts", "value").schema)
    windows.load_each_batch(source, f"{folder}/state", lambda df, _: loads.delete_insert_by_key(table, df, ["event_id"]))
    return table.read()


@Q.frame("s07_streamed_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def streamed_state(t):
    folder = shared_folder(t)
    t.events.select("user_id", "value").coalesce(1).write.parquet(f"{folder}/in")
    made = windows.running_totals(windows.stream(t.spark, f"{folder}/in", t.events.select("user_id", "value").schema), "user_id", "value")
    from ..functions.numeric import round_double

    return windows.run_to_end(made, f"loom_{uuid.uuid4().hex}", f"{folder}/state", mode="update").withColumn("total", round_double(F.col("total"), 4))


@Q.frame("q02_generated_samples")
def generated(t):
    return runner.generated(t.spark, project()[0], rows=40, seed=11)


@Q.frame("b01_columns_by_rule", "SELECT p_name, p_brand, p_type FROM part")
def columns_by_rule(t):
    return t.part.select(*[c for c, kind in t.part.dtypes if kind == "string"])


