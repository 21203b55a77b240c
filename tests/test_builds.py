"""Loads, models, runs and comparison on small fixtures."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import joins, recursive, shapes
from sparkloom.plans import compare, graph, loads, models, refresh, runner, types
from sparkloom.plans.models import Column, Model
from sparkloom.streaming import windows

EVENTS = "event_id long, event_ts timestamp_ntz, amount decimal(14,2), label string"


def at(d, h=0, m=0, s=0, month=1, year=2024):
    return dt.datetime(year, month, d, h, m, s)


# fixed values: the load fixture
SOURCE = [
    (1, at(1), Decimal("10.00"), "a"), (2, at(2, 12), Decimal("20.50"), "b"), (3, at(3), None, "c"), (4, at(4, 8, 30, 15), Decimal("40.00"), None), (5, at(4, 23, 59, 59), Decimal("50.00"), "é"),
    (6, at(5), Decimal("60.00"), "f"), (7, at(6), Decimal("70.00"), "g"), (8, at(6), Decimal("80.00"), "h"), (9, at(7, 10), Decimal("90.25"), "i"), (10, at(8), Decimal("100.00"), "j"),
]
TARGET = [(2, at(2, 12), Decimal(999), "stale"), (4, at(4, 8, 30, 15), Decimal(999), "stale"), (99, at(4, 12), Decimal(1), "orphan in range"), (98, at(31, month=12, year=2023), Decimal(2), "old"), (6, at(5), Decimal(6), "keepme")]
LATE = [(11, at(7, 5), Decimal(11), "late-in-window"), (12, at(1, 6), Decimal(12), "late-old")]
POISON = [(666, at(9), Decimal(2_000_000), "poison")]


@pytest.fixture
def table(spark, tmp_path):
    t = loads.Table(spark, str(tmp_path / "t"))
    loads.full_replace(t, spark.createDataFrame(TARGET, EVENTS))
    return t


def ids(t):
    return sorted(r[0] for r in t.read().select("event_id").collect())


def test_each_load_is_idempotent(spark, table):
    source = spark.createDataFrame(SOURCE, EVENTS)
    cases = [
        (lambda: loads.delete_insert_by_key(table, source, ["event_id"]), [*range(1, 11), 98, 99]), (lambda: loads.merge_by_key(table, source, ["event_id"]), [*range(1, 11), 98, 99]),
        (lambda: loads.delete_insert_by_range(table, source, "event_ts", at(3), at(5)), None), (lambda: loads.full_replace(table, source), [*range(1, 11)]),
    ]
    for load, want in cases:
        loads.full_replace(table, spark.createDataFrame(TARGET, EVENTS))
        load()
        once = ids(table)
        load()
        assert ids(table) == once == (want or [2, 3, 4, 5, 6, 98])


def test_range_keeps_its_end(spark, table):
    loads.delete_insert_by_range(table, spark.createDataFrame(SOURCE, EVENTS), "event_ts", at(3), at(5))
    assert table.read().where("event_id = 6").first()["label"] == "keepme"
    with pytest.raises(ValueError):
        loads.delete_insert_by_range(table, table.read(), "event_ts", at(1), at(9), max_span=dt.timedelta(days=2))


def test_null_keys_never_match(spark, tmp_path):
    t = loads.Table(spark, str(tmp_path / "n"))
    loads.full_replace(t, spark.createDataFrame([(None, "x"), (1, "x")], "k int, v string"))
    loads.delete_insert_by_key(t, spark.createDataFrame([(None, "y"), (1, "y")], "k int, v string"), ["k"])
    assert sorted(map(str, t.read().collect())) == sorted(map(str, spark.createDataFrame([(None, "x"), (None, "y"), (1, "y")], "k int, v string").collect()))
    loads.merge_by_key(t, spark.createDataFrame([(None, "z"), (1, "z")], "k int, v string"), ["k"])
    assert t.read().count() == 4


def test_watermark(spark, tmp_path):
    t = loads.Table(spark, str(tmp_path / "w"))
    source = spark.createDataFrame(SOURCE, EVENTS)
    with pytest.raises(ValueError):
        loads.watermark_append(t, source, "event_ts", require=True)
    loads.watermark_append(t, source.where("event_id < 8"), "event_ts", initial=at(2))
    assert ids(t) == [2, 3, 4, 5, 6, 7]
    loads.watermark_append(t, source, "event_ts")
    assert ids(t) == [2, 3, 4, 5, 6, 7, 9, 10]  # 8 has the watermark's own time
    loads.watermark_append(t, source.unionAll(spark.createDataFrame(LATE, EVENTS)), "event_ts", lookback="2 days")
    assert ids(t) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_failed_load_leaves_the_table(spark, table):
    before = ids(table)
    with pytest.raises(Exception):
        loads.delete_insert_by_key(table, spark.createDataFrame(POISON, EVENTS), ["event_id"], check=F.col("amount") < 1_000_000)
    assert ids(table) == before
    loads.full_replace(table, spark.createDataFrame(SOURCE, EVENTS))
    assert table.vacuum() >= 1 and ids(table) == [*range(1, 11)]


def test_types():
    assert types.normalize("numeric") == "DECIMAL(18,3)" and types.normalize("INT8") == "BIGINT" and types.same("VARCHAR(20)", "text") and not types.same("INTEGER", "BIGINT")
    assert types.to_spark("BIGINT[]") == T.ArrayType(T.LongType()) and types.to_spark("money", {"money": "DECIMAL(12,2)"}) == T.DecimalType(12, 2)


def test_models_and_parameters(spark):
    with pytest.raises(ValueError):
        Model("x", kind="incremental_by_unique_key")
    name, options, body = models.query_head("CREATE TABLE mart.x WITH (kind = full, grain = 'id') AS SELECT 1")
    assert (name, options, body) == ("mart.x", {"kind": "full", "grain": "id"}, "SELECT 1")
    with pytest.raises(ValueError):
        models.bind("SELECT * FROM ${model.t}", {"model": {"t": "x; DROP TABLE y"}}, frozenset({"model.t"}))
    refused = ("DROP TABLE x", "SELECT 1; DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT `reflect`('a', 'b')", "SET x = 1", "FROM a INSERT INTO b SELECT *", "not sql")
    for text in refused:
        with pytest.raises(PermissionError):
            models.read_only(text)
    for text in ("SELECT 1 AS `update`", "SELECT 'DROP TABLE x; reflect(1)' AS a -- delete", "WITH a AS (SELECT 1 AS x) SELECT * FROM a;", "VALUES (1)"):
        assert models.read_only(text) == text
    assert models.query_head("CREATE TABLE x WITH (kind = full, grain = (a, 'b'), tags = t) AS SELECT 1")[1] == {"kind": "full", "grain": "a, b", "tags": "t"}
    a, b = models.Macro("a", {}, "b()"), models.Macro("b", {}, "a()")
    with pytest.raises(ValueError):
        models.macro_order([a, b])


def test_graph_refuses_cycles():
    with pytest.raises(ValueError):
        graph.Graph([Model("a", reads=["b"]), Model("b", reads=["a"])]).order()


def test_inputs(spark):
    r = refresh.Resolver(["x"], "SELECT CAST(NULL AS INT)", on_null="skip_load")
    with pytest.raises(refresh.SkipLoad):
        refresh.resolve_inputs(spark, [refresh.Input("x", "INTEGER")], [r], {})
    assert refresh.resolve_inputs(spark, [refresh.Input("x", "INTEGER")], [r], {"x": 4}) == {"x": 4}
    with pytest.raises(ValueError):
        refresh.Input("x", "SMALLINT").value(40_000)
    with pytest.raises(ValueError):
        refresh.Resolver(["x"], "SELECT 1 UNION ALL SELECT 2").resolve(spark, {})


def test_refresh_stops():
    made = [Model("a"), Model("b", reads=["a"]), Model("c")]

    def load(m):
        if m.name == "a":
            raise RuntimeError("no")

    state = refresh.refresh(made, load, parallel=1, on_failure="stop")
    assert state["a"] == "failed: no" and state["b"].startswith("skipped") and state["c"] == "skipped: the run was stopped"


def test_samples_are_deterministic(spark):
    m = Model("t", columns=[Column("id", "INTEGER", False), Column("s", "VARCHAR"), Column("n", "DECIMAL(10,2)"), Column("d", "DATE")], grain=["id"])
    a, b = runner.generated(spark, m, 50).collect(), runner.generated(spark, m, 50).collect()
    assert a == b and len({r["id"] for r in a}) == 50 and any(r["s"] is None for r in a)


def test_model_case_reports(spark):
    m = [Model("s", columns=[Column("a", "INTEGER")]), Model("m", "SELECT a + 1 AS b FROM s", columns=[Column("b", "INTEGER")], reads=["s"])]
    assert runner.run_case(spark, m, "m", runner.Case("ok", {"s": [{"a": 1}]}, [{"b": 2}])) == []
    assert len(runner.run_case(spark, m, "m", runner.Case("bad", {"s": [{"a": 1}]}, [{"b": 3}]))) == 2


def test_recursion_reaches_a_fixpoint_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, None)], "a int, b int")
    out = recursive.recursive_union(edges, lambda r: r.alias("r").join(edges.alias("e"), F.col("r.b") == F.col("e.a")).select("r.a", "e.b"))
    assert out.count() == 10


def test_distinct_on_needs_the_grain(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        shapes.distinct_on(df, ["k"], ["k"], grain=["v"])


def test_salted_asof_equals_plain(spark):
    left = spark.createDataFrame([(1, at(1, h)) for h in range(0, 24, 3)] + [(2, at(2))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(1, h), h) for h in (2, 5, 20)] + [(2, at(3), 1)], "k int, u timestamp_ntz, v int")
    plain = joins.asof_join(left, right, ["k"], "t", "u", ["v"])
    salted = joins.asof_join(left, right, ["k"], "t", "u", ["v"], salt_seconds=3600 * 4)
    assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty() and plain.where("k = 1 AND v = 5").count() == 5


def test_copy_from_arrow_origin(spark):
    from sparkloom.sources import arrow_origin

    arrow_origin.register(spark)
    df = spark.read.format("arrow_origin").schema("i long, s string").option("module", "tests.origin").option("function", "batches").option("partitions", 3).load()
    assert sorted(r["i"] for r in df.collect()) == [0, 1, 2, 10, 11, 12]
    with pytest.raises(Exception):
        spark.read.format("arrow_origin").schema("l array<int>").option("module", "tests.origin").option("function", "batches").load().collect()


def test_lazy_pushdown(spark):
    """A filter and a projection reach the scan."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def _rows_and_files(table):
    return sorted(tuple(r) for r in table.read().collect()), set(table.manifest()["parts"])


def test_loads_that_break_off_leave_the_table(spark, tmp_path, monkeypatch):
    table = loads.Table(spark, f"{tmp_path}/t")
    loads.full_replace(table, spark.range(10).selectExpr("id", "id AS v"))
    before = _rows_and_files(table)
    monkeypatch.setattr(loads.Table, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        loads.merge_by_key(table, spark.range(5).selectExpr("id", "-id AS v"), ["id"])
    monkeypatch.undo()
    assert _rows_and_files(loads.Table(spark, f"{tmp_path}/t")) == before
    one, two = loads.Table(spark, f"{tmp_path}/t"), loads.Table(spark, f"{tmp_path}/t")
    rows = two.read()
    loads.merge_by_key(one, spark.range(5).selectExpr("id", "-id AS v"), ["id"])
    with pytest.raises(loads.Conflict):
        two.write(rows)
    assert sorted(r["v"] for r in one.read().collect()) == [-4, -3, -2, -1, 0, 5, 6, 7, 8, 9]
    assert one.vacuum() > 0 and one.read().count() == 10


def test_loads_carry_files_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(loads, "CARRIED_FROM", 3)
    table = loads.Table(spark, f"{tmp_path}/t")
    loads.full_replace(table, spark.range(0, 1000, 1, 10).selectExpr("id", "id AS v"))
    files = set(table.manifest()["parts"])
    assert len(files) == 10
    loads.merge_by_key(table, spark.range(10).selectExpr("id", "-id AS v"), ["id"])
    assert len(files & set(table.manifest()["parts"])) == 9
    loads.delete_insert_by_range(table, spark.createDataFrame([(995, 7)], "id long, v long"), "id", 990, 1000)
    assert len(files & set(table.manifest()["parts"])) == 8
    loads.delete_insert_by_key(table, spark.createDataFrame([(5000, 1)], "id long, v long"), ["id"])
    assert len(files & set(table.manifest()["parts"])) == 8
    got = {r["id"]: r["v"] for r in table.read().collect()}
    assert got == {i: -i if i < 10 else i for i in range(990)} | {995: 7, 5000: 1}


def test_merge_refuses_two_rows_of_one_key(spark, tmp_path):
    twice = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "id long, v long")
    table = loads.Table(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        loads.merge_by_key(table, twice, ["id"])
    loads.merge_by_key(table, twice.where("v > 1"), ["id"])
    with pytest.raises(Exception, match="two rows of one key"):
        loads.merge_by_key(table, twice, ["id"])
    assert table.read().count() == 3


def test_digest_diff_of_types_nulls_and_buckets(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 1.0D, NULL, 'a'), (2, -0.0D, 'x', NULL), (3, 3.5D, 'y', 'z'), (NULL, 1D, 'q', 'q') AS t(k, d, s, u)")
    right = spark.sql("SELECT * FROM VALUES (1L, 1.0D, 'a', NULL), (2L, 0.0D, 'x', NULL), (4L, 3.5D, 'y', 'z'), (NULL, 1D, 'q', 'q') AS t(k, d, s, u)")
    got = sorted(((r["k"], r["status"], r["columns"]) for r in compare.digest_diff(left, right, ["k"]).collect()), key=str)
    assert got == sorted([(1, "differs", "s,u"), (3, "only_left", ""), (4, "only_right", ""), (None, "only_left", ""), (None, "only_right", "")], key=str)
    assert compare.bucket_diff(left.dropna(), left.dropna(), ["k"]).count() == 0


def test_planner_decides_by_shape_definition_and_answers():
    from pyspark.sql import types as T

    from sparkloom.plans import planner

    a = models.Model("a", "SELECT 1 AS k", [models.Column("k", "INTEGER"), models.Column("n", "VARCHAR")], ["k"], "incremental_by_unique_key")
    b = models.Model("b", "SELECT * FROM a", kind="full", reads=["a"])
    have = T.StructType([T.StructField("k", T.LongType()), T.StructField("old", T.StringType())])
    was = planner.Recorded(refresh.shape_hash(have), planner.definition_hash(a))
    rules = lambda **kw: [(s.model, s.result, s.rule, s.risk) for s in planner.plan([b, a], **kw)]
    fresh = [("a", "ddl", "create", "safe"), ("a", "load", "routine", "safe"), ("b", "ddl", "create", "safe"), ("b", "load", "routine", "safe")]
    assert rules(live={}, recorded={}) == fresh
    assert rules(live={"a": have}, recorded={}) == [("a", "question", "adopt", "safe"), ("b", "skip", "upstream", "safe")]
    drifted = {"a": planner.Recorded("another shape")}
    assert rules(live={"a": have}, recorded=drifted)[0] == ("a", "block", "drift", "safe")
    renamed = {"a": {"n": "old"}}
    seen = planner.Answers(acknowledged={refresh.shape_hash(have)}, renames=renamed)
    found = rules(live={"a": have}, recorded=drifted, answers=seen)
    assert ("a", "track", "drift acknowledged", "safe") in found and ("a", "ddl", "narrow", "lossy") in found and ("a", "ddl", "rename", "safe") in found
    assert ("a", "block", "rename", "safe") in rules(live={"a": have}, recorded={"a": was}, answers=planner.Answers(renames={"a": {"n": "none"}}))
    other = {"a": planner.Recorded(was.shape, "another query")}
    assert ("a", "block", "definition changed", "safe") in rules(live={"a": have}, recorded=other)
    steps = planner.plan([a], {"a": have}, {"a": was}, planner.Answers(renames=renamed))
    with pytest.raises(PermissionError):
        planner.apply(steps, lambda s: None)
    ran = []
    states = planner.apply(steps, lambda s: ran.append(s.rule) or (1 / 0 if s.rule == "rename" else None), allow="lossy")
    assert [x for _, x in states][-1] == "left out" and "routine" not in ran


def test_runs_and_plans_are_recorded(spark, tmp_path):
    from sparkloom.plans import planner

    folder = f"file://{tmp_path}/tracking"
    a, b = models.Model("a", "SELECT 1 AS k", kind="full"), models.Model("b", "SELECT 2", kind="full", reads=["a"])
    load = lambda m: spark.range(3) if m.name == "a" else 1 / 0
    state = refresh.recorded_refresh(spark, folder, [a, b], load, run_id="r1")
    assert state["a"] == "ok" and state["b"].startswith("failed")
    rows = {r.model: r for r in refresh.tracked(spark, folder, "run_models").collect()}
    assert rows["a"].rows == 3 and rows["b"].rows is None and rows["b"].ended >= rows["b"].started
    assert refresh.tracked(spark, folder, "runs").collect()[0].state == "failed"
    was = refresh.last_recorded(spark, folder)
    assert set(was) == {"a"} and was["a"].shape == refresh.shape_hash(spark.range(1).schema)
    steps = planner.plan([a, b], {"a": spark.range(1).schema, "b": spark.range(1).schema}, was)
    refresh.track_plan(spark, folder, "p1", steps)
    assert [(r.model, r.rule) for r in refresh.tracked(spark, folder, "plan_steps").orderBy("position").collect()] == [("a", "routine"), ("b", "adopt")]
    assert refresh.tracked(spark, folder, "blocks").count() == 0
    spark.createDataFrame([(1, None)], refresh.TRACKING["layout"]).write.mode("overwrite").parquet(f"{folder}/layout")
    with pytest.raises(RuntimeError, match="layout"):
        refresh.track(spark, folder, "locks", [("x", "y", None)])


def test_stream_to_files(spark, tmp_path):
    """Rows of a stream go to files, not to the driver; a later run from the checkpoint adds what is new."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda *keys: spark.createDataFrame([(k, at(1)) for k in keys], "k long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
    run = lambda: windows.run_to_end(windows.deduplicated(windows.stream(spark, source, spark.read.parquet(source).schema), "ts", ["k"]).select("k"), "loom_files", state)
    put(1, 1, 2, None)
    first = run()
    assert first.inputFiles()
    assert sorted(map(str, (r[0] for r in first.collect()))) == ["1", "2", "None"]
    put(2, 3)
    assert sorted(map(str, (r[0] for r in run().collect()))) == ["1", "2", "3", "None"]
    assert spark.table("loom_files").count() == 4


def test_stream_to_files_complete(spark, tmp_path):
    """In complete mode the last batch is the table; where no file is, an empty one."""
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    run = lambda: windows.run_to_end(windows.stream(spark, source, T.StructType().add("k", "long")).groupBy("k").count(), "loom_complete", str(tmp_path / "state"), mode="complete")
    assert run().collect() == []
    for k in (1, 1, 2):
        spark.createDataFrame([(k,)], "k long").coalesce(1).write.mode("append").parquet(source)
    made = run()
    assert made.inputFiles()
    assert sorted(map(tuple, made.collect())) == [(1, 2), (2, 1)]
