"""Registered queries against their DuckDB SQL on small tables with ties, NULLs, NaN and halves."""

import re

import duckdb

from sparkloom import queries

from .test_queries import kinds, rows


def check(spark, tmp_path, name, **tables):
    """tables: column names and the rows of a VALUES list."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table, (columns, values) in tables.items():
        con.execute(f"COPY (SELECT * FROM (VALUES {values}) AS v({columns})) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)
    assert kinds(got) == kinds(want)


def test_arg_max(spark, tmp_path):
    """The first of equal rows; NULL keys and balances don't count; NaN is the greatest and zeros are equal."""
    values = """
        (CAST(5 AS BIGINT), CAST(1 AS DOUBLE), 'ties'), (9, 7, 'ties'), (4, 7, 'ties'), (3, 1, 'ties'), (NULL, 99, 'ties'), (NULL, -9, 'ties'),
        (7, 'inf', 'nan'), (8, 'nan', 'nan'), (6, 'nan', 'nan'), (2, NULL, 'nan'), (14, 0.0, 'zero'), (13, -0.0, 'zero'), (15, 0.0, 'zero'),
        (1, NULL, 'none'), (NULL, 2, 'none'), (21, 3, NULL), (20, 3, NULL)"""
    check(spark, tmp_path, "e24_arg_max", customer=("c_custkey, c_acctbal, c_mktsegment", values))


#: Halves and tenths about the frame's 50,000, NULLs in each column, and prices whose third digit is a five.
ORDERS = """
    (CAST(1 AS BIGINT), CAST(5 AS BIGINT), 'F', CAST(10.5 AS DOUBLE), TIMESTAMP '1995-01-01', 'x'), (2, 5, 'F', 10.5, TIMESTAMP '1995-01-01', 'x'), (NULL, 5, 'F', 10.5, TIMESTAMP '1995-01-02', 'x'),
    (NULL, 5, 'F', 99999.5, NULL, 'x'), (3, 5, 'F', 99999.5, TIMESTAMP '1995-01-03', 'x'), (4, 6, 'F', NULL, NULL, 'x'), (5, 6, 'F', NULL, TIMESTAMP '1995-01-03', 'x'),
    (6, 6, 'F', 50010.5, TIMESTAMP '1995-01-03', 'x'), (7, 6, 'F', 10.4, TIMESTAMP '1995-01-03', 'x'), (8, NULL, 'F', 1.5, TIMESTAMP '1995-01-03', 'x'), (9, NULL, 'F', 50001.6, TIMESTAMP '1995-01-04', 'x'),
    (10, 7, 'F', -0.5, TIMESTAMP '1995-01-04', 'x'), (11, 7, 'F', -50000.6, TIMESTAMP '1995-01-04', 'x'), (12, 7, 'F', 2.675, NULL, 'x'), (13, 7, 'F', 1.005, TIMESTAMP '1995-01-04', 'x'),
    (14, 7, 'F', 1e6, NULL, 'x'), (NULL, 8, 'F', 3.0, NULL, 'x'), (15, 8, 'F', 3.0, NULL, 'x')"""
COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def test_frames(spark, tmp_path):
    check(spark, tmp_path, "f07_frames", orders=(COLUMNS, ORDERS))


def test_frames_round(spark, tmp_path):
    """Between 0.6 and 50000.6 lie 50,000 in whole numbers, between 0.4 and 50000.6 more."""
    values = "(CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'F', CAST(0.6 AS DOUBLE), TIMESTAMP '1995-01-01', 'x'), (2, 1, 'F', 50000.6, TIMESTAMP '1995-01-02', 'x'), (3, 2, 'F', 0.4, TIMESTAMP '1995-01-01', 'x'), (4, 2, 'F', 50000.6, TIMESTAMP '1995-01-02', 'x')"
    check(spark, tmp_path, "f07_frames", orders=(COLUMNS, values))


def test_correlated_limit(spark, tmp_path):
    """NULL keys and prices come last, NaN is the greatest price, zeros are equal, a customer may have no orders."""
    orders = """
        (CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0.0 AS DOUBLE)), (0, 1, -0.0), (14, 2, -0.0), (13, 2, 0.0), (3, 3, 'nan'), (2, 3, 'nan'), (1, 3, 'inf'), (5, 4, NULL), (4, 4, NULL), (NULL, 4, NULL), (9, 4, -1),
        (6, 5, NULL), (NULL, 5, NULL), (NULL, 6, 2), (7, 6, 2), (8, NULL, 2), (NULL, 7, 2), (1, 7, 1)"""
    customers = "(CAST(1 AS BIGINT)), (2), (3), (3), (4), (5), (6), (7), (8), (NULL), (NULL)"
    check(spark, tmp_path, "d04_correlated_limit", orders=("o_orderkey, o_custkey, o_totalprice", orders), customer=("c_custkey", customers))


def test_correlated_limit_keeps_order(spark, tmp_path):
    """The window that ranks a customer's orders has their order itself, whatever a shuffle does to sorted rows."""
    test_correlated_limit(spark, tmp_path)
    plan = queries.QUERIES["d04_correlated_limit"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\w+, o_totalprice#\d+ DESC NULLS LAST, o_orderkey#\w+ ASC NULLS LAST", plan)
