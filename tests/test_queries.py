"""Every registered query against its DuckDB SQL on the smallest data: names, types and rows as multisets."""

import math

import pytest

from sparkloom import queries

from .conftest import DATA


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def kinds(table):
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toArrow()
    if name not in queries.ORACLE_SQL:
        assert got.num_rows
        return
    want = duck.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)
    assert kinds(got) == kinds(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
