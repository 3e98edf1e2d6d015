"""Every frame query with SQL equals DuckDB's answer; every one without it runs."""

import math

import duckdb
import pytest
from conftest import DATA

from lumenframe.plans.descent import QUERIES as DESCENT
from lumenframe.plans.descent import SQL_OF_OTHERS
from lumenframe.plans.descriptive import QUERIES as DESCRIPTIVE
from lumenframe.plans.evaluation import QUERIES as EVALUATION
from lumenframe.plans.oracle import SQL
from lumenframe.plans.queries import QUERIES

ALL = {**{n: (q, {**SQL, **SQL_OF_OTHERS}.get(n)) for n, q in QUERIES.items()}, **EVALUATION, **DESCRIPTIVE, **DESCENT}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "events documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, duck, name):
    query, sql = ALL[name]
    df = query(spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr) == rows
