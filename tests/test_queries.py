"""Every registered query with SQL gives the same rows as the SQL, over the whole smallest tables."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = list(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        at = [names.index(c) for c in sorted(names)]
        assert sorted(names) == columns
        assert got == Counter(tuple(r[k] for k in at) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lodesift")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "lodesift.llm" not in open(path, encoding="utf-8").read(), path
