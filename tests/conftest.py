from __future__ import annotations

import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the star tables of a folder as views."""
    import duckdb

    def opened(folder: str):
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        return con

    return opened


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query's rows are those of its SQL, as a multiset."""

    def check(query, sql: str, folder: str = SMALL) -> None:
        df = query(spark, folder)
        got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
        result = duck(folder).execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(df.columns)]
        assert got == sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)

    return check
