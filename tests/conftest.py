import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the small tables as views."""
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for file in sorted(os.listdir(SMALL)):
        c.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SMALL}/{file}'")
    return c


def normal(value):
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(normal, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query gives the rows of its SQL on the small tables."""

    def check(query, sql):
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        got = sorted(tuple(map(normal, r)) for r in df.select(*columns).collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(tuple(normal(r[i]) for i in at) for r in result.fetchall())

    return check
