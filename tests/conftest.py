import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return lambda sf: f"{DATA}/{sf}"


def plain(value):
    """A value with floats rounded, as the oracle comparison sees it."""
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="session")
def against_duckdb(spark):
    def compare(query, sql, folder):
        import duckdb

        con = duckdb.connect()
        for name in sorted(os.listdir(folder)):
            con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{folder}/{name}')")
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        df = query(spark, folder)
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        expected = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=str)
        assert sorted((plain(tuple(r)) for r in df.collect()), key=str) == expected

    return compare
