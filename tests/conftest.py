import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same_rows(duck):
    """Whether a DataFrame has the rows that SQL gives."""

    def check(df, sql):
        cols = sorted(df.columns)
        ours = sorted((plain(tuple(r)) for r in df.select(cols).collect()), key=repr)
        other = duck.sql(sql)
        assert sorted(other.columns) == cols
        theirs = sorted((plain(r) for r in other.select(*cols).fetchall()), key=repr)
        assert ours == theirs

    return check
