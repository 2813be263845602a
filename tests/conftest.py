import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    made = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture
def same(spark, sf, duck):
    """Whether a query's rows are its oracle's."""

    def check(query, sql):
        df = query(spark, sf)
        rows, found = [tuple(r) for r in df.collect()], duck.sql(sql)
        at = [found.columns.index(c) for c in df.columns]
        assert len(found.columns) == len(df.columns)
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())

    return check
