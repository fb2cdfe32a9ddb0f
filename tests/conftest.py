import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    local = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.local.dir", str(local)).config("spark.checkpoint.dir", str(local / "shared")).config("spark.sql.warehouse.dir", str(local / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    return DATA


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return [value(x) for x in v]
    return v


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Compares a query with its SQL in DuckDB, columns by name and rows in any order."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted(repr([value(r[c]) for c in cols]) for r in df.collect())
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(repr([value(r[i]) for i in at]) for r in rel.fetchall())

    return check
