import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def same_as_sql(spark, duck, part, name):
    """Rows of a query and of its SQL as comparable multisets."""
    df = part.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = duck.sql(part.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return mine, theirs
