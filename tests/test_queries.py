import os

import duckdb
import pytest

from kithgraph.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def told(v):
    if v is None:
        return "~"
    return f"{v:.5f}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df, other = QUERIES[name](spark, FOLDER), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert sorted(tuple(map(told, r)) for r in df.select(*columns).collect()) == sorted(tuple(told(r[i]) for i in at) for r in other.fetchall())


def test_the_stream_counts_as_the_table_does(spark, tmp_path):
    from pyspark.sql import functions as F

    from kithgraph.streaming import stats

    (tmp_path / "in").mkdir()
    os.symlink(f"{FOLDER}/events.parquet", tmp_path / "in/events.parquet")
    live = stats.run_once(stats.windowed(stats.read_events(spark, str(tmp_path / "in"))), "windows", str(tmp_path / "cp"))
    table = stats.windowed(spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, live.collect())) == sorted(map(key, table.collect()))
