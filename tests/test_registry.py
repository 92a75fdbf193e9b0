import os

import duckdb
import pytest

import __spark_entry__ as entry
from lattiq.plans.queries import oracle_sql, queries
from lattiq.streaming.rollup import daily_rollup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_flagship(spark):
    d = entry.entry(spark)
    assert d.count() == 8 and {"model", "horizon", "wape"} <= set(d.columns)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    clean = lambda v: round(v, 5) if isinstance(v, float) else v
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(clean(r[c]) for c in cols) for r in df.collect()], key=key) == sorted([tuple(map(clean, r)) for r in cur.fetchall()], key=key)


def test_streaming_rollup_is_the_batch_one(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = {tuple(r) for r in daily_rollup(events).select("day", "event_type", "source_rows", "reported_rows").collect()}
    (tmp_path / "in").mkdir()
    os.symlink(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = daily_rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("rolled").select("day", "event_type", "source_rows", "reported_rows").collect()} == batch
