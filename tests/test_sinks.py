"""The versioned sink: order over files, atomic publishing, cheap and deep verification."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lattiq.errors import ContractError
from lattiq.sources import sinks
from lattiq.sources.sinks import content_hash, current, open_table, publish, sweep, verify, versions


def data(spark, n=4000):
    return spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 13).cast("string").alias("g"), F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 4 * 91).cast("int")).alias("quarter"))


@pytest.fixture
def many_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_files_in_the_entrys_order_hold_the_total_order(spark, tmp_path, many_files):
    d, path = data(spark), str(tmp_path / "t")
    r = publish(d, path, ["g", "k"])
    assert len(r["files"]) == 8 and r["rows"] == 4000 and r["content_sha256"] == content_hash(d)
    one_by_one = [spark.read.parquet(f"{path}/{r['data']}/{f['path']}").collect() for f in r["files"]]
    got = [(x.g, x.k) for part in one_by_one for x in part]
    assert got == sorted(got) and [len(p) for p in one_by_one] == [f["rows"] for f in r["files"]]
    assert all(f["first"] and f["last"] for f in r["files"])


def test_partitioned_tables_keep_their_order_and_columns(spark, tmp_path, many_files):
    d, path = data(spark), str(tmp_path / "t")
    r = publish(d, path, ["quarter", "k"], partition_by=["quarter"])
    t = open_table(spark, path)
    assert t.columns == d.columns and t.dtypes == d.dtypes and content_hash(t) == content_hash(d) == r["content_sha256"]
    at = [f["path"].split("/")[0] for f in r["files"]]
    assert at == sorted(at) and len(set(at)) == 4
    plan = t.where("quarter <= date'2020-04-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan
    with pytest.raises(ContractError):
        publish(d, str(tmp_path / "u"), ["k"], partition_by=["quarter"])


def test_a_writer_that_fails_between_the_steps_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    publish(spark.range(5), path, ["id"])
    with pytest.raises(ContractError):
        publish(spark.range(6), path, ["id"])
    with monkeypatch.context() as m:
        def broken(*_):
            raise RuntimeError("the writer is gone")

        m.setattr(sinks, "write_once", broken)
        with pytest.raises(RuntimeError):
            publish(spark.range(6), path, ["id"], overwrite=True)
        m.setattr(sinks, "_describe", broken)
        with pytest.raises(RuntimeError):
            publish(spark.range(6), path, ["id"], overwrite=True)
    assert open_table(spark, path).count() == 5 and versions(spark, path) == [1]
    old = open_table(spark, path)
    publish(spark.range(7), path, ["id"], overwrite=True)
    assert open_table(spark, path).count() == 7 and old.count() == 5  # a reader of the old version goes on reading it
    assert len(sweep(spark, path)) == 1 and open_table(spark, path).count() == 7 and sweep(spark, path) == []


def test_of_two_writers_one_publishes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    publish(spark.range(1), path, ["id"])
    own = sinks.versions
    calls = []

    def late(s, p):
        calls.append(p)
        return [1] if len(calls) == 1 else own(s, p)

    publish(spark.range(2), path, ["id"], overwrite=True)
    monkeypatch.setattr(sinks, "versions", late)  # has looked before the other one published
    with pytest.raises(ContractError, match="another writer"):
        publish(spark.range(3), path, ["id"], overwrite=True)
    monkeypatch.undo()
    assert open_table(spark, path).count() == 2 and len([n for n in os.listdir(path) if n.startswith("data-")]) == 2


def test_verify_reads_only_what_looks_changed(spark, tmp_path, many_files):
    path = str(tmp_path / "t")
    r = publish(data(spark), path, ["k"])
    assert verify(spark, path, r) == 0 and verify(spark, path, r, deep=True) == 8
    first = tmp_path / "t" / r["data"] / r["files"][0]["path"]
    os.utime(first, (1, 1))
    assert verify(spark, path, r) == 1  # touched, the same rows
    other = publish(data(spark).withColumn("k", F.col("k") + 1), str(tmp_path / "u"), ["k"])
    second = tmp_path / "t" / r["data"] / r["files"][1]["path"]
    second.write_bytes((tmp_path / "u" / other["data"] / other["files"][1]["path"]).read_bytes())
    second.with_name(f".{second.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ContractError, match="changed"):
        verify(spark, path, r)
    second.unlink()
    with pytest.raises(ContractError, match="came or went"):
        verify(spark, path, r)
    with pytest.raises(ContractError, match="not that of its files"):
        verify(spark, str(tmp_path / "u"), other | {"content_sha256": "0"})


def test_empty_and_null_keys(spark, tmp_path):
    r = publish(spark.range(0), str(tmp_path / "e"), ["id"])
    assert r["rows"] == 0 and open_table(spark, str(tmp_path / "e")).count() == 0 and verify(spark, str(tmp_path / "e"), r, deep=True) >= 0
    d = spark.createDataFrame([(None, 1), (2, None), (None, None), (1, 1)], "`a.b` int, c int")
    r = publish(d, str(tmp_path / "n"), ["a.b", "c"])
    assert [tuple(x) for x in open_table(spark, str(tmp_path / "n")).collect()] == [(None, None), (None, 1), (1, 1), (2, None)] and current(spark, str(tmp_path / "n"))["rows"] == 4
