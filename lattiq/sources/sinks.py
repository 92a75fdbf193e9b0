"""Ordered Parquet tables in versions: written whole, checked, and published by one small file.

A table's folder holds ``data-<id>`` folders and ``versions/<number>.json`` entries.  A writer puts its rows in a data folder of its
own, in range-partitioned order, reads them back once for each file's rows, key range and hash, and then creates the next
entry, which names the folder and its files.  The entry is created exclusively: of two writers one gets it, the other
fails; and until it is there readers see the version before, whatever happens to the writer.  Nothing is renamed or
deleted on the way, so this holds on object stores, too.  The files in the entry's order hold the rows in the table's order.

``verify`` compares the folder's files with the entry by length and time of change, and hashes again only those that differ.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.errors import ContractError
from lattiq.sources.files import file_names, folders, listing, read_text, remove, write_once


def schema_fingerprint(df: DataFrame) -> str:
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": True} for f in df.schema]
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _row_hash(columns: list[str]):
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)])


def _sums(hash_column) -> list:
    """Count, sum and exclusive or of row hashes: parts of a table can be added up."""
    return [F.count("*").alias("rows"), F.sum(hash_column.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(hash_column).alias("xor")]


def combined_hash(parts: list[dict], fingerprint: str) -> str:
    """The content hash of rows that are in several parts."""
    n, total, xor = 0, 0, 0
    for p in parts:
        n, total, xor = n + p["rows"], total + int(p["sum"] or 0), xor ^ (p["xor"] or 0)
    return hashlib.sha256(f"{n}/{total}/{xor}/{fingerprint}".encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows in any order and any number of files (Parquet's own bytes vary)."""
    return combined_hash([df.agg(*_sums(_row_hash(df.columns))).first().asDict()], schema_fingerprint(df))


def _ddl(record: dict) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in record["schema"])


def _read(spark: SparkSession, folder: str, record: dict, files: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(_ddl(record)).option("basePath", folder)
    return reader.parquet(*[f"{folder}/{f}" for f in files] if files is not None else [folder])


def _describe(spark: SparkSession, folder: str, record: dict, files: list[str] | None = None) -> dict[str, dict]:
    """By file: rows, hash sums, first and last key, and its place in the order.  One pass, one row a file to the driver."""
    d = _read(spark, folder, record, files)
    names = [c for c, _ in record["schema"]]
    key = F.struct(*[F.col(f"`{c}`") for c in record["order_by"]])
    own = d.select(F.col("_metadata.file_path").alias("file"), _row_hash(names).alias("h"), key.alias("key")).groupBy("file").agg(*_sums(F.col("h")), F.min("key").alias("first"), F.max("key").alias("last"))
    by_key = Window.partitionBy().orderBy("first", "last", "file")  # a row for each file
    # A file's last key is not above the next one's first: the files are in order.
    own = own.withColumns({"place": F.row_number().over(by_key), "in_order": F.coalesce(F.col("last") <= F.lead("first").over(by_key), F.lit(True))})
    rows = own.withColumns({k: F.to_json(k) for k in ("first", "last")}).collect()
    base = folder.rsplit("/", 1)[-1] + "/"
    return {unquote(r["file"].rpartition(base)[2]): {k: r[k] for k in ("rows", "sum", "xor", "first", "last", "place", "in_order")} for r in rows}


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in file_names(spark, f"{path}/versions") if n.endswith(".json")]


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest version's entry; None where there is none."""
    known = versions(spark, path)
    return json.loads(read_text(spark, f"{path}/versions/{known[-1]:08d}.json")) if known else None


def publish(df: DataFrame, path: str, order_by: list[str], *, overwrite: bool = False, rows: int | None = None, partition_by: list[str] | None = None) -> dict:
    """Write ``df`` in the order of ``order_by`` as the table's next version; gives the version's entry.

    ``partition_by`` names leading columns of ``order_by`` whose values become folders, which scans can leave out.
    """
    spark, partition_by = df.sparkSession, list(partition_by or [])
    known = versions(spark, path)
    if known and not overwrite:
        raise ContractError(f"{path} exists")
    if partition_by != order_by[: len(partition_by)]:
        raise ContractError("a table is partitioned by the first columns of its order")
    data = f"data-{uuid.uuid4().hex[:12]}"
    folder = f"{path}/{data}"
    record = {"data": data, "order_by": list(order_by), "partition_by": partition_by, "schema": [[f.name, f.dataType.simpleString()] for f in df.schema], "schema_sha256": schema_fingerprint(df)}
    try:
        writer = df.orderBy(*[f"`{c}`" for c in order_by]).write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
        found, own = listing(spark, folder), _describe(spark, folder, record)
        none = {"rows": 0, "sum": None, "xor": None, "first": None, "last": None, "place": 0, "in_order": True}
        files = [{"path": f, "bytes": size, "modified": at, **own.get(f, none)} for f, (size, at) in found.items()]
        files.sort(key=lambda f: f.pop("place"))
        if not all([f.pop("in_order") for f in files]):
            raise ContractError(f"{path}: its files are not in order")
        record |= {"rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files), "files": files, "content_sha256": combined_hash(files, record["schema_sha256"])}
        if rows is not None and record["rows"] != rows:
            raise ContractError(f"{path}: {record['rows']} rows were written, {rows} expected")
        number = known[-1] + 1 if known else 1
        if not write_once(spark, f"{path}/versions/{number:08d}.json", json.dumps(record, sort_keys=True)):
            raise ContractError(f"{path}: another writer published version {number}")
    except BaseException:
        remove(spark, folder)
        if not versions(spark, path):
            remove(spark, path)
        raise
    return record | {"path": path, "version": number}


def open_table(spark: SparkSession, path: str, record: dict | None = None) -> DataFrame:
    """A version of a table, the newest if none is given."""
    record = record or current(spark, path)
    if record is None:
        raise ContractError(f"{path} is missing")
    return _read(spark, f"{path}/{record['data']}", record).select(*[f"`{c}`" for c, _ in record["schema"]])


def verify(spark: SparkSession, path: str, record: dict, *, deep: bool = False) -> int:
    """Raise unless a version's files are as its entry says; gives the number of files that were read for it.

    Files of the recorded length and time of change are not read, unless ``deep``.
    """
    folder = f"{path}/{record['data']}"
    now, then = listing(spark, folder), {f["path"]: f for f in record["files"]}
    if not now:
        raise ContractError(f"{path} is missing")
    if now.keys() != then.keys():
        raise ContractError(f"{path}: files came or went: {sorted(now.keys() ^ then.keys())[:5]}")
    if record["content_sha256"] != combined_hash(record["files"], record["schema_sha256"]):
        raise ContractError(f"{path}: content_sha256 is not that of its files")
    changed = [f for f, at in now.items() if deep or at != (then[f]["bytes"], then[f]["modified"])]
    if changed:
        own = _describe(spark, folder, record, changed)
        for f in changed:
            found = own.get(f, {"rows": 0, "sum": None, "xor": None})
            if any(found[k] != then[f][k] for k in ("rows", "sum", "xor")):
                raise ContractError(f"{path}: {f} changed")
    return len(changed)


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove the data folders that the newest version does not name: older versions, and what failed writers left.

    Call it when nobody writes the table or reads an older version.
    """
    keep = (current(spark, path) or {}).get("data")
    gone = [f for f in folders(spark, path) if f.startswith("data-") and f != keep]
    for f in gone:
        remove(spark, f"{path}/{f}")
    return gone


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it stands now, in the folder that the cluster shares: later plans start here instead of carrying its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ContractError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattiq-"))
    return df.checkpoint()
