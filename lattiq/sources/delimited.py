"""Delimited text under a declared schema, and the contract checks of raw files."""

from __future__ import annotations

import csv
import functools
import hashlib
import operator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.errors import ContractError
from lattiq.sources.files import modified_at, sha256_of, size_of


@dataclass(frozen=True)
class FileSpec:
    """What a raw file is declared to be.  ``quote`` empty: fields are never quoted."""

    columns: tuple[str, ...]
    delimiter: str = "|"
    quote: str = '"'
    encoding: str = "ISO-8859-1"
    bytes_: int | None = None
    rows: int | None = None
    sha256: str | None = None
    fingerprint: str | None = None


def scan(spark: SparkSession, path: str, spec: FileSpec) -> DataFrame:
    """All columns as text; empty fields are null; rows that do not fit fail.  Latin-1 control bytes survive as they are."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])
    return spark.read.csv(path, schema=schema, sep=spec.delimiter, header=True, quote=spec.quote, escape=spec.quote, encoding=spec.encoding,
                          nullValue="", emptyValue="", mode="FAILFAST", enforceSchema=False)


def until(table: DataFrame, last, date: str = "quarter") -> DataFrame:
    """A table's rows up to a date.  Where the table is partitioned by it, the folders of later dates are not opened."""
    return table.where(F.col(date) <= F.lit(last))


def sha256_file(path: str | Path, chunk: int = 1 << 20) -> str:
    """Of a local file, as one stream."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def inspect_unquoted(path: str | Path, spec: FileSpec) -> dict:
    """A local file in one pass: hash, data rows, how many lines have another number of delimiters, and the first five of them."""
    h, lines, bad, first = hashlib.sha256(), 0, 0, []
    want, sep = len(spec.columns) - 1, spec.delimiter.encode(spec.encoding)
    with open(path, "rb") as f:
        for line in f:
            h.update(line)
            lines += 1
            if line.count(sep) != want:
                bad += 1
                if len(first) < 5:
                    first.append(lines)
    return {"sha256": h.hexdigest(), "data_rows": max(lines - 1, 0), "bad_lines": bad, "first_bad_lines": first}


def numbered_lines(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The lines (split, place, line) of a file, read in splits, and by split (the lines before it, its first place).

    ``place`` grows within a split from line to line, so a line's number is: lines before its split, plus its place less the first one, plus one.
    """
    d = spark.read.text(path, lineSep="\n") if encoding.upper() in ("UTF-8", "UTF8") else spark.read.option("encoding", encoding).text(path, lineSep="\n")
    d = d.select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    before, out = 0, {}
    for r in d.groupBy("split").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("split").collect():  # a row a split
        out[r["split"]] = (before, r["first"])
        before += r["n"]
    out[-1] = (before, 0)
    return d, out


def _by_split(splits: dict[int, tuple[int, int]], which: int):
    """The entry of a row's split, without a join: splits are few."""
    known = F.create_map(*[F.lit(x).cast("long") for k, v in splits.items() for x in (k, v[which])])
    return F.element_at(known, F.col("split"))


def inspect_splits(spark: SparkSession, path: str, spec: FileSpec) -> dict:
    """What ``inspect_unquoted`` says of a file's lines, by Spark and on any file system, and the lines' fingerprint.

    The fingerprint adds up hashes of (number, line), so it depends on the order of the lines and not on how the file was split; all
    splits are read side by side, where a SHA-256 is one stream by its nature.
    """
    d, splits = numbered_lines(spark, path, spec.encoding)
    lines, n = splits[-1][0], F.col("place") - _by_split(splits, 1) + _by_split(splits, 0) + 1
    want = (len(spec.columns) - 1) * len(spec.delimiter)
    d = d.select("split", n.alias("n"), "line").withColumn("bad", F.length("line") - F.length(F.replace("line", F.lit(spec.delimiter), F.lit(""))) != want)
    h = [F.xxhash64("n", "line"), F.xxhash64("line", "n")]
    sums = [f.alias(f"{k}{i}") for i, x in enumerate(h) for k, f in (("s", F.sum(x.cast("decimal(38,0)")).cast("string")), ("x", F.bit_xor(x)))]
    each = d.groupBy("split").agg(F.count_if("bad").alias("bad"), *sums).orderBy("split").collect()  # a row a split
    total = [str(sum(int(r[f"s{i}"]) for r in each)) for i in (0, 1)] + [str(functools.reduce(operator.xor, (r[f"x{i}"] for r in each), 0)) for i in (0, 1)]
    near, found = [], 0
    for r in each:  # the splits that hold the first five
        if r["bad"] and found < 5:
            near.append(r["split"])
            found += r["bad"]
    first = [r["n"] for r in d.where("bad").where(F.col("split").isin(near)).orderBy("n").select("n").limit(5).collect()] if near else []
    fingerprint = hashlib.sha256(f"{lines}/{'/'.join(total)}".encode()).hexdigest()
    return {"data_rows": max(lines - 1, 0), "bad_lines": sum(r["bad"] for r in each), "first_bad_lines": first, "fingerprint": fingerprint}


def bad_lines(spark: SparkSession, path: str, spec: FileSpec) -> DataFrame:
    """The lines themselves that have another number of delimiters."""
    d = spark.read.option("encoding", spec.encoding).text(path)
    n = F.length("value") - F.length(F.replace("value", F.lit(spec.delimiter), F.lit("")))
    return d.where(n != (len(spec.columns) - 1) * len(spec.delimiter))


def read_header(spark: SparkSession, path: str, spec: FileSpec) -> list[str]:
    """The first line's fields."""
    line = spark.read.option("encoding", spec.encoding).text(path, lineSep="\n").first()
    if line is None:
        raise ContractError(f"{path} is empty")
    rows = csv.reader([line[0].rstrip("\r")], delimiter=spec.delimiter, quoting=csv.QUOTE_MINIMAL if spec.quote else csv.QUOTE_NONE, **({"quotechar": spec.quote} if spec.quote else {}))
    return next(rows, [])


def validate_raw_file(spark: SparkSession, path: str | Path, spec: FileSpec) -> dict:
    """A status record of a file, on any file system, that is what was declared; anything else raises.

    Lines are inspected by Spark, split by split.  A file's SHA-256 is one stream, which the driver's JVM reads; it is
    made unless a fingerprint is declared instead, as for files too large for one reader.
    """
    path = str(path)
    size = size_of(spark, path)
    if size is None:
        raise ContractError(f"{path} is missing")
    if spec.bytes_ is not None and size != spec.bytes_:
        raise ContractError(f"{path} has {size} bytes, {spec.bytes_} are declared")
    header = read_header(spark, path, spec)
    if tuple(header) != tuple(spec.columns):
        raise ContractError(f"{path} has another header: {header}")
    found = {} if spec.quote and spec.fingerprint is None else inspect_splits(spark, path, spec)
    if not spec.quote and found["bad_lines"]:
        raise ContractError(f"{path}: {found['bad_lines']} lines have another number of fields, first {found['first_bad_lines']}")
    if spec.quote:  # a quoted field may hold delimiters and line ends: only the fingerprint counts
        found = {k: v for k, v in found.items() if k == "fingerprint"}
    if spec.rows is not None and "data_rows" in found and found["data_rows"] != spec.rows:
        raise ContractError(f"{path} has {found['data_rows']} rows, {spec.rows} are declared")
    if spec.fingerprint is None:
        found["sha256"] = sha256_of(spark, path)
    for k in ("sha256", "fingerprint"):
        if getattr(spec, k) is not None and found.get(k) != getattr(spec, k):
            raise ContractError(f"{path} has another {k}")
    return {"path": path, "status": "passed", "bytes": size, "modified": modified_at(spark, path), "columns": len(header), "encoding": spec.encoding, "delimiter": spec.delimiter, **found}


def same_file(spark: SparkSession, record: dict) -> bool:
    """Whether a file still is what its status record says.  It is read only if its length is the same and its time of change isn't."""
    if size_of(spark, record["path"]) != record["bytes"]:
        return False
    if modified_at(spark, record["path"]) == record["modified"]:
        return True
    if "sha256" in record:
        return sha256_of(spark, record["path"]) == record["sha256"]
    spec = FileSpec(("",) * record["columns"], delimiter=record["delimiter"], encoding=record["encoding"])
    return inspect_splits(spark, record["path"], spec)["fingerprint"] == record["fingerprint"]
