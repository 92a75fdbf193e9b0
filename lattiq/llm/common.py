"""Helpers shared by the text operators: table access, lineage cuts, batch sizing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks of the contracts, as a regular-expression class body.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
#: The same blanks as bytes; ``bytes.split()`` splits on exactly these.
BLANK_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one table through Spark's reader, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``.  Only a local master may fall back to
    a folder of its own, as in tests.
    """
    known = spark.sparkContext.getCheckpointDir()  # carries spark.checkpoint.dir
    known = known or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattiq-"))
    return spark.sparkContext.getCheckpointDir()


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """The paths of what ``cut`` writes within are added to ``paths``, for the caller to remove."""
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, no recomputation.

    The table stays until one who has ``noted`` it removes it; else as long as the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> Column:
    """``df[name]`` also where the name holds dots or back-ticks."""
    return df["`" + name.replace("`", "``") + "`"]


def blob(text: Column) -> Column:
    """A text as UTF-8 bytes for Arrow; null stays null."""
    return text.cast("string").cast("binary")


def chunks(batch: pa.RecordBatch, col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into slices of about ``limit`` bytes of ``col``; one long row stands alone.

    Keeps what Python holds at a time bounded whatever the rows' lengths are.
    """
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n + 64
    yield batch.slice(first)
