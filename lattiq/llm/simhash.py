"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Fingerprints: a text's A-Z are lower-cased, its words give 3-word shingles, and a bit is
set if it is set in over half of the shingles' XXH64 values.

Links: a random map gives each bit position a vector of ``radius + 1`` bits; table v (one for each
nonzero vector) masks the positions whose vector has odd overlap with v.  Any
``radius`` differing positions leave some v with even overlap to all of them, so every
pair within the radius agrees on some table's masked bits: no link can be missed.
Copies of a fingerprint are one class before any table is made.  A bucket of a
table is searched in blocks, and gives no more links than it has members (a
spanning forest).  A bucket with more than ``limit`` members is split by the same
scheme under another random map, which covers its pairs again; each level fixes about
half of the bits still free, so this ends.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer
than three words are one shingle; repeated rows each get a row; a row without an id links like any other, and the chain through it
holds, but it names no component: component_id is the smallest id of the component, null if none of its rows has one; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm.common import blob, chunks, column, cut
from lattiq.llm.components import components


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """A text's SimHash as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return fingerprint_of(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def fingerprint_of(h: np.ndarray) -> int:
    """The SimHash of hash values: a bit is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text is unpacked piece by piece
        ones += np.unpackbits(h[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                fp = np.array([fingerprint(t) for t in part.column("t").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return d.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, level: int) -> list[int]:
    """The covering tables' masks, as signed longs; another random map for each level."""
    rng = random.Random(f"{radius}-{level}")
    at = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    out = [sum(1 << i for i in range(64) if (at[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def bucket_links(fps: np.ndarray, radius: int, block: int = 1024) -> list[tuple[int, int]]:
    """Indices (i, j) of a spanning forest of the pairs within ``radius``; distances are made block by block."""
    label = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            near = np.bitwise_count(fps[i : i + block, None] ^ fps[None, j : j + block]) <= radius
            for a in np.flatnonzero(near.any(1)):
                other = np.flatnonzero(near[a]) + j
                other = other[label[other] != label[a + i]]
                for tree, k in zip(*np.unique(label[other], return_index=True), strict=True):
                    out.append((a + i, int(other[k])))
                    label[label == tree] = label[a + i]
    return out


_SEARCHED = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "bucket")])


def _search(radius: int, limit: int):
    """Over rows (bucket, fp, rep) sorted by bucket: links (a, b), and the members of too large buckets (a = fp, b = rep, bucket)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open bucket's (bucket, fp, rep) rows so far
        large = None

        def rows(a, b, bucket):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bucket, pa.int64())], schema=out)

        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])

        def close(part: np.ndarray) -> list[tuple[int, int]]:
            return [(int(part[2, i]), int(part[2, j])) for i, j in bucket_links(part[1].view(np.uint64), radius)]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if held:
                now = np.concatenate([*held, now], axis=1)
                held = []
            if large is not None:  # the rest of a bucket that was found too large
                n = int(np.argmax(now[0] != large)) if (now[0] != large).any() else now.shape[1]
                if n:
                    yield rows(now[1, :n], now[2, :n], now[0, :n])
                now = now[:, n:]
                if not now.shape[1]:
                    continue
                large = None
            edges = np.flatnonzero(np.diff(now[0])) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, now.shape[1]]
            two = starts[:-1][np.diff(starts) == 2] if len(starts) > 1 else starts[:0]
            near = two[np.bitwise_count(now[1, two].view(np.uint64) ^ now[1, two + 1].view(np.uint64)) <= radius]
            if len(near):
                yield rows(now[2, near], now[2, near + 1], [None] * len(near))
            found = []
            for s, e in zip(starts[:-1], ends[:-1], strict=True) if len(starts) > 1 else ():
                if e - s > limit:
                    yield rows(now[1, s:e], now[2, s:e], now[0, s:e])
                elif e - s > 2:
                    found += close(now[:, s:e])
            if found:
                a, b = zip(*found, strict=True)
                yield rows(a, b, [None] * len(a))
            last = now[:, starts[-1] :]
            if last.shape[1] > limit:
                large = last[0, 0]
                yield rows(last[1], last[2], last[0])
            else:
                held = [last]
        if held and held[0].shape[1] > 1 and (found := close(held[0])):
            a, b = zip(*found, strict=True)
            yield rows(a, b, [None] * len(a))

    return run


def near_links(classes: DataFrame, *, radius: int = 3, limit: int = 4096, fp: str = "fp", rep: str = "rep") -> DataFrame:
    """Links (a, b) between the ``rep`` (never null) of distinct fingerprints: every pair within ``radius`` bits is connected through them."""
    spark = classes.sparkSession
    todo = classes.select(F.lit(0).cast("long").alias("bucket"), F.col(fp).alias("fp"), F.col(rep).alias("rep"))
    links, level = None, 0
    while True:
        tables = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks(radius, level))])).alias("t")
        keyed = todo.select("bucket", "fp", "rep", tables).select(F.xxhash64("bucket", "t.v", F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket"), "fp", "rep")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
        got = cut(keyed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_search(radius, limit), _SEARCHED))
        part = got.where("bucket is null").select("a", "b")
        links = part if links is None else links.unionByName(part)
        large = got.where("bucket is not null")
        if large.isEmpty():
            return links
        if level >= 64:  # cannot happen while fingerprints are distinct: by then every bit is fixed
            raise RuntimeError("buckets are still too large after 64 splits")
        todo, level = large.select("bucket", F.col("a").alias("fp"), F.col("b").alias("rep")), level + 1


def simhash(docs: DataFrame, *, radius: int = 3, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable by links."""
    found = cut(fingerprints(docs, id_col, text_col))
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = cut(classes.withColumn("rep", F.col("fp")))  # a class goes by its fingerprint: its rows may have no id
    linked = components(near_links(classes, radius=radius, limit=limit))
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
