"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

State, all tables in the shared folder:

* ``postings``: (key, doc_id), one row for each document that holds a line's key.
* ``counts``: (key, n_docs, last_doc), the exact reference counts of the keys.
* ``filters``: (shard, n, table), one cuckoo filter a shard, holding the keys that at least
  ``min_docs`` documents hold.  A filter can forget: when deletions bring a key
  under the bound, its fingerprint is taken out again.  The number of shards follows the number of
  these keys: beyond ``SHARD_KEYS`` a shard it is doubled, so a shard, and the task that makes it, is bounded.

``insert`` and ``delete`` change counts by the postings of the documents that come or go,
and filters by the keys that cross the bound.  ``shared_lines`` asks the filters
first, so that only lines they know are joined to the exact counts; what a filter
wrongly knows, the counts refuse.  ``insert`` then ``delete`` of the same documents gives the
same decisions as never having seen them.

Defined results: a null or empty text is one empty line; a row without a doc_id counts toward no key and is never the last
to hold one, so it loses every line whose key ``min_docs`` other documents hold; rows that repeat a doc_id count once toward the number of documents, and each gets its own
row; lines under ``min_chars`` code points are never dropped; extra columns are ignored;
an empty table gives an empty state and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import BLANK_BYTES, blob, chunks, column, cut

SLOTS, KICKS = 4, 500
#: Filters travel to the tasks by broadcast up to this many bytes; beyond it, keys travel to the filters.
BROADCAST_BYTES = 32 << 20
#: A shard holds about so many keys at most (16 MB of keys in the task that makes it).
SHARD_KEYS = 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits that stand for a line's key; None if the key is too short to count."""
    key = line.strip(BLANK_BYTES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; an item lives in one of two buckets, and can be deleted."""

    def __init__(self, capacity: int, table: bytes | None = None):
        if table is None:
            size = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.8)))))
            self.table = np.zeros((size, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = np.uint64(len(self.table) - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of 64-bit keys."""
        mark = ((keys >> np.uint64(48)).astype(np.uint16) | np.uint16(0)) % np.uint16(65535) + np.uint16(1)
        one = keys & self.mask
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return (bucket ^ (np.uint64(mark) * np.uint64(0x5BD1E995) if np.isscalar(mark) else mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _fill(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks where their buckets have free slots; returns the places of those that found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        nth = np.arange(len(b)) - np.searchsorted(b, b)  # the how manieth of its bucket
        free = self.table[b] == 0
        hit = free & (np.cumsum(free, axis=1) == (nth + 1)[:, None])
        row, slot = np.nonzero(hit)
        self.table[b[row], slot] = mark[order[row]]
        return np.sort(order[~hit.any(1)])

    def insert(self, keys: np.ndarray) -> bool:
        """Add distinct keys; False if the table is too full, and then it must be built anew, larger."""
        mark, one, two = self.places(keys)
        left = self._fill(one, mark)  # nearly all keys find room at once
        mark, two = mark[left], two[left]
        left = self._fill(two, mark)
        mark, two = mark[left], two[left]
        for mark, b in zip(mark, two, strict=True):
            for k in range(KICKS):
                slot = k % SLOTS
                mark, self.table[b, slot] = self.table[b, slot], mark
                b = self.other(b, mark)
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Forget keys that were inserted before."""
        for mark, one, two in zip(*self.places(keys), strict=True):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == mark)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def word(key: pd.Series | list[bytes]) -> np.ndarray:
    """The 64 bits of a key that the filters use."""
    return np.frombuffer(b"".join(bytes(k)[:8] for k in key), ">u8").astype(np.uint64)


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int


def postings(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id): the keys of a document's lines, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                ids, keys = [], []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist(), strict=True):
                    own = {line_key(x, min_chars) for x in (t or b"").split(b"\n")} - {None}
                    keys += own
                    ids += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return d.mapInArrow(run, "key binary, doc_id long")


def empty(spark: SparkSession, *, min_docs: int = 5, min_chars: int = 40, shards: int = 64) -> LineIndex:
    none = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(none("key binary, doc_id long"), none("key binary, n_docs long, last_doc long"), none("shard int, n long, table binary"), min_docs, min_chars, shards)


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _refilter(index: LineIndex, rising: DataFrame, falling: DataFrame) -> DataFrame:
    """The shards' filters after keys have risen to the bound or fallen under it; a shard's filter is made in one task.

    A shard's keys, at most about SHARD_KEYS, are one pandas group.  A table that gets too full is
    made anew, twice as large, from all keys of its shard at the bound.
    """
    changes = rising.select(_shard(index.shards).alias("shard"), "key", F.lit(True).alias("up")).unionByName(
        falling.select(_shard(index.shards).alias("shard"), "key", F.lit(False).alias("up")))

    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        n = int(old["n"].iloc[0]) if len(old) else 0
        up, down = word(new["key"][new["up"]]), word(new["key"][~new["up"]])
        size = n + len(up) - len(down)
        box = CuckooFilter(size, bytes(old["table"].iloc[0]) if len(old) else None)
        box.delete(down)
        full = len(box.table) * SLOTS * 0.9 < size or not box.insert(up)
        return pd.DataFrame({"shard": [key[0]], "n": [-1 if full else size], "table": [b"" if full else box.table.tobytes()]})

    made = cut(index.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, "shard int, n long, table binary"))
    full = made.where("n < 0").select("shard")
    if full.isEmpty():
        return made

    def anew(new: pd.DataFrame) -> pd.DataFrame:
        size = 2 * len(new)
        while not (box := CuckooFilter(size)).insert(word(new["key"])):
            size *= 2
        return pd.DataFrame({"shard": new["shard"].iloc[:1], "n": [len(new)], "table": [box.table.tobytes()]})

    keys = index.counts.where(F.col("n_docs") >= index.min_docs).select(_shard(index.shards).alias("shard"), "key")
    again = keys.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(anew, "shard int, n long, table binary")
    return cut(made.where("n >= 0").unionByName(again))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the lines of ``docs``.  Pairs (key, doc_id) that it has already change nothing; rows without an id are not indexed."""
    new = postings(docs.where(column(docs, id_col).isNotNull()), index.min_chars, id_col, text_col).distinct()
    first = index.postings.isEmpty()
    if not first:
        new = new.join(index.postings, ["key", "doc_id"], "left_anti")
    new = cut(new)
    added = _counts(new)
    if first:
        counts = cut(added)
        rising = counts
    else:
        old = index.counts.select("key", F.col("n_docs").alias("was"), F.col("last_doc").alias("old_last"))
        both = cut(old.join(added, "key", "full").select(
            "key", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.coalesce("n_docs", F.lit(0))).alias("n_docs"),
            F.greatest("old_last", "last_doc").alias("last_doc")))
        counts, rising = both.drop("was"), both.where(F.col("was") < index.min_docs)
    rising = rising.where(F.col("n_docs") >= index.min_docs)
    next_ = LineIndex(new if first else index.postings.unionByName(new), counts, index.filters, index.min_docs, index.min_chars, index.shards)
    return _with_filters(next_, rising, rising.limit(0))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents in the one column of ``doc_ids``."""
    gone = doc_ids.select(column(doc_ids, doc_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    left = cut(index.postings.join(gone, "doc_id", "left_anti"))
    touched = index.postings.join(gone, "doc_id", "left_semi").select("key").distinct()
    now = _counts(left.join(touched, "key", "left_semi"))
    was = index.counts.join(touched, "key", "left_semi").select("key", F.col("n_docs").alias("was"))
    falling = cut(was.join(now, "key", "left").where(F.col("was") >= index.min_docs).where(F.coalesce("n_docs", F.lit(0)) < index.min_docs).select("key"))
    counts = cut(index.counts.join(touched, "key", "left_anti").unionByName(now))
    next_ = LineIndex(left, counts, index.filters, index.min_docs, index.min_chars, index.shards)
    return _with_filters(next_, falling.limit(0), falling)


def _with_filters(index: LineIndex, rising: DataFrame, falling: DataFrame) -> LineIndex:
    at_bound = index.counts.where(F.col("n_docs") >= index.min_docs)
    shards, n = index.shards, at_bound.count()
    while n > shards * SHARD_KEYS:
        shards *= 2
    if shards > index.shards:  # all keys are dealt anew
        index, rising, falling = replace(index, shards=shards, filters=index.filters.limit(0)), at_bound, falling.limit(0)
    return replace(index, filters=_refilter(index, rising.select("key"), falling.select("key")))


def known(index: LineIndex, rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id) whose key a filter knows: all shared keys, and a few that are not."""
    spark = rows.sparkSession
    rows = rows.select(_shard(index.shards).alias("shard"), "key", "doc_id")
    size = index.filters.agg(F.coalesce(F.sum(F.length("table")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["table"]) for r in index.filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes = {k: CuckooFilter(0, v) for k, v in held.value.items()}
            for batch in batches:
                if batch.num_rows:
                    shard, keys = batch.column("shard").to_numpy(), word(batch.column("key").to_pylist())
                    hit = np.zeros(len(keys), bool)
                    for s in np.unique(shard):
                        if s in boxes:
                            hit[shard == s] = boxes[s].has(keys[shard == s])
                    yield batch.filter(pa.array(hit))

        return rows.mapInArrow(run, "shard int, key binary, doc_id long").drop("shard")

    def probe(_, box: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hit = CuckooFilter(0, bytes(box["table"].iloc[0])).has(word(own["key"])) if len(box) and len(own) else np.zeros(len(own), bool)
        return own.loc[hit, ["key", "n"]]

    # Keys are counted before they travel, so that a common line is one row to its shard; a shard's keys come in parts of bounded size.
    keys = rows.groupBy("shard", "key").agg(F.count("*").alias("n"))
    most = max(1, -(-keys.count() // (index.shards * SHARD_KEYS)))
    keys = keys.withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(most)))
    filters = index.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    hits = filters.groupBy("shard", "part").cogroup(keys.groupBy("shard", "part")).applyInPandas(probe, "key binary, n long")
    return rows.join(hits.select("key"), "key", "left_semi").drop("shard")


def shared_lines(index: LineIndex, rows: DataFrame) -> DataFrame:
    """(doc_id, key) of the lines to drop: their key is in ``min_docs`` documents, and this is not the last one."""
    exact = index.counts.where(F.col("n_docs") >= index.min_docs).select("key", "last_doc")
    return known(index, rows).join(exact, "key").where(F.col("doc_id") != F.col("last_doc")).select("doc_id", "key")


def dedup_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``index`` holds, with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Rows without an id go by their text's hash, so they spread over the tasks; two texts that share one lose the same keys, those that each has of them.
    """
    drops = shared_lines(index, index.postings).select(F.col("doc_id").alias("_drop_id"), F.lit(False).alias("_no_id"), "key")
    number, text_hash = column(docs, id_col).cast("long"), F.xxhash64(column(docs, text_col))
    nameless = postings(docs.where(number.isNull()).select(text_hash.alias("doc_id"), column(docs, text_col).alias("text")), index.min_chars).distinct()
    counted = index.counts.where(F.col("n_docs") >= index.min_docs)
    lost = known(index, nameless).join(counted.select("key"), "key").select(F.col("doc_id").alias("_drop_id"), F.lit(True).alias("_no_id"), "key")
    drops = drops.unionByName(lost).groupBy("_drop_id", "_no_id").agg(F.collect_set("key").alias("_drop_keys"))
    d = docs.join(drops, (F.coalesce(number, text_hash) == F.col("_drop_id")) & (number.isNull() == F.col("_no_id")), "left")
    keep = [c for c in docs.columns]
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_t"):
                out, lines, gone = [], [], []
                for t, keys in zip(part.column("_t").to_pylist(), part.column("_drop_keys").to_pylist(), strict=True):
                    own = (t or b"").split(b"\n")
                    if keys:
                        bad = set(keys)
                        left = [x for x in own if line_key(x, min_chars) not in bad]
                    else:
                        left = own
                    out.append(b"\n".join(left).decode("utf-8", "replace"))
                    lines.append(len(own))
                    gone.append(len(own) - len(left))
                at = part.schema.names.index("_t")
                cols = [part.column(i) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*part.schema.names[:at], "kept_text", "n_lines", "n_dropped"])

    # The columns of ``docs`` travel under places, so no name of theirs can clash.
    named = d.select(*[column(docs, c).alias(f"_{i}") for i, c in enumerate(keep) if c != text_col], blob(column(docs, text_col)).alias("_t"), "_drop_keys")
    schema = ", ".join([f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep) if c != text_col] + ["kept_text string", "n_lines long", "n_dropped long"])
    done = named.mapInArrow(run, schema)
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep) if c != text_col], "kept_text", "n_lines", "n_dropped")
