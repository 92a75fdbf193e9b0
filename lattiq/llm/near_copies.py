"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A text's A-Z are lower-cased and its words cut at the six ASCII blanks, as for SimHash; a shingle is its XXH64.
Texts of the same set are one class before anything else is done.

Candidates come from two searches.  SimHash's covering tables find all classes whose fingerprints (of 5-word shingles) are
within ``RADIUS`` bits.  At 0.8 most pairs are about ten bits apart, which no covering by tables of useful size
reaches; so classes that agree on one of ``BANDS`` bands of ``ROWS`` min-hashes are candidates as well: two sets of similarity s miss
each other with probability (1 - s^4)^24, at most 4 in a million at 0.8 and less above; that is the one
thing here which is not certain.  Candidates are checked exactly, on their whole sets, so no pair
below 0.8 is linked.  A bucket's sets meet in one task, which counts what each two have in common by matrix
products, block by block, and gives a spanning forest of the close pairs: rows never outnumber the members, all
pairs not linked by then are checked, and nothing is capped.

A bucket of more than ``PIVOT`` sets or ``BYTES`` bytes does not meet as a whole.  All its sets are compared with one of them, the
pivot (once, however many buckets they share), in as many tasks as there need be.  Sets within 0.2 of the pivot (Jaccard distance is a metric) are linked through it; only those of
the others that are within 0.4 can be close to any of these, and meet them in blocks.  What is not
linked to the pivot is a bucket of its own: after ``ROUNDS`` rounds, one of over ``LIMIT`` sets is cut into blocks that meet two by two.  So tasks are bounded, and a large group of
near copies costs one comparison a set; the work that is left grows with the square of the sets that share a band but are no copies.

Defined results: fewer than five words are one shingle; null, empty and blank texts are copies of each other; a very long
text is one set like any other; repeated rows and ties share a component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import blob, chunks, column, cut
from lattiq.llm.components import components
from lattiq.llm.simhash import fingerprint_of, near_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
RADIUS = 3
PIVOT, LIMIT, BYTES, ROUNDS = 1024, 1024, 32 << 20, 3
#: A pivot meets so many sets in one go; more of them are dealt to several.
MEETS = 256
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        found = [b" ".join(words)]
    else:
        found = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), np.uint64))


def bands(values: np.ndarray) -> list[int]:
    """A set's band values, as signed longs; none for the empty set."""
    if not len(values):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for i in range(0, len(values), 4096):  # a very long text goes piece by piece
        x = values[i : i + 4096, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(0))
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, fp, bands) for each row: key names the text's set, fp is its SimHash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                sets = [shingles(t) for t in part.column("t").to_pylist()]
                keys = [xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) for s in sets]
                fps = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.int64()), pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["id", "key", "fp", "bands"])

    return docs.select(column(docs, id_col).cast("long").alias("id"), blob(column(docs, text_col)).alias("t")).mapInArrow(run, "id long, key long, fp long, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns (bucket, ...) of each bucket, from batches sorted by bucket."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        starts = np.r_[0, np.flatnonzero(np.diff(now[0])) + 1, now.shape[1]]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if held and held[0][0, 0] != now[0, s]:
                yield held[0] if len(held) == 1 else np.concatenate(held, axis=1)
                held = []
            held.append(now[:, s:e])
    if held:
        yield np.concatenate(held, axis=1)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, key): buckets of two or more, named by their members, so that bands with the same members give one."""
    for g in _groups(batches):
        if g.shape[1] > 1:
            keys = np.unique(g[1])
            if len(keys) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63))), pa.array(keys)], ["bucket", "key"])


def close_links(sets: list[np.ndarray], block: int = 512, width: int = 8192) -> list[tuple[int, int]]:
    """Indices (i, j) of a spanning forest of the close pairs."""
    if len(sets) == 2:
        return [(0, 1)] if similarity(*sets) >= SIMILARITY else []
    size = np.array([len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1  # places of the values that two sets or more hold
    cols = np.split(np.where(n[at] > 1, shared[at], -1), np.cumsum(size)[:-1])
    cols = [np.sort(c[c >= 0]) for c in cols]
    total = int(shared[-1]) + 1

    def dense(first: int, left: int) -> np.ndarray:
        out = np.zeros((min(block, len(sets) - first), min(width, total - left)), np.float32)
        for i in range(len(out)):
            c = cols[first + i]
            out[i, c[np.searchsorted(c, left) : np.searchsorted(c, left + width)] - left] = 1
        return out

    label, links = np.arange(len(sets)), []
    for i in range(0, len(sets), block):
        for j in range(i, len(sets), block):
            if len(np.unique(np.r_[label[i : i + block], label[j : j + block]])) < 2:
                continue
            both = sum((dense(i, k) @ dense(j, k).T for k in range(0, total, width)), np.zeros((len(sets[i : i + block]), len(sets[j : j + block]))))
            near = both / (size[i : i + block, None] + size[None, j : j + block] - both) >= SIMILARITY
            for a in np.flatnonzero(near.any(1)):
                other = np.flatnonzero(near[a]) + j
                other = other[label[other] != label[a + i]]
                for tree, k in zip(*np.unique(label[other], return_index=True), strict=True):
                    links.append((a + i, int(other[k])))
                    label[label == tree] = label[a + i]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, key, x) sorted by bucket: the links (a, b) in each bucket."""
    def close(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = close_links(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([keys[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    bucket, keys, sets = None, [], []
    for batch in batches:
        for b, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and keys:
                yield close(keys, sets)
                keys, sets = [], []
            bucket = b
            keys.append(k)
            sets.append(np.frombuffer(x, np.uint64))
    if keys:
        yield close(keys, sets)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, x, pivot, px): each set's similarity to its pivot."""
    for batch in batches:
        for part in chunks(batch, "x"):
            near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64)) for x, p in zip(part.column("x").to_pylist(), part.column("px").to_pylist(), strict=True)]
            size = np.array([len(x) for x in part.column("x").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("pivot"), pa.array(near, pa.float64()), pa.array(size)], ["key", "pivot", "near", "bytes"])


def _blocks(n: str, size: str):
    return F.greatest(F.ceil(F.col(n) / LIMIT), F.ceil(F.col(size) / BYTES), F.lit(1)).cast("int")


def _own(n):
    return F.pmod(F.xxhash64("key"), n).cast("int")


def split_large(buckets: DataFrame, held: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) to pivots, and buckets of bounded size in place of the large ones.  ``held`` has each key's set x."""
    size = held.select("key", F.length("x").cast("long").alias("bytes"))
    links, done, todo = [], [], buckets
    for round_ in range(ROUNDS + 1):
        sized = todo.join(size, "key").groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("n"), F.sum("bytes").alias("total"))
        large = cut(sized.where((F.col("n") > (PIVOT if round_ < ROUNDS else LIMIT)) | (F.col("total") > BYTES)))
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large.select("bucket"), "bucket", "left_anti"))
        members = todo.join(large, "bucket")
        if round_ == ROUNDS:  # each two blocks of what is left meet
            m = members.withColumn("blocks", F.greatest(_blocks("n", "total"), F.lit(2))).withColumn("i", _own(F.col("blocks")))
            m = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> j")
            done.append(m.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), "key"))
            break
        # Each pair of a set and a pivot is compared once.  A pivot of many sets is dealt to several tasks.
        pairs = cut(members.select("key", "pivot").distinct())
        pivots = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEETS).cast("int").alias("goes"))
        px = pivots.join(held, F.col("pivot") == F.col("key")).select("pivot", F.col("x").alias("px"), F.explode(F.sequence(F.lit(0), F.col("goes") - 1)).alias("go"))
        met = pairs.join(pivots, "pivot").select("key", "pivot", _own(F.col("goes")).alias("go")).join(held, "key").hint("merge").join(px.hint("merge"), ["pivot", "go"])
        near = cut(met.select("key", "x", "pivot", "px").mapInArrow(_compare, "key long, pivot long, near double, bytes long"))
        met = cut(members.select("bucket", "key", "pivot").join(near, ["key", "pivot"]))
        core, fringe = F.col("near") >= SIMILARITY, (F.col("near") < SIMILARITY) & (F.col("near") >= 2 * SIMILARITY - 1)
        links.append(near.where(core & (F.col("key") != F.col("pivot"))).select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        parts = met.groupBy("bucket").agg(F.count_if(core).alias("nc"), F.sum(F.when(core, F.col("bytes"))).alias("bc"), F.count_if(fringe).alias("nf"), F.coalesce(F.sum(F.when(fringe, F.col("bytes"))), F.lit(0)).alias("bf"))
        parts = parts.where("nf > 0").select("bucket", _blocks("nc", "bc").alias("c"), _blocks("nf", "bf").alias("f"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        c = met.where(core).join(parts, "bucket").select("bucket", "key", _own(F.col("c")).alias("i"), every("f").alias("j"))
        f = met.where(fringe).join(parts, "bucket").select("bucket", "key", _own(F.col("f")).alias("j"), every("c").alias("i"))
        done.append(c.unionByName(f).select(F.xxhash64("bucket", F.lit(round_), "i", "j").alias("bucket"), "key"))
        todo = met.where(~core).select(F.xxhash64("bucket", F.lit("rest")).alias("bucket"), "key")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return links, out


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) for every row of ``docs``: rows of a component are joined by near copies.

    Rows of one id must have one text.
    """
    spark = docs.sparkSession
    made = cut(classes(docs, id_col, text_col))
    found = made.select("id", "key")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    sets_ = made.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # Candidates by fingerprint: sets of one fingerprint, and fingerprints within RADIUS bits.
    prints = cut(made.groupBy("fp").agg(F.min("key").alias("rep")))
    same = made.select("fp", "key").distinct().join(prints, "fp").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    pair = same.unionByName(near_links(prints, radius=RADIUS)).distinct().select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("key"))
    keyed = sets_.select(F.explode("bands").alias("bucket"), "key")
    buckets = keyed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets, "bucket long, key long").distinct()
    buckets = cut(buckets.unionByName(pair))
    held = found.join(buckets.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                x = [shingles(t) for t in part.column("t").to_pylist()]
                keys = [xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) for s in x]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in x], pa.binary())], ["key", "x"])

    texts = docs.select(column(docs, id_col).cast("long").alias("id"), blob(column(docs, text_col)).alias("t"))
    held = cut(texts.join(held, "id", "left_semi").select("t").mapInArrow(sets, "key long, x binary").dropDuplicates(["key"]))
    links, buckets = split_large(buckets, held)
    met = buckets.join(held, "key").select("bucket", "key", "x").repartition(n, "bucket").sortWithinPartitions("bucket")
    joined = met.mapInArrow(_links, "a long, b long")
    for x in links:
        joined = joined.unionByName(x)
    joined = components(joined)
    return found.join(joined, F.col("key") == F.col("node"), "left").select("id", F.coalesce("component", "key").alias("component"))
