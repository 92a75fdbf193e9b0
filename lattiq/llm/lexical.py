"""Ranked lexical search over a hierarchical max tree per term, by best-first branch and bound.

Documents are indexed in blocks (consecutive rows, at most ``BLOCK_DOCS`` of them or ``BLOCK_BYTES`` of text, a longer one alone), and
within a block they stand in the order of their ids.  Each term has its postings in a block (document, occurrences).  Over
these stands a tree: a node covers a range of ``FAN`` documents, or of ``FAN`` nodes below it, and holds the largest
saturation (what an occurrence count is worth in a document of that length) of the term within its range.  Only nodes where the term occurs are
stored, and each points to its children's first.

A query's bound for a range is the sum over its terms of weight times the node's maximum: no document in the range scores
more.  The search opens the range with the highest bound first, of equal bounds the one with the smallest ids, and
ends when the next bound is below the k-th best score so far.  A range whose bound equals that score is opened
if it holds a smaller id than the k-th best document, so ties come out right and the copies of a
document need not be gone through.  The best k of all blocks that a task reads are kept together, and the tasks' results are merged.

Weights and lengths are statistics of all documents: N with a term at all, L terms in them, and each term's document frequency.

Defined results: a null or empty text has no terms and is never found, and a query without terms finds nothing; rows of the query
table that repeat an id are searched one by one; rows that repeat a doc_id are documents of their own; documents without an id are
found too, and of equal scores come last; extra columns are ignored; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import blob, column, cut

#: A-Z to a-z; what stands between terms to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK_DOCS = 1 << 16
BLOCK_BYTES = 32 << 20
FAN_BITS = 4
WIDTH = 64
#: A query chunk that is sent to all tasks has about so many terms; an index limited to the queries' terms has at most so many.
CHUNK_TERMS = 500_000
NO_ID = 1 << 63


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


_POSTINGS = "block long, n_docs long, n_terms long, ids binary, no_id int, sizes binary, terms array<binary>, dfs array<int>, at binary, tf binary"
_TREES = "ids binary, no_id int, terms array<binary>, levels int, node binary, top binary, first binary"


def _block(number: int, docs: list[tuple[int | None, int, np.ndarray]], names: list[bytes]) -> dict:
    """One row of the index from (doc_id, number of terms, its terms' numbers) by document."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    hits = [docs[i][2] for i in order]
    where = np.repeat(np.arange(len(order)), [len(h) for h in hits])
    key, tf = np.unique((np.concatenate([np.zeros(0, np.int64), *hits]) << 32) | where, return_counts=True)
    which, dfs = np.unique(key >> 32, return_counts=True)
    ids = [docs[i][0] for i in order]
    return {
        "block": number, "n_docs": len(docs), "n_terms": sum(d[1] for d in docs),
        "ids": np.array([x or 0 for x in ids], np.int64).tobytes(), "no_id": sum(x is None for x in ids), "sizes": np.array([docs[i][1] for i in order], np.int64).tobytes(),
        "terms": [names[i] for i in which.tolist()], "dfs": dfs.tolist(), "at": (key & 0xFFFFFFFF).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes(),
    }


def postings(docs: DataFrame, *, terms: list[bytes] | None = None, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows that have a term, a row a block; with ``terms``, these terms' postings alone (lengths count all)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(terms)
    schema = _arrow(spark, _POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        only = None if held.value is None else {t: i for i, t in enumerate(held.value)}
        table: dict[bytes, int] = defaultdict(itertools.count().__next__)
        block, size = [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(number, block, held.value if only is not None else list(table))], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("t"), strict=True):
                text = t.as_py()
                words = terms_of(text)
                if not words:
                    continue
                if block and (len(block) >= block_docs or size + len(text) > block_bytes):
                    yield close()
                    number, block, size = number + 1, [], 0
                    table.clear()
                    table.default_factory = itertools.count().__next__
                own = [x for x in map(only.get, words) if x is not None] if only is not None else list(map(table.__getitem__, words))
                block.append((i.as_py(), len(words), np.array(own, np.int64)))
                size += len(text)
        if block:
            yield close()

    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return d.mapInArrow(run, _POSTINGS)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def statistics(index: DataFrame) -> tuple[int, int]:
    """(N, L): documents with a term, and terms in them."""
    n, size = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return n, size


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all blocks."""
    return index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum(F.col("x.dfs").cast("long")).alias("df"))


def with_trees(index: DataFrame, n: int, size: int) -> DataFrame:
    """The index with each posting's saturation and the tree over it, from the nodes over documents to one root a term."""
    schema = _arrow(index.sparkSession, _TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, tf = np.frombuffer(row["at"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
                m = np.array([100 - 25 + 25 * int(x) * n // size for x in np.frombuffer(row["sizes"], np.int64)], np.int64)
                sat = (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])
                node, top, term = at, sat, np.repeat(np.arange(len(row["terms"])), row["dfs"])
                nodes, tops, firsts, begin, levels = [node], [top], [], 0, 0
                over = max(len(m) - 1, 0)
                while not levels or over:
                    over >>= FAN_BITS
                    node = node >> FAN_BITS
                    first = np.flatnonzero((node != np.r_[-1, node[:-1]]) | (term != np.r_[-1, term[:-1]]))
                    top = np.maximum.reduceat(top, first) if len(first) else top
                    firsts.append(begin + first)
                    begin += len(node)
                    node, term = node[first], term[first]
                    nodes.append(node)
                    tops.append(top)
                    levels += 1
                firsts.append(np.array([begin]))
                out = {k: row[k] for k in ("ids", "no_id", "terms")} | {"levels": levels}
                out |= {k: np.concatenate(x).astype(np.int32).tobytes() for k, x in (("node", nodes), ("top", tops), ("first", firsts))}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return index.select("ids", "no_id", "sizes", "terms", "dfs", "at", "tf").mapInArrow(run, _TREES)


@dataclass
class Block:
    """One block of the index, ready to be searched.

    ``node`` and ``top`` hold all postings (a document's place, its saturation), then the entries of each level up to the roots, one a term.
    Entry i's children begin at ``first[i - postings]`` and end where the next entry's begin.
    """

    ids: np.ndarray
    no_id: int
    levels: int
    node: np.ndarray
    top: np.ndarray
    first: np.ndarray
    roots: int

    @classmethod
    def read(cls, row: dict) -> Block:
        node, top, first = (np.frombuffer(row[k], np.int32).astype(np.int64) for k in ("node", "top", "first"))
        return cls(np.frombuffer(row["ids"], np.int64), row["no_id"], row["levels"], node, top, first, len(node) - len(row["terms"]))

    def order_of(self, place: int) -> int:
        """What documents of equal scores are ordered by."""
        return int(self.ids[place]) if place < len(self.ids) - self.no_id else NO_ID

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Put the block's documents among the ``best`` k, a heap of (score, -order), worst first; gives the number of ranges opened.

        The ranges at the head of the queue are opened some at a time: one at first, ``WIDTH`` at most.
        """
        fan, postings = 1 << FAN_BITS, len(self.node) - (len(self.first) - 1)
        entries = terms + self.roots
        queue = [(-int((weights * self.top[entries]).sum()), self.order_of(0), 0, self.levels - 1, entries, weights)]
        opened = 0
        while queue:
            heads = []
            while queue and len(heads) < min(WIDTH, opened + 1) and (len(best) < k or (-queue[0][0], -queue[0][1]) > best[0]):
                heads.append(heapq.heappop(queue))
            if not heads:
                break
            opened += len(heads)
            entries, weights = np.concatenate([h[4] for h in heads]), np.concatenate([h[5] for h in heads])
            first = self.first[entries - postings]
            n = self.first[entries - postings + 1] - first
            ends = np.cumsum(n)
            below = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
            weight = np.repeat(weights, n)
            slots = np.repeat(np.repeat(np.arange(len(heads)) * fan, [len(h[4]) for h in heads]), n) + (self.node[below] & (fan - 1))
            sums = np.zeros(len(heads) * fan, np.int64)
            np.add.at(sums, slots, weight * self.top[below])
            passing = sums >= (best[0][0] if len(best) == k else 1)
            leaf = np.repeat([h[3] == 0 for h in heads], fan)
            for slot in np.flatnonzero(passing & leaf).tolist():
                found = (int(sums[slot]), -self.order_of((heads[slot >> FAN_BITS][2] << FAN_BITS) | (slot & (fan - 1))))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            inner = passing & ~leaf
            if not inner.any():
                continue
            mine = np.flatnonzero(inner[slots])
            mine = mine[np.argsort(slots[mine], kind="stable")]
            own = slots[mine]
            starts = np.flatnonzero(own != np.r_[-1, own[:-1]])
            below, weight = below[mine], weight[mine]
            for a, b, slot in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], own[starts].tolist(), strict=True):
                _, _, node, level, _, _ = heads[slot >> FAN_BITS]
                child, bound = (node << FAN_BITS) | (slot & (fan - 1)), int(sums[slot])
                least = self.order_of(child << (FAN_BITS * level))
                if len(best) < k or (bound, -least) > best[0]:
                    heapq.heappush(queue, (-bound, least, child, level - 1, below[a:b], weight[a:b]))
        return opened


def query_terms(queries: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, term, times): each row of ``queries`` is a query of its own."""
    kind = queries.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count: dict[bytes, int] = defaultdict(int)
                for t in terms_of(row["t"]):
                    count[t] += 1
                n = len(count)
                yield pa.RecordBatch.from_arrays([pa.array([row["query"]] * n, pa.int64()), pa.array([row["item_id"]] * n, batch.schema.field("item_id").type), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())],
                                                 ["query", "item_id", "term", "times"])

    d = queries.select(F.monotonically_increasing_id().alias("query"), column(queries, id_col).alias("item_id"), blob(column(queries, text_col)).alias("t"))
    return cut(d.mapInArrow(run, f"query long, item_id {kind}, term binary, times long"))


def weighted(terms: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(query, item_id, term, weight): a term's weight by its document frequency, times its occurrences in the query; terms worth nothing are left out."""
    w = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    return terms.join(frequencies(index), "term").select("query", "item_id", "term", (w * F.col("times")).cast("long").alias("weight")).where("weight > 0")


def best_documents(trees: DataFrame, terms: DataFrame, *, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): each task's best k for each query of ``terms`` (query, item_id, term, weight), all sent to all tasks."""
    kind = terms.schema["item_id"].dataType.simpleString()
    found = terms.orderBy("query", "term").toArrow()  # one chunk: bounded by the caller
    held = trees.sparkSession.sparkContext.broadcast(found)
    type_ = found.schema.field("item_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        names, number = _numbered(q.column("term").to_pylist())
        rows = q.column("query").to_numpy()
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        ends, weights, items = np.r_[starts[1:], len(rows)][: len(starts)], q.column("weight").to_numpy(), q.column("item_id")
        best: list[list[tuple[int, int]]] = [[] for _ in starts]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                place = np.full(len(names), -1, np.int64)
                for i, t in enumerate(row["terms"]):
                    if t in names:
                        place[names[t]] = i
                for j, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    entries = place[number[a:b]]
                    has = entries >= 0
                    if has.any():
                        block.search(entries[has], weights[a:b][has], best[j], k)
        out = [(int(rows[s]), items[int(s)].as_py(), None if order == -NO_ID else -order, score) for s, own in zip(starts, best, strict=True) for score, order in own]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), type_, pa.int64(), pa.int64()), strict=True)], ["query", "item_id", "doc_id", "score"])

    return trees.mapInArrow(run, f"query long, item_id {kind}, doc_id long, score long")


def _numbered(terms: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    names: dict[bytes, int] = defaultdict(itertools.count().__next__)
    number = np.array([names[t] for t in terms], np.int64)
    return dict(names), number


def search(docs: DataFrame, queries: DataFrame, *, k: int = 20, block_docs: int = BLOCK_DOCS, chunk_terms: int = CHUNK_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every query, higher scores first, then smaller ids.

    The index holds the queries' terms alone where these are few enough to be sent to all tasks; its results are the same.
    """
    terms = query_terms(queries, id_col=item_col, text_col=item_text_col)
    distinct = terms.select("term").distinct()
    n_distinct, n_bytes, n_all = terms.agg(F.count_distinct("term"), F.coalesce(F.sum(F.length("term")), F.lit(0)), F.count("*")).first()
    few = n_distinct <= chunk_terms and n_bytes <= 64 << 20
    index = cut(postings(docs, terms=distinct.toArrow().column("term").to_pylist() if few else None, block_docs=block_docs, id_col=id_col, text_col=text_col))
    n, size = statistics(index)
    trees = with_trees(index, n, size)
    scored = cut(weighted(terms, index, n))
    chunks = max(1, -(-n_all // chunk_terms))
    found = None
    for i in range(chunks):
        part = best_documents(trees, scored.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == i), k=k)
        found = part if found is None else found.unionByName(part)
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(64)))
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    few_each = found.withColumn("r", rank("query", "salt")).where(F.col("r") <= k)
    return few_each.withColumn("rank", rank("query")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
