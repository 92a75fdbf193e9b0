"""Approximate nearest neighbours by inner product, with additive quantisation.

A vector is coded as a sum of ``books`` full-dimensional codewords, one from each codebook (many small
codebooks: at the same number of bits they lose less than few large ones, and cost less to search).
Codebooks start as residual k-means on a bounded sample and are then solved jointly by least
squares against beam-search codes.  Every vector is encoded by beam search; its code,
the ratio of its norm to its reconstruction's and the length of what is left are stored.  A query makes one lookup table (its inner
product with all codewords, two codebooks joined in one entry); a row's score is a sum of table entries times that ratio.
The ``rerank`` best rows of a block are scored again exactly, in double precision, on the original vectors.  So is every other row whose
score may, by ``slack`` standard errors (what is left of a row points anywhere, so its share along the query is about its length over the
root of the dimension), still reach the ``k``-th best of these: a shortlist is as long as it has to be, as in a large group of near copies.

All rows are indexed.  Equal vectors are one class, of which the smallest ids are kept: as many as a
result can hold, so nothing that could be returned is lost.  Index blocks and query blocks
meet as blocks, never as single rows: a block of rows moves once for each block of ``query_rows`` queries, and ``k + 1`` rows a query come back.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the
commonest length take no part; rows without an id take no part; a query's own row is no candidate, other rows of the same vector are;
repeated ids are one row; fewer candidates than ``k`` are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import column, cut


@dataclass(frozen=True)
class Quantiser:
    """Codebooks (books, words, dim), and the inner products of all codewords with each other."""

    codebooks: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return self.codebooks.reshape(-1, self.codebooks.shape[2])

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes (n, books) by beam search: at each book the ``beam`` best sums so far are kept, as what they leave of the vector."""
        n, dim = x.shape
        left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for c in self.codebooks:
            held = left.shape[1]
            step = ((c * c).sum(1) - 2 * (left.reshape(-1, dim) @ c.T).reshape(n, held, -1) + (left * left).sum(2)[:, :, None]).reshape(n, -1)
            width = min(beam, step.shape[1])
            best = np.argpartition(step, width - 1, axis=1)[:, :width]
            of, word = best // len(c), best % len(c)
            left = np.take_along_axis(left, of[:, :, None], 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), (left * left).sum(2).argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.codebooks[m][codes[:, m]] for m in range(len(self.codebooks)))


def train(x: np.ndarray, books: int = 64, words: int = 16, rounds: int = 6, seed: int = 7) -> Quantiser:
    """Residual k-means, then one joint least-squares solution for all codebooks given beam-search codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    left, out = x.copy(), []
    for _ in range(books):
        c = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            own = np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)
            n = np.bincount(own, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, own, left)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        left = left - c[np.argmin((c * c).sum(1) - 2 * left @ c.T, axis=1)]
        out.append(c)
    q = Quantiser(np.stack(out))
    ridge, rest = 1e-1 * np.eye(books * words, dtype=np.float32), np.zeros_like(q.flat)
    for i in range(0, len(x), 4096):  # all rows, some at a time
        part = x[i : i + 4096]
        hot = np.zeros((len(part), books * words), np.float32)
        np.put_along_axis(hot, q.encode(part).astype(np.int64) + np.arange(books) * words, 1, axis=1)
        ridge += hot.T @ hot
        rest += hot.T @ (part - hot @ q.flat)
    flat = q.flat + np.linalg.solve(ridge, rest)
    return Quantiser(flat.reshape(q.codebooks.shape).astype(np.float32))


def scores(q: np.ndarray, codebooks: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Scores (queries, rows) by lookup tables; codes are (rows, books)."""
    books, words, dim = codebooks.shape
    tables = (codebooks.reshape(-1, dim) @ q.T).reshape(books, words, -1)
    if books % 2 == 0 and words <= 16:  # two codebooks at once
        tables = (tables[0::2, :, None] + tables[1::2, None, :]).reshape(books // 2, words * words, -1)
        codes = codes[:, 0::2].astype(np.int64) * words + codes[:, 1::2]
    out = np.zeros((len(codes), q.shape[0]), np.float32)
    for table, code in zip(tables, codes.T, strict=True):
        out += table[code]
    return np.ascontiguousarray((out * ratio[:, None]).T)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, each id once; v keeps single precision where the table has it."""
    v = column(rows, vector_col)
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    d = rows.select(column(rows, id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    dims = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.where(F.size("v") == (dims["n"] if dims else 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long lists, in double precision."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def search(rows: DataFrame, queries: DataFrame, *, k: int = 20, rerank: int = 64, slack: float = 3.0, sample: int = 8192, books: int = 64, words: int = 16,
           block_rows: int = 16_384, query_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by inner product, ties to the smaller id.

    ``queries`` are rows of the same table.  ``sample`` bounds the rows that the codebooks are fitted on.
    Blocks are smaller than ``block_rows`` where that gives tasks to all cores; results do not depend on them.
    """
    spark = rows.sparkSession
    d = cut(usable(rows, id_col, vector_col))
    if d.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Classes of equal vectors: a result holds at most k rows of one, and may have to skip the query itself.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = cut(d.withColumn("nth", place).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("first", F.get("ids", F.lit(0))))
    n = classes.count()
    rate = min(1.0, 1.1 * sample / n)
    fitted = classes.where(F.pmod(F.xxhash64("first"), F.lit(1 << 20)) < int(rate * (1 << 20))).select("v", "first").orderBy(F.xxhash64("first")).limit(sample).toPandas()
    model = spark.sparkContext.broadcast(train(np.array(fitted["v"].tolist()), books, words))
    wanted = cut(d.join(queries.select(column(queries, id_col).cast("long").alias("id")).distinct(), "id", "left_semi"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n_q = max(1, -(-wanted.count() // query_rows))
    n_i = max(1, -(-n // min(block_rows, max(1024, n * n_q // (2 * tasks)))))

    kind = np.float32 if d.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = matrix(part, "v")
                x = v.astype(np.float32)
                codes = model.value.encode(x)
                found = model.value.decode(codes)
                norm = np.linalg.norm(found, axis=1)
                ratio = np.divide(np.linalg.norm(x, axis=1), norm, out=np.ones_like(norm), where=norm > 0)
                left = np.linalg.norm(x - found * ratio[:, None], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("first"), pa.array([c.tobytes() for c in codes]), pa.array(ratio.astype(np.float32)), pa.array(left.astype(np.float32)), pa.array([r.tobytes() for r in v.astype(kind)])], ["first", "code", "ratio", "left", "x"])

    def pack_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        flat = lambda c, t: [pdf[c].to_numpy(t).tobytes()]
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "firsts": flat("first", np.int64), "codes": [b"".join(pdf["code"])], "ratio": flat("ratio", np.float32), "left": flat("left", np.float32), "x": [b"".join(pdf["x"])]})

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"q": pdf["q"].iloc[:1], "ids": [pdf["id"].to_numpy().tobytes()], "qx": [np.array(pdf["v"].tolist(), kind).tobytes()]})

    block = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    index = classes.select("first", "v").mapInArrow(code, "first long, code binary, ratio float, left float, x binary").withColumn("i", block("first", n_i))
    index = cut(index.groupBy("i").applyInPandas(pack_rows, "i int, firsts binary, codes binary, ratio binary, left binary, x binary"))
    asked = cut(wanted.withColumn("q", block("id", n_q)).groupBy("q").applyInPandas(pack_queries, "q int, ids binary, qx binary"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = index.withColumn("q", every(n_q)).hint("merge").join(asked.withColumn("i", every(n_i)).hint("merge"), ["q", "i"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, firsts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["firsts"], np.int64)
                ratio, left = np.frombuffer(r["ratio"], np.float32), np.frombuffer(r["left"], np.float32)
                q, x = np.frombuffer(r["qx"], kind).reshape(len(ids), -1), np.frombuffer(r["x"], kind).reshape(len(firsts), -1)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(firsts), -1)
                for at in range(0, len(q), 64):
                    out = nearest(q[at : at + 64], x, scores(q[at : at + 64].astype(np.float32), model.value.codebooks, codes, ratio), left, firsts, k + 1, rerank, slack)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + out[0]]), pa.array(firsts[out[1]]), pa.array(out[2])], ["query_id", "first", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    found = pairs.repartition(tasks, "q", "i").mapInArrow(meet, "query_id long, first long, score double").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    found = found.join(classes.select("first", "ids"), "first").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(q: np.ndarray, x: np.ndarray, who: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Inner products of pairs, in double precision, some pairs at a time."""
    out = np.empty(len(who))
    for i in range(0, len(who), 1 << 15):
        at = slice(i, i + (1 << 15))
        out[at] = (x[what[at]].astype(np.float64) * q[who[at]].astype(np.float64)).sum(1)
    return out


def nearest(q: np.ndarray, x: np.ndarray, rough: np.ndarray, left: np.ndarray, firsts: np.ndarray, k: int, rerank: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` best rows of a block, ties to the smaller id."""
    n = rough.shape[1]
    top = max(0, n - max(rerank, k))
    best = np.argpartition(rough, top, axis=1)[:, top:]
    score = exact(q, x, np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()).reshape(best.shape)
    least = np.sort(score, axis=1)[:, -min(k, score.shape[1])]
    reach = (slack / np.sqrt(x.shape[1])) * left
    may = rough + np.linalg.norm(q, axis=1).astype(np.float32)[:, None] * reach >= least[:, None].astype(np.float32)
    np.put_along_axis(may, best, True, axis=1)
    who, what = np.nonzero(may)
    score = exact(q, x, who, what)
    order = np.lexsort((firsts[what], -score, who))
    who, what, score = who[order], what[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], what[keep], score[keep]
