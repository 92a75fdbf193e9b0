"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and padded with a blank at both ends; its 1-, 2- and 3-grams are hashed to
``2**bits`` buckets.  Training counts buckets by language in each task (one dense matrix a
task) and adds them up by (language, bucket).  The log-probability matrix is broadcast, and texts are
scored by gathering their n-grams' rows and summing them by text in numpy, ``SPAN`` characters
and ``CELLS`` matrix cells at a time, so memory does not follow a text's length or the number of languages.

The training rows are a bounded sample: about ``max_per_lang`` texts a language, chosen by a hash of
the id with a rate set by the language's count.  Whole texts are read throughout.  Every language is
learned; more than the matrix has room for (``MATRIX_BYTES``; 512 at 15 bits) are an error, which fewer ``bits`` avoid.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; so is every text when
there is no training row.  The score is the winner's posterior probability with the likelihood
taken by its geometric mean over n-grams, so it stays comparable across lengths.  Repeated rows
repeat; ties go to the language first by code point; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import blob, chunks, column

LETTER = regex.compile(r"\p{L}")
ORDERS = (1, 2, 3)
#: The broadcast matrix has at most this many bytes.
MATRIX_BYTES = 64 << 20
#: Characters and matrix cells that are held at a time.
SPAN, CELLS = 1 << 18, 1 << 22


def spans(text: str) -> Iterator[tuple[str, int]]:
    """A padded text in parts: (characters, how many of them begin n-grams here); the rest begin theirs in the next part."""
    padded = f" {text.lower()} "
    for at in range(0, len(padded), SPAN):
        part = padded[at : at + SPAN + ORDERS[-1] - 1]
        yield part, min(SPAN, len(padded) - at)


def gram_buckets(parts: list[tuple[str, int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of parts of texts, one after another, and each part's number of them."""
    sizes = np.array([len(t) for t, _ in parts])
    ends = np.cumsum(sizes)
    c = np.frombuffer("".join(t for t, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(ends, sizes) - np.arange(len(c))  # characters up to the part's end
    begins = left > np.repeat(sizes - [n for _, n in parts], sizes)
    h, grams, keep = np.zeros(len(c), np.uint64), [], []
    for n in ORDERS:
        shifted = np.zeros(len(c), np.uint64)
        shifted[: len(c) - n + 1] = c[n - 1 :]
        h = (h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        grams.append((h >> np.uint64(64 - bits)).astype(np.int32))
        keep.append(begins & (left >= n))
    grams, keep = np.stack(grams, 1).ravel(), np.stack(keep, 1).ravel()
    upto = np.r_[0, np.cumsum(keep)][ends * len(ORDERS)]
    return grams[keep], np.diff(np.r_[0, upto])


def batches_of(texts: list[str]) -> Iterator[tuple[list[int], list[tuple[str, int]]]]:
    """Parts of texts, some SPAN characters at a time, with the places of their texts."""
    who, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in spans(t):
            who.append(i)
            parts.append(part)
            size += part[1]
            if size >= SPAN:
                yield who, parts
                who, parts, size = [], [], 0
    if parts:
        yield who, parts


@dataclass(frozen=True)
class Model:
    langs: list[str]
    bits: int
    matrix: np.ndarray  # (buckets, langs) log probabilities
    prior: np.ndarray


def fit(docs: DataFrame, training: Column, *, bits: int = 15, max_per_lang: int = 20_000, smoothing: float = 0.5,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` where ``training`` holds and text and lang are not null."""
    rows = docs.where(training).where(column(docs, text_col).isNotNull() & column(docs, lang_col).isNotNull())
    rows = rows.select(column(docs, id_col).cast("string").alias("id"), blob(column(docs, text_col)).alias("t"), column(docs, lang_col).cast("string").alias("lang"))
    most = MATRIX_BYTES // (4 << bits)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages; their matrix has room at fewer bits than {bits}")
    langs = sorted(sizes)
    if not langs:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, max_per_lang / n)) for k, n in sizes.items()], "lang string, rate double")
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("id", "t", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << bits), np.int64)
        place = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            for part in chunks(batch, "t", 1 << 20):
                texts, lang = [t.decode("utf-8", "replace") for t in part.column("t").to_pylist()], [place[x] for x in part.column("lang").to_pylist()]
                for who, parts in batches_of(texts):
                    grams, n = gram_buckets(parts, bits)
                    cells, n = np.unique(np.repeat([lang[i] for i in who], n) << bits | grams, return_counts=True)
                    total.reshape(-1)[cells] += n
        lang, bucket = np.nonzero(total)
        for i in range(0, len(lang), 100_000):
            at = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang[at]), pa.array(bucket[at]), pa.array(total[lang[at], bucket[at]])], ["lang", "bucket", "n"])

    made = chosen.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most langs x buckets rows
    counts = np.full((1 << bits, len(langs)), smoothing)
    np.add.at(counts, (made["bucket"].to_numpy(np.int64), made["lang"].to_numpy(np.int64)), made["n"].to_numpy(float))
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return Model(langs, bits, np.log(counts / counts.sum(0)).astype(np.float32), prior)


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if t and model.langs and LETTER.search(t)]
    logs, count = np.zeros((len(at), len(model.langs))), np.zeros(len(at))
    step = max(1, CELLS // max(1, len(model.langs)))
    for who, parts in batches_of([texts[i] for i in at]):
        grams, n = gram_buckets(parts, model.bits)
        owner = np.repeat(who, n)
        count += np.bincount(owner, minlength=len(at))
        for i in range(0, len(grams), step):
            own = owner[i : i + step]  # in order of texts
            first = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            logs[own[first]] += np.add.reduceat(model.matrix[grams[i : i + step]].astype(np.float64), first, axis=0)
    if at:
        best = np.argmax(logs + model.prior, axis=1)
        p = np.exp((logs - logs[np.arange(len(at)), best][:, None]) / np.sqrt(count)[:, None])  # damped: grams overlap and depend on one another
        p /= p.sum(1, keepdims=True)
        for k, i in enumerate(at):
            lang[i], score[i] = model.langs[best[k]], float(p[k, best[k]])
    return lang, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; reads nothing but the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t", 1 << 20):
                lang, score = predict_texts(held.value, [t if t is None else t.decode("utf-8", "replace") for t in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    d = docs.select(column(docs, id_col).alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))
