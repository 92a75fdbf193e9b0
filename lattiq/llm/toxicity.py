"""Toxicity categories by a classifier chain.

The categories are predicted one after another.  Each one's linear model sees the words of
the text (hashed words and word beginnings) and the probabilities of the categories
before it.  In training those probabilities are out of fold: they come from models that did not
see the row, as at prediction time.  The categories are ``junk`` (labelled: quality 0), ``toxic`` (labelled)
and ``severe``: toxic, and with more than the usual number of words that go with toxic labels.  Which words these are
is learned from the labelled sample, by their log odds between toxic and other rows.

Training reads a bounded sample: at most about ``max_per_class`` labelled rows of each toxic class, chosen
by a hash of the id; the driver gets their buckets (at most 2**18 a text, four bytes each).  Prediction reads every whole text.

Defined results: a null or empty text has no words and gets the models' prior, which is not
toxic unless most labels are; without labels nothing is toxic; repeated rows repeat, and their predictions too; of rows that repeat a labelled id one is fitted; labels that
are null or disagree are left out of training; ties cannot change a sum, as a text's buckets are a set; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import blob, chunks, column
from lattiq.llm.linear import BITS, MIN_ROWS, Rows, SparseLogistic, sigmoid, word_features

CHAIN = ("junk", "toxic", "severe")
#: A bucket goes with toxic labels if it is so many times (as log odds) likelier in them.
GOES_WITH = 3.0


@dataclass(frozen=True)
class Chain:
    models: list[SparseLogistic]
    shift: float = 0.0  # log odds of toxic among labels less those in the training sample

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities (texts, categories)."""
        p = np.zeros((len(rows), 0))
        for m in self.models:
            p = np.concatenate([p, sigmoid(m.logit(rows, p))[:, None]], axis=1)
        return p


def severe(rows: Rows, toxic: np.ndarray) -> np.ndarray:
    """Toxic rows with more buckets that go with toxic labels than the median toxic row has."""
    owner = np.repeat(toxic, rows.sizes)
    n, n_toxic = (np.bincount(rows.buckets[owner >= k], minlength=1 << BITS) for k in (0, 1))
    share = lambda x, of: (x + 0.5) / (of + 1)
    gain = np.log(share(n_toxic, toxic.sum())) - np.log(share(n - n_toxic, (1 - toxic).sum()))
    load = rows.sums(((gain >= GOES_WITH) & (n >= MIN_ROWS)).astype(float))
    return toxic * (load > np.median(load[toxic == 1]) if toxic.any() else 0)


def fit_chain(rows: Rows, y: np.ndarray, folds: int = 4) -> Chain:
    """Fit the chain; earlier categories' probabilities are out of fold.  A label of -1 is not known."""
    fold = np.arange(len(y)) % folds
    before, models = np.zeros((len(y), 0)), []
    for k in range(y.shape[1]):
        known, out = y[:, k] >= 0, np.zeros(len(y))
        for f in range(folds):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero((fold != f) & known)
            if len(own) and k < y.shape[1] - 1:  # the last one feeds nothing
                m = SparseLogistic(k).fit(rows.take(rest), before[rest], y[rest, k])
                out[own] = sigmoid(m.logit(rows.take(own), before[own]))
        at = np.flatnonzero(known)
        models.append(SparseLogistic(k).fit(rows.take(at), before[at], y[at, k]))
        before = np.concatenate([before, out[:, None]], axis=1)
    return Chain(models)


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str = "quality") -> Chain:
    """Fit the chain on at most about ``max_per_class`` labelled rows of each toxic class."""
    labelled = lambda c: F.when(column(labels, c).cast("int").isin(0, 1), column(labels, c).cast("int"))
    quality = labelled(quality_col) if quality_col in labels.columns else F.lit(None).cast("int")
    one = labels.select(column(labels, id_col).cast("long").alias("id"), labelled(label_col).alias("y"), quality.alias("q")).where("id is not null and y is not null")
    one = one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.min("q").alias("q"), F.max("q").alias("r")).where("y = z")
    one = one.select("id", "y", F.when(F.col("q") == F.col("r"), 1 - F.col("q")).otherwise(F.lit(-1)).alias("junk"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, max_per_class / n))) for k, n in sizes.items()], F.lit(0.0))
    chosen = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20))
    d = docs.select(column(docs, id_col).cast("long").alias("id"), blob(column(docs, text_col)).alias("t")).where("t is not null")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                buckets = [word_features(t.decode("utf-8", "replace")).astype(np.int32).tobytes() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(buckets, pa.binary()), part.column("y"), part.column("junk")], ["id", "f", "y", "junk"])

    # The labelled ids are few and bounded, so they go to the texts; an id that repeats is fitted once, with the text of the smallest hash.
    one_each = d.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y", "junk")).alias("r"))
    found = one_each.select("id", "r.t", "r.y", "r.junk").mapInArrow(features, "id long, f binary, y int, junk int").toArrow()
    buckets, ids = found.column("f").to_pylist(), found.column("id").to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], buckets[i])), np.int64)
    rows, toxic, junk = Rows.of([np.frombuffer(buckets[i], np.int32) for i in order]), *(found.column(c).to_numpy().astype(np.int64)[order] for c in ("y", "junk"))
    chain = fit_chain(rows, np.stack([junk, toxic, severe(rows, toxic)], 1))
    odds = lambda a, b: np.log(max(a, 0.5) / max(b, 0.5))
    return Chain(chain.models, float(odds(sizes.get(1, 0), sizes.get(0, 0)) - odds(toxic.sum(), (1 - toxic).sum())))


def predict(docs: DataFrame, chain: Chain, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) for every row of ``docs``; ``toxic`` is the flag."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names, at = ["doc_id", *[f"p_{c}" for c in CHAIN], "toxic"], CHAIN.index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                p = held.value.predict(Rows.of([word_features((t or b"").decode("utf-8", "replace")) for t in part.column("t").to_pylist()]))
                odds = p[:, at] * np.exp(held.value.shift)
                p[:, at] = odds / (odds + 1 - p[:, at])  # the later category is trained on the sample's own odds
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p[:, i]) for i in range(len(CHAIN))], pa.array(p[:, at] >= threshold)], names)

    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return d.mapInArrow(run, ", ".join(["doc_id long", *[f"p_{c} double" for c in CHAIN], "toxic boolean"]))
