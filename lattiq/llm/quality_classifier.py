"""Quality by hierarchical empirical Bayes: document evidence under host and path posteriors.

1. A linear classifier, fitted on a bounded sample of labelled rows, gives each document's log
   odds of being good.  It reads shares that tell how clean a text looks and, given these, its hashed words: the
   words' weights correct what the shares miss.  Less the labels' prior log odds, that is the document's evidence.
2. Grouped sums of the documents' probabilities give each path's and each host's rate.
   A host's posterior rate is its rate shrunk toward the global one, a path's is shrunk toward its
   host's; how strongly follows from the spread between groups (method of moments), so
   sparse sites hold to their priors.
3. A document's quality is its evidence under its path's posterior.

Groups are summed on the map side; a host with a third of all rows is one row a task.  The
posteriors are joined back by path; the table is written first, so the join knows its size.

Defined results: a null text counts as an empty one; null hosts and paths are groups of their own;
repeated rows repeat; a text's words are a set, so ties and order cannot change its evidence; a very long text is read whole, in
memory that follows its own length; without usable labels every document has the prior 0.5 and is kept; an
empty table gives an empty result; extra columns are ignored or, in ``keep_good``, carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import BLANK_BYTES, blob, chunks, column, cut
from lattiq.llm.linear import Rows, SparseLogistic, sigmoid, word_features

SYMBOLS = b"#*$%&|<>"
MARKS = re.compile(rb"[!?]{2,}|[#*$%&|<>]+")
N_FEATURES = 10


def features(text: bytes | None) -> list[float]:
    """What makes a text look clean or not, as shares between 0 and about 1."""
    t = text or b""
    words = t.split()
    n, size = max(len(words), 1), max(len(t), 1)
    lines = [x.strip(BLANK_BYTES) for x in t.split(b"\n")]
    lines = [x for x in lines if x]
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    upper = sum(w.isupper() for w in words)
    blanks = sum(t.count(c) for c in (b" ", b"\n"))
    return [
        1.0,
        upper / n,
        min(1.0, 4 * sum(t.count(bytes([c])) for c in SYMBOLS) / n),
        min(1.0, len(MARKS.findall(t)) / n),
        len(set(words)) / n,
        pairs / max(len(words) - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        min(1.0, np.log1p(len(words)) / 8),
        min(1.0, (size - blanks) / n / 16),
        float(len(words) < 50),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)) * max(len(y), 1) ** 0.5
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * max(len(y), 1) ** 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # of the shares
    words: SparseLogistic | None
    prior: float  # log odds of all labels

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        """The log odds that each text adds to the prior, kept within 15."""
        z = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES) @ self.weights - self.prior
        if self.words is not None:
            z = z + self.words.logit(Rows.of([word_features((t or b"").decode("utf-8", "replace")) for t in texts]), np.zeros((len(texts), 0)))
        return np.clip(z, -15, 15)


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 5000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fit on at most about ``max_per_class`` labelled rows a class, chosen by a hash of the id.

    The prior is that of all labels; the weights' constant is moved from the sample's prior to it.
    """
    one = labels.select(column(labels, id_col).cast("long").alias("id"), column(labels, label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    one = one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, max_per_class / n))) for k, n in sizes.items()], F.lit(0.0))
    chosen = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20))
    d = docs.select(column(docs, id_col).cast("long").alias("id"), blob(column(docs, text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                texts = part.column("t").to_pylist()
                buckets = [word_features((t or b"").decode("utf-8", "replace")).astype(np.int32).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([features(t) for t in texts], pa.list_(pa.float64())), pa.array(buckets, pa.binary())], ["y", "x", "f"])

    # Of rows that repeat a labelled id one is fitted: that with the text of the smallest hash.
    one_each = d.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("r"))
    rows = one_each.select("r.t", "r.y").mapInArrow(run, "y int, x array<double>, f binary").toArrow()
    y, found = rows.column("y").to_numpy().astype(float), rows.column("f").to_pylist()
    if len(np.unique(y)) < 2:
        return Classifier(np.zeros(N_FEATURES), None, 0.0)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), N_FEATURES)
    order = np.lexsort([np.array([zlib.crc32(f) for f in found]), *x.T, y])  # the same sums whatever order the rows came in
    x, y = x[order], y[order]
    weights, prior = fit_logistic(x, y), float(np.log(sizes[1] / sizes[0]))
    buckets = Rows.of([np.frombuffer(found[i], np.int32) for i in order])
    words = SparseLogistic().fit(buckets, np.zeros((len(y), 0)), y, offset=x @ weights)
    weights[0] += prior - float(np.log(y.mean() / (1 - y.mean())))
    return Classifier(weights, words, prior)


def evidence(model: Classifier):
    """An Arrow function from texts to the log odds that the classifier adds to its prior."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_t"):
                z = held.value.evidence(part.column("_t").to_pylist())
                at = part.schema.names.index("_t")
                keep = [i for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(z)], names=[*[part.schema.names[i] for i in keep], "_z"])

    held = SparkSession.active().sparkContext.broadcast(model)
    return run


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(groups: DataFrame, rate: Column, toward: Column, n: Column) -> float:
    """How many documents a prior is worth: p(1-p) over the variance between groups beyond sampling's, kept within 1 and 10,000."""
    far, noise = (rate - toward) ** 2, toward * (1 - toward)
    r = groups.agg(F.sum(n * far).alias("s"), F.sum(noise).alias("e"), F.sum(n).alias("n"), F.sum(n * noise).alias("v")).first()
    if not r["n"]:
        return 1.0
    between = max((r["s"] - r["e"]) / r["n"], 1e-9)
    return float(min(max((r["v"] / r["n"]) / between, 1.0), 1e4))


def posteriors(scored: DataFrame, prior: float) -> DataFrame:
    """(host, path, host_rate, path_rate): posterior rates from rows (host, path, z)."""
    p = 1 / (1 + F.exp(-(F.col("z") + F.lit(prior))))
    # Millionths, so that sums do not depend on the order of rows.
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(p * 1e6).cast("long")).alias("s")))
    paths = paths.select("host", "path", "n", (F.col("s") / 1e6).alias("s"))
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    overall = F.lit((total[1] or 0.0) / total[0] if total[0] else 0.5)
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    a = strength(hosts, F.col("hs") / F.col("hn"), overall, F.col("hn"))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + a * overall) / (F.col("hn") + a))
    both = paths.join(hosts.select(F.col("host").alias("h"), "host_rate"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    b = strength(both, F.col("s") / F.col("n"), F.col("host_rate"), F.col("n"))
    return cut(both.select("host", "path", "host_rate", ((F.col("s") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate")))


def judged(docs: DataFrame, model: Classifier, *, host: Column, path: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, kept) for each row; with ``carry``, the row itself as ``row``."""
    d = docs.select(host.cast("string").alias("host"), path.cast("string").alias("path"), column(docs, id_col).alias("doc_id"), blob(column(docs, text_col)).alias("_t"),
                    *([F.struct(*[column(docs, c) for c in docs.columns]).alias("row")] if carry else []))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "_t")
    # Written once, so that no text is scored twice: first for the rates, then for its own verdict.
    scored = cut(d.mapInArrow(evidence(model), f"{kinds}, _z double").withColumnRenamed("_z", "z"))
    rates = posteriors(scored.select("host", "path", "z"), model.prior).withColumnsRenamed({"host": "h", "path": "p"})
    out = scored.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    quality = 1 / (1 + F.exp(-(F.col("z") + logit(F.coalesce("path_rate", F.lit(0.5))))))
    return out.select("doc_id", F.col("z").alias("evidence"), "host_rate", "path_rate", quality.alias("quality"), (quality >= threshold).alias("kept"), *(["row"] if carry else []))


def keep_good(docs: DataFrame, model: Classifier, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is kept."""
    return judged(docs, model, carry=True, **options).where("kept").select("row.*")
