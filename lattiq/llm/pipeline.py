"""A corpus pipeline over ``documents``: quality, line dedup, near-dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  A stage's working tables stand in the shared folder while its result is
written; they are removed when the same thread calls the next stage, so a result must be written before that.

Defined results, for each stage: rows without an id are documents like others (line dedup takes them
for one document, as its operator says; near-dedup lets them give way to copies that have an id); null and empty texts are
judged as empty ones, lose no line, are near copies of each other and take no part in the mix; rows that
repeat are one near copy, while different texts of one id stay apart; ties go to the smaller id; very long texts go through whole; extra
columns, whatever their names, do not pass the first stage; an empty table stays empty.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import line_dedup, mixing, near_copies, quality_classifier, sentencepiece
from lattiq.llm.common import cut, noted, remove, shared_folder, table

#: The working tables of the stage before.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def working(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; it removes the tables that the stage before has worked with, and remembers its own."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _LEFT.get():
            remove(spark, path)
        own: list[str] = []
        try:
            with noted(own):
                return stage(spark, docs, sf_dir)
        finally:
            _LEFT.set(tuple(own))

    return run_stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@working
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model, host=docs["source"], path=docs["lang"]).select(*COLUMNS)


@working
def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document left without a word goes."""
    index = line_dedup.insert(line_dedup.empty(spark), docs)
    d = line_dedup.dedup_lines(docs, index).withColumnRenamed("kept_text", "text")
    lost = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return d.where(~lost).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@working
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more) one row stays: that with the smallest id.

    Candidates are what SimHash's covering search links and, as most pairs at 0.8 differ in more bits than it covers, rows that
    share a band of min-hashes; all are checked exactly (see ``near_copies``).

    Rows are told apart by their content, not by their ids: rows without an id stay like others, but give way
    to copies that have one; rows of one id are copies only if their texts are; of rows that are equal throughout one stays.
    """
    docs = docs.select(*COLUMNS)
    d = docs.withColumn("_row", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    found = near_copies.near_copies(d, id_col="_row", text_col="text")
    ids = d.select("_row", "doc_id").join(found.groupBy("id", "component").agg(F.count("*").alias("n")), F.col("_row") == F.col("id"))
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "n")).alias("first"))
    stay = cut(first.select("first._row", "first.n"))
    alone = d.join(stay.where("n = 1"), "_row", "left_semi")
    repeated = d.join(stay.where("n > 1"), "_row", "left_semi").groupBy("_row").agg(*[F.first(c).alias(c) for c in COLUMNS])
    return alone.unionByName(repeated).select(*COLUMNS)


@working
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights: a document for each time that parts of one are taken."""
    d = mixing.mixed_documents(mixing.mix(docs, carry=("lang",)))
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@working
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's texts as token ids."""
    model = sentencepiece.read_model(sentencepiece.default_model())
    encoded = sentencepiece.encode(docs, model)
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", token_ids),
]

#: Fitted models decide what the stages keep, which SQL cannot say; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's table goes when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
