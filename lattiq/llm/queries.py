"""The text operators' registered queries: name -> f(spark, sf_dir), and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import ann, byte_bpe, chat, language_id, lexical, line_dedup, quality_classifier, sentencepiece, toxicity
from lattiq.llm.common import table
from lattiq.llm.filter_audit import audit
from lattiq.llm.mixing import mix, taken
from lattiq.llm.quality_rules import quality_rules
from lattiq.llm.simhash import simhash
from lattiq.llm.sql import chat_sql, filter_audit_sql, lexical_sql, line_dedup_sql, mixing_sql, quality_rules_sql


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Encodes all documents, decodes the ids, and gives digests of both; the texts' own digest shows the round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sentencepiece.read_model(model_file or sentencepiece.default_model())
    return sentencepiece.digests(sentencepiece.decode(sentencepiece.encode(docs, model), model))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(chat.HOSTILE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(own.unionByName(hostile)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("js_chars", "js_words")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.insert(line_dedup.empty(spark), docs)
    return line_dedup.dedup_lines(docs, index).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts; a source's languages are its paths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.judged(docs, model, host=docs["source"], path=docs["lang"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """Encodes all documents, decodes the ids, and gives digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.read_ranks(rank_file or byte_bpe.default_ranks())
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, ranks, byte_bpe.default_pattern()), ranks))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_mixing": op2_mixing,
        "op3_chat_format": op3_chat_format,
        "op4_quality_rules": op4_quality_rules,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_simhash": op7_simhash,
        "op8_ann_search": op8_ann_search,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_id": op10_language_id,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_filter_audit": op12_filter_audit,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing_sql(),
        "op3_chat_format": chat_sql(),
        "op4_quality_rules": quality_rules_sql(),
        "op6_line_dedup": line_dedup_sql(),
        "op12_filter_audit": filter_audit_sql(),
        "op13_lexical_search": lexical_sql(),
    }
