"""Fitted text operators use all languages, all labels' prior and the whole sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import ann, language_id, quality_classifier


def test_more_than_a_thousand_languages_are_learned(spark):
    n = 1200
    d = spark.range(n).selectExpr("id as doc_id", "concat(char(65 + id % 26), ' text ', id) as text", "concat('l', id) as lang")
    assert len(language_id.fit(d, F.lit(True), bits=13).langs) == n


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MATRIX_BYTES", 2 * 4 << 15)
    d = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.fit(d, F.lit(True))


def test_prior_is_that_of_all_labels(spark):
    text = lambda y, i: " ".join(f"word{k}{i}" for k in range(60)) if y else "BUY!! " * 60
    data = [(i, text(i % 7 > 0, i), int(i % 7 > 0)) for i in range(1400)]
    d = spark.createDataFrame(data, "doc_id long, text string, quality int")
    part = quality_classifier.fit(d.drop("quality"), d.select("doc_id", "quality"), max_per_class=100)
    assert abs(part.prior - np.log(6)) < 1e-9
    whole = quality_classifier.fit(d.drop("quality"), d.select("doc_id", "quality"))
    x = [text(1, 1).encode(), text(0, 0).encode()]
    assert ((part.evidence(x) > -part.prior) == (whole.evidence(x) > -whole.prior)).all()


def test_codebooks_are_solved_on_all_rows(monkeypatch):
    seen = []
    encode = ann.Quantiser.encode
    monkeypatch.setattr(ann.Quantiser, "encode", lambda self, x, *a: (seen.append(x.copy()), encode(self, x, *a))[1])
    x = np.random.default_rng(1).normal(size=(5000, 8)).astype(np.float32)
    ann.train(x, books=2, words=8, rounds=1)
    assert (np.concatenate(seen) == x).all()
