"""The pipeline against plain Python that follows the stages' own decisions."""

import os
import random

import pytest

from lattiq.llm import pipeline, quality_classifier, sentencepiece
from tests.llm.test_near_copies import groups

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    first, good, lines, near, mixed, ids = out
    for d in out[1:-1]:
        assert d.columns == pipeline.COLUMNS
    model = quality_classifier.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id: r.kept for r in quality_classifier.judged(first, model, host=first["source"], path=first["lang"]).collect()}
    assert {r.doc_id for r in good.collect()} == {k for k, v in judged.items() if v}
    held = {}
    text = {r.doc_id: r.text for r in good.collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  (the fixture's upper-case letters outside A-Z stand in no shared line)
    for i, t in text.items():
        for x in t.split("\n"):
            held.setdefault(key(x), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))) for i, t in text.items()}
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, t in want.items() if t.split() or t == text[i]}
    label = groups([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i in label if label[i] == i}
    whole = {r.doc_id: r.text for r in near.collect()}
    assert all(set(r.text.split()) <= set(whole[r.doc_id].split()) for r in mixed.collect())
    v = sentencepiece.load(model=sentencepiece.read_model(sentencepiece.default_model()))
    assert sorted((r.doc_id, tuple(r.ids)) for r in ids.collect()) == sorted((r.doc_id, tuple(sentencepiece.encode_texts(v, [r.text])[0].tolist())) for r in mixed.collect())


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n=70: " ".join(f"{rng.choice(['river', 'stone', 'walks', 'under'])}{rng.randrange(900)}" for _ in range(n))
    labels = [(i, int(i % 5 > 0), 0) for i in range(60)]
    data = [(i, text() if q else "BUY NOW!! ### $$$ " * 30, "en", f"s{i % 3}", 1) for i, q, _ in labels]
    shared = "this line is shared by six documents here, and it is long enough to count"
    data += [(100 + i, f"{text()}\n{shared}", "en", "s1", 1) for i in range(6)]
    t = [text() for _ in range(5)]
    odd = [(None, t[0], None, None, 0), (None, t[1], "en", None, 0), (200, t[1], "en", "s0", 0), (201, t[2], "en", "s0", 0), (201, t[3], "de", "s0", 0), (202, t[4], "en", "s0", 0), (202, t[4], "en", "s0", 0)]
    odd += [(300, None, "en", "s0", 0), (301, "", "en", "s0", 0), (302, text(60_000), "en", "s2", 0)]
    d = spark.createDataFrame([(*r, "x", 1.0, 2) for r in data + odd], "doc_id long, text string, lang string, source string, n_chars long, k1 string, z double, row int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = [d]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    _, good, lines, near, mixed, ids = out
    for x in (good, lines, near, mixed):
        assert x.columns == pipeline.COLUMNS
    kept = sorted((r.doc_id, r.text or "") for r in good.where("doc_id is not null").collect())
    assert not {i for i, _ in kept} & {i for i, q, _ in labels if not q} and {i for i, q, _ in labels if q} <= {i for i, _ in kept}
    assert good.where("doc_id is null").count() == 2
    assert sum(shared in (r.text or "") for r in lines.collect()) == 1 and lines.where(f"doc_id = 105 and text like '%{shared}'").count() == 1
    left = [(r.doc_id, r.text) for r in near.collect()]
    assert (None, t[0]) in left and (None, t[1]) not in left and left.count((202, t[4])) == 1 and {(201, t[2]), (201, t[3])} <= set(left)
    assert sum(len((x or "").split()) for _, x in left if x) * 1.4 < sum(len(r.text.split()) for r in mixed.collect())
    assert {r.lang for r in mixed.where("doc_id = 201").collect()} <= {"en", "de"} and mixed.where("doc_id is null").count() >= 1
    assert ids.count() == mixed.count() and ids.where("n_ids <> size(ids)").isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_run_leaves_only_the_last_table(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    rows = pipeline.run(spark, SF)
    new = set(os.listdir(folder)) - before
    assert rows.count() > 100 and len(new) == 1 and [x for x in os.listdir(f"{folder}/{new.pop()}") if not x.startswith(".")] == ["mixing"]
