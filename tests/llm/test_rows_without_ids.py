"""Null and repeated ids where they once changed results: links, shared lines, fitted samples."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from lattiq.llm import line_dedup, quality_classifier, simhash, toxicity
from lattiq.llm.queries import op6_line_dedup, op7_simhash
from lattiq.llm.sql import line_dedup_sql


def chain(rng, n, words=400):
    """Texts of which each is near the next one only."""
    base = [f"{rng.getrandbits(40):x}" for _ in range(words)]
    out = [" ".join(base)]
    while len(out) < n:
        for _ in range(2000):
            new = list(base)
            new[rng.randrange(words)] = f"{rng.getrandbits(40):x}"
            last, now = (simhash.fingerprint(" ".join(x).encode()) for x in (base, new))
            if 0 < (last ^ now).bit_count() <= 3 and all((now ^ simhash.fingerprint(t.encode())).bit_count() > 3 for t in out[:-1]):
                break
        else:
            break
        base = new
        out.append(" ".join(base))
    return out


def brute(rows):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def test_simhash_links_go_through_rows_without_ids(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(30):x}" for _ in range(50))) for i in range(60)]
    rows += [(201 + i, rows[i][1].rsplit(" ", 1)[0] + " changed") for i in range(10)]
    links = chain(rng, 6)
    assert len(links) >= 4
    ids = [900, None, 800, None, 700, 600]
    rows += list(zip(ids, links, strict=False)) + [(None, "unlike any other row " * 9), (None, rows[3][1]), (None, None), (77, ""), (None, rows[5][1] + " x"), (None, "only nameless"), (None, "only nameless")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in op7_simhash(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_shared_lines_of_rows_without_ids(spark, tmp_path):
    line = [f"line number {k} that is long enough to be counted by all" for k in range(4)]
    rows = [(i, f"{line[0]}\nown {i}\n{line[1] if i < 4 else 'x'}") for i in range(6)]
    rows += [(None, f"{line[0]}\n{line[1]}\nnameless"), (None, f"{line[0]}\n{line[1]}\nnameless"), (None, f"\t{line[0].upper()} \n{line[2]}"), (None, None), (None, line[2])]
    rows += [(3, f"{line[2]}\n{line[0]}"), (10, f"{line[2]}"), (11, f"{line[2]}"), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op6_line_dedup(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(line_dedup_sql()).fetchall(), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (None, 3, 1, sha(f"{line[1]}\nnameless")) in got and (None, 2, 1, sha(line[2])) in got


def test_rows_without_ids_are_not_indexed(spark):
    docs = spark.createDataFrame([(None, "a line of at least forty characters, as it has to be")] * 9, "doc_id long, text string")
    index = line_dedup.insert(line_dedup.empty(spark, shards=2), docs)
    assert index.postings.count() == 0 and line_dedup.delete(index, docs.select("doc_id")).counts.count() == 0


def test_very_long_lines_and_very_many(spark):
    long, many = "x" * 3_000_000, "\n".join(f"{i} is a line of its own, long enough to be counted" for i in range(60_000))
    docs = spark.createDataFrame([(i, t) for i in range(5) for t in [f"{long}\n{many}"]], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, line_dedup.insert(line_dedup.empty(spark), docs)).collect()}
    assert got == {i: (60_001, 60_001 if i < 4 else 0) for i in range(5)}


@pytest.mark.parametrize("which", ["toxicity", "quality"])
def test_a_repeated_labelled_id_is_fitted_once(spark, which):
    rng = random.Random(9)
    text = lambda k: " ".join(rng.choice(["awful", "horrid", "nasty"] if k and rng.random() < 0.4 else ["river", "stone", "cloud", "meadow", "lamp"]) for _ in range(40))
    data = [(i, text(i % 2), "s", "en") for i in range(120)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    fit = toxicity.fit if which == "toxicity" else quality_classifier.fit
    once, often = (fit(frame(rows), labels, max_per_class=50) for rows in (data, data + [data[6]] * 3000))
    if which == "toxicity":
        assert once.shift == often.shift
        a, b = (sorted(map(tuple, toxicity.predict(frame(data), m).collect())) for m in (once, often))
        assert np.allclose(a, b, rtol=0, atol=1e-12) and any(r[-1] for r in a)
    else:
        assert np.allclose(once.weights, often.weights, rtol=0, atol=1e-12) and once.prior == often.prior
