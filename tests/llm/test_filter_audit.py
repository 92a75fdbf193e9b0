"""The filter audit against orders that are gone through document by document, and against its SQL."""

import itertools
import random

import duckdb
import pytest

from lattiq.llm import filter_audit
from lattiq.llm.queries import op12_filter_audit
from lattiq.llm.sql import filter_audit_sql

DOCS = "doc_id long, text string, source string, mask int, part string, good int"
KEYS = ("part", "filter_order", "step")


def texts(rng):
    base = [" ".join(f"w{rng.randrange(n)}" for _ in range(k)) for n, k in ((500, 60), (20, 60), (500, 20), (3, 51), (50, 49), (50, 50))]
    base += [base[0] + " #", base[1].upper(), base[2] + "%", "ABC DEF", "", " \t\n\x0b ", None, "é" * 95 + "A" * 5, "é" * 94 + "A" * 6, "a\x85b " * 60, "|" * 70]
    return base


def rows(rng, n=120):
    base = texts(rng)
    out = [(i, rng.choice(base), rng.choice(["a", "b", None, "", "z\n"]), 1, "x", 2) for i in range(n)]
    return out + [out[5], out[5], (7, "same id, other text", "a", 1, "x", 2), (None, base[0], "a", 1, "x", 2), (None, base[0], None, 1, "x", 2)]


def by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for part in {d[2] or "" for d in docs}:
        own = []
        for i, t, *_ in (d for d in docs if (d[2] or "") == part):
            t = t or ""
            w = t.encode().split()
            fails = ["A"] * (len(w) < 50) + ["B"] * (100 * len(set(w)) < 65 * len(w)) + ["C"] * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
            fails += ["D"] * any(c in t for c in "#$%&*|") + ["E"] * (i is not None and first[t] < i)
            own.append((set(fails), i in good, i in toxic))
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    docs = rows(rng)
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_equals_going_through_all_orders(spark, case, tmp_path):
    docs, labels = case
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_filter_audit(spark, str(tmp_path))
    assert dict(got.dtypes) == {c: {"part": "string", "filter_order": "string", "step": "int"}.get(c, "bigint") for c in got.columns}
    found = got.collect()
    want = by_hand(docs, labels)
    assert len(found) == len(want) == 600 * len({d[2] or "" for d in docs})
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[k] for k in KEYS): [r[c] for c in counts] for r in found} == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names = [*KEYS, *counts]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({filter_audit_sql()})").fetchall()) == sorted(tuple(r[c] for c in names) for r in found)


def test_cells_are_exact_and_empty_tables_have_no_parts(spark, case):
    docs, labels = case
    d = spark.createDataFrame(docs, DOCS)
    m = filter_audit.masks(d)
    by_mask = {(r.part, r["mask"]): r["count"] for r in m.groupBy("part", "mask").count().collect()}
    own = filter_audit.labelled(m, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert own.count() == len(docs)
    for r in filter_audit.cells(filter_audit.parity_sums(own)).collect():
        assert r["all"] == [by_mask.get((r.part, k), 0) for k in range(32)]
    assert filter_audit.audit(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_a_very_long_text_and_many_copies(spark):
    d = spark.createDataFrame([(1, "Word " * 400_000, "s"), (2, "Word " * 400_000, "s")] + [(i, "copy", "s") for i in range(3, 3003)], "doc_id long, text string, source string")
    got = {r["mask"]: r["count"] for r in filter_audit.masks(d).groupBy("mask").count().collect()}
    assert got == {6: 1, 22: 1, 1: 1, 17: 2999}
