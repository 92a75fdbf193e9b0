"""Ranked lexical search against scoring every document, with ties, copies, nulls, odd characters and small blocks."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lattiq.llm import lexical
from lattiq.llm.queries import op13_lexical_search
from lattiq.llm.sql import lexical_sql

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score long, rank int, item_id string"


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    own = [(i, Counter(terms_of(t))) for i, t, *_ in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, size = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in own:
            m = 100 - 25 + (25 * length * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "1", "日本", "X")]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: "".join(rng.choices(words, weight)[0] + rng.choice([" ", ", ", "\n", "-", "\x7f", "_", "' "]) for _ in range(n))
    docs = [(i * 3 % 211, text(rng.randrange(0, 60)), 1, 1, "z") for i in range(211)]
    same = text(30)
    docs += [(300 + i, same, 1, 1, "z") for i in rng.sample(range(90), 90)] + [(7, same, 1, 1, "z")] * 2 + [(None, same, 1, 1, "z"), (None, text(9), 1, 1, "z"), (400, None, 1, 1, "z"), (401, " .,!", 1, 1, "z"), (402, text(30_000), 1, 1, "z")]
    rng.shuffle(docs)
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, same), (51, None), (52, "nowhere at all"), (53, ""), (3, text(5)), (None, text(6)), (54, "a a a A a b")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20])
@pytest.mark.parametrize("block_docs", [1, 13, 1 << 16])
def test_search_equals_scoring_every_document(spark, k, block_docs):
    docs, items = case(k)
    d, q = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, query int")
    found = lexical.search(d, q, k=k, block_docs=block_docs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(docs, items, k)


def test_many_chunks_and_an_index_of_all_terms_give_the_same(spark):
    docs, items = case(5)
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.search(d, q, k=5, chunk_terms=40, block_docs=50).collect()), key=str) == by_hand(docs, items, 5)


def test_the_query_and_its_sql(spark, tmp_path):
    docs, items = case(6)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, op13_lexical_search(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical_sql()})").fetchall(), key=str) == by_hand(docs, items, 20)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(d, q).collect()] == by_hand([(1, "a b")], [("x", "a")], 20)


def test_copies_are_not_gone_through():
    docs = [(i, 8, np.zeros(8, np.int64)) for i in range(4096)]
    row = lexical._block(0, docs, [b"t"])
    n = len(docs)
    sat = np.full(n, 1000)
    node, levels, nodes, firsts, begin = np.arange(n), 0, [np.arange(n)], [], 0
    while levels < 3:
        firsts.append(begin + np.arange(0, len(node), 16))
        begin += len(node)
        node = node[::16] >> 4
        nodes.append(node)
        levels += 1
    block = lexical.Block(np.arange(n), 0, levels, np.concatenate(nodes), np.full(sum(map(len, nodes)), 1000), np.concatenate([*firsts, [begin]]), begin)
    best = []
    opened = block.search(np.array([0]), np.array([3]), best, 20)
    assert row["n_docs"] == n and sorted(-o for _, o in best) == list(range(20)) and opened < 40 and set(sat) == {1000}
