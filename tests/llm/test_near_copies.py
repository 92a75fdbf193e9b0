"""The pipeline's near-dedup stage against brute force on whole shingle sets."""

import random

import pytest

from lattiq.llm import near_copies, pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """Smallest id of each row's component, by brute force over all pairs at 0.8."""
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    label = {i: i for i in sets}
    near = lambda a, b: not (a | b) or len(a & b) >= 0.8 * len(a | b)
    link = [(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])]
    while True:
        new = dict(label)
        for i, j in link:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def family(n_groups=12, copies=6, seed=3):
    """Texts of 100 words, with copies that have one to four words changed."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for k in range(copies):
            w = list(base)
            for at in rng.sample(range(100), k):
                w[at] = f"v{rng.randrange(5000)}"
            out.append((len(out), " ".join(w), "en", "s", 1))
    return out


def test_stage_finds_copies_at_five_words_and_four_fifths(spark):
    rows = [*family(), (1000, None, "en", "s", 0), (1001, " \n", "en", "s", 2), (1002, "two words", "en", "s", 9)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    want = {i for i, c in groups(rows).items() if i == c}
    assert {r.doc_id for r in got.collect()} == want
    assert got.columns == pipeline.COLUMNS


def boilerplate(n=24, seed=5):
    """Texts that share half of their words and are no copies; every third has a near copy."""
    rng = random.Random(seed)
    shared = [f"s{rng.randrange(5000)}" for _ in range(80)]
    out = []
    for i in range(n):
        own = [f"o{rng.randrange(50000)}" for _ in range(60)]
        out.append((2000 + 2 * i, " ".join(shared + own), "en", "s", 1))
        if i % 3 == 0:
            own[rng.randrange(60)] = "changed"
            out.append((2001 + 2 * i, " ".join(shared + own), "en", "s", 1))
    return out


@pytest.mark.parametrize("limit, rounds", [(1024, 3), (4, 2), (5, 0)])
def test_large_buckets_are_searched_whole(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(near_copies, "LIMIT", limit)
    monkeypatch.setattr(near_copies, "PIVOT", min(limit, 32))
    monkeypatch.setattr(near_copies, "MEETS", 3)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rows = family(n_groups=2, copies=20, seed=8) + boilerplate()
    got = near_copies.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    label = groups(rows)
    assert len(got) == len(rows)
    assert len({(r.component, label[r.id]) for r in got}) == len({r.component for r in got}) == len(set(label.values()))


@pytest.mark.parametrize("block, width", [(3, 10), (512, 8192)])
def test_blocks_link_all_close_pairs(block, width):
    sets = [near_copies.shingles(r[1].encode()) for r in family(n_groups=3, copies=9)]
    label = list(range(len(sets)))
    for i, j in near_copies.close_links(sets, block, width):
        label = [label[i] if x == label[j] else x for x in label]
    want = groups(family(n_groups=3, copies=9))
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in want for j in want)


def test_rows_without_an_id_and_repeated_ids(spark):
    rng = random.Random(4)
    t = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    row = lambda i, x: (i, x, "en", "s", 1)
    rows = [row(None, t[0]), row(None, t[1]), row(5, t[1]), row(7, t[2]), row(7, t[3]), row(8, t[4]), row(8, t[4]), row(8, t[4] + " more"), row(None, t[5]), row(None, t[5])]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    left = sorted(((r.doc_id or 0), r.text.removesuffix(" more")) for r in got)
    assert left == sorted([(0, t[0]), (5, t[1]), (7, t[2]), (7, t[3]), (8, t[4]), (0, t[5])])
