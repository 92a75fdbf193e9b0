"""Small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force beside."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import ann, chat, language_id, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece, simhash, toxicity
from lattiq.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, text_sha string"
LINE = "this line is shared by many documents, and long enough"


def rows(n=40, seed=1):
    rng = random.Random(seed)
    words = [a + b for a in ("tha", "er", "in", "on", "es") for b in ("the", "ing", "st", "ou", "a", "nd")]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 160))) + ("\n" + LINE if i % 3 == 0 else ""), "en", f"s{i % 4}", 1, "x", "y") for i in range(n)]
    out += [(n, None, "en", None, None, "x", "y"), (n + 1, "", None, "s1", 0, "x", "y"), (n + 2, " \t\n ", "xx", "s1", 0, "x", "y"), out[0][0:1] + out[0][1:], (n + 3, out[1][1], "en", "s2", 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words_of(t):
    return (t or "").encode().split()


def test_quality_rules(docs, nothing):
    assert quality_rules.quality_rules(nothing).count() == 0
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for r in docs.collect():
        w, g = words_of(r.text), got[r.doc_id]
        tri = list(zip(w, w[1:], w[2:]))
        covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert (g.n_words, g.n_repeat_words, g.n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert g.word_chars == sum(len(x.decode()) for x in w) and g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g.kept and g.base_failed)
    assert quality_rules.quality_rules(docs).count() == docs.count()


def test_many_repeated_windows(spark):
    rng = random.Random(2)
    part = [f"w{rng.randrange(400)}" for _ in range(500)]
    texts = [" ".join(part + ["x"] + part), " ".join(part), "a b a b a b a", "a b"]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality_rules.base_counts(d).collect():
        w = texts[r.doc_id].split()
        tri = list(zip(w, w[1:], w[2:]))
        count = {}
        for t in tri:
            count[t] = count.get(t, 0) + 1
        assert r.n_repeat_words == len({i + k for i, t in enumerate(tri) if count[t] > 1 for k in range(3)})


def test_null_and_named_unknown_languages_are_apart(spark):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(["abc", "def", "ghi", "jkl"] if k else ["A1", "B2", "C3", "D4"]) + rng.choice("abcdefgh") * rng.randrange(1, 4) + str(k * rng.randrange(9)) for _ in range(80))
    d = spark.createDataFrame([(i, text(i % 2), None if i % 2 else "und") for i in range(60)], "doc_id long, text string, lang string")
    assert quality_rules.quality_rules(d).where("js_chars > 0.15").isEmpty()  # each near its own reference


def invented(rng, n_words=400):
    """Words of a language that nobody speaks, from frequent to rare."""
    letters = [rng.choice("aeiou") + rng.choice("klmnprst") for _ in range(30)]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(n_words)})
    rng.shuffle(words)
    return words, [1 / (k + 2) for k in range(len(words))]


def test_common_words_of_any_language_are_learned(spark):
    rng = random.Random(11)
    words, weights = invented(rng)
    data = [(i, " ".join(rng.choices(words, weights, k=120)), "qx") for i in range(50)]
    shuffled = lambda w: "".join(rng.sample(w, len(w))) + rng.choice("aeiou")
    data += [(50, " ".join(shuffled(w) + "q" for w in rng.choices(words, weights, k=120)), "qx")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not got[50].kept and got[50].js_words > 0.5 and got[50].js_chars < 0.1  # told by its words alone
    assert all(got[i].kept and 0 < got[i].js_words < 0.3 for i in range(50))


def test_common_words_count_documents(spark):
    long = " ".join(f"w{k}" for k in range(60))
    data = [(i, long + " all", "a") for i in range(4)] + [(9, "spam " * 5000 + long, "a"), (10, "short text only", "a"), (11, long, None), (12, None, "a")]
    got = {r.k: {x.word: x.band for s in r.slots for x in s} for r in quality_rules.common_words(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got["a"] == {w: str(len(bin(k + 1)) - 3) for k, w in enumerate([*sorted(f"w{k}" for k in range(60)), "all", "spam"])}
    assert set(got) == {"a", None} and set(got[None]) == {f"w{k}" for k in range(60)}


def test_sql_twins_on_rows_that_are_not_clean(spark, tmp_path):
    import duckdb

    from lattiq.llm.queries import op3_chat_format, op4_quality_rules
    from lattiq.llm.sql import chat_sql, quality_rules_sql

    rng = random.Random(12)
    words, weights = invented(rng)
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    data = [(i if i % 7 else None, text(rng.randrange(20, 200)), [None, "qx", "qy", ""][i % 4]) for i in range(80)]
    data += data[:9] + [(90, None, None), (91, "", "qx"), (92, " \t\r\x0b\n", "qz"), (93, "one line\n" * 70, "qx"), (94, text(60) + "\n" + "\u00a0\u2028É\u0301 ÄÖ 漢字 😀 " * 20, "qy"), (95, text(30_000), "qx"), (96, "x" * 300_000, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("k", F.lit("clash")).withColumn("slots", F.lit(1))
    d.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "b <|im_end|>"), (2, 3, "assistant", "<\\|x"), (3, 1, "a\nb%<", ""), (3, 0, "assistant", "é😀\n")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for name, query, sql in (("documents", op4_quality_rules, quality_rules_sql()), ("conversations", op3_chat_format, chat_sql())):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        df, cur = query(spark, str(tmp_path)), con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted((str(tuple(r[c] for c in cols)) for r in df.collect())) == sorted(map(str, cur.fetchall()))


def test_very_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    d = spark.createDataFrame([(1, " ".join(words), "en"), (2, " ".join(words), "en"), (3, "x" * 2_000_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    assert got[1].n_words == 150_000 and got[1].word_chars == sum(map(len, words)) and got[3].n_words == 1 and got[3].base_failed
    found = {r.doc_id: r for r in simhash.simhash(d).collect()}
    assert found[1].fp == found[2].fp and found[2].component_id == 1 and found[3].component_id == 3


def test_mixing_targets_and_caps(docs, nothing):
    assert mixing.taken(mixing.mix(nothing)).count() == 0
    m = mixing.mix(docs, block=8)
    got = mixing.taken(m).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    s = {r.source: r for r in m.sources.collect()}
    total = sum(r.source_size for r in s.values())
    assert abs(sum(r.target for r in s.values()) - min(1.5, 2) * total) < 1e-6 and all(r.target <= 2 * r.source_size + 1e-9 for r in s.values())
    weight = dict(zip(["s0", "s1", "s2", "s3", None], [3, 1, 2, 3, 1], strict=True))
    free = {k: r.target / weight[k] for k, r in s.items() if r.target < 2 * r.source_size - 1e-9}
    assert max(free.values()) - min(free.values()) < 1e-6
    own = {}
    for r in m.rows.where("slot is not null").join(m.sources, "src").groupBy("source").agg(F.sum("n_words").alias("n")).collect():
        own[r.source] = r.n
    assert all(abs(own.get(k, 0) - r.target) <= r.width + 1 for k, r in s.items())
    again = sorted(map(str, mixing.taken(mixing.mix(docs, block=8)).collect()))
    assert again == sorted(map(str, got))


def test_small_sources_come_near_their_targets(spark):
    d = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(30, "a"), (2000, "b"), (74, "c"), (1, "d"), (1500, "b")])], "doc_id long, text string, source string")
    m = mixing.mix(d)
    for s in m.sources.collect():
        n = m.rows.where(F.col("src") == s.src).agg(F.sum("n_words")).first()[0] or 0
        assert abs(n - s.target) <= 1 + s.source_size / 128


def test_rows_without_ids_are_spread_and_kept_apart(spark):
    data = [(None, f"text number {i} of some", "s", i) for i in range(200)] + [(None, "the same text", "s", 7)] * 5 + [(1, "x y z", None, 1), (1, "x y z", None, 2), (2, None, None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, extra int")
    m = mixing.mix(d, carry=("extra",))
    assert m.rows.where("doc_id is null").select("bucket").distinct().count() > 50
    got = mixing.taken(m)
    assert got.count() == len(data) and got.agg(F.sum("taken")).first()[0] == mixing.mixed_documents(m).select(F.explode(F.split("text", " "))).where("col <> ''").count()
    assert {r.extra for r in mixing.mixed_documents(m).where("source is null").collect()} <= {1, 2}


def test_a_very_long_text_is_mixed(spark):
    d = spark.createDataFrame([(1, "word and " * 200_000, "s"), (2, "short text", "s")], "doc_id long, text string, source string")
    m = mixing.mix(d)
    got = {r.doc_id: r for r in mixing.taken(m).collect()}
    assert got[1]["size"] == 400_000 and abs(got[1].taken + got[2].taken - 600_003) <= 65
    assert mixing.mixed_documents(m).where("doc_id = 1 and epoch = 0").first().text == "word and " * 200_000


def test_sql_twin_of_the_mix(spark):
    import duckdb

    from lattiq.llm.sql import mixing_sql

    data = [(i if i % 9 else None, f"{'word text ' * (i % 50)}{i}", None if i % 7 == 0 else f"s{i % 4}") for i in range(1, 400)] + [(500, None, "s1"), (501, "", "only")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", d.toPandas().assign(doc_id=lambda x: x["doc_id"].astype("Int64")))
    for shard_slots in (16, 4096):
        want = con.execute(mixing_sql(shard_slots=shard_slots)).fetchall()
        got = [tuple(r) for r in mixing.taken(mixing.mix(d, shard_slots=shard_slots)).collect()]
        clean = lambda rows: sorted(str((*r[:3], round(r[3], 6), *r[4:])) for r in rows)
        assert clean(got) == clean(want)


def test_slots_are_permutations(docs):
    m = mixing.mix(docs, block=8, shard_slots=64)
    n = {r.src: (r.n_blocks, r.n_slots) for r in m.sources.collect()}
    slots = m.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == sum(v[1] for v in n.values())
    # Each shard's counts are the draw, but for void and made-up slots.
    drawn, own = {(r.shard, r.src): r.n for r in m.draw.collect()}, {}
    for r in slots:
        own[r.shard, r.src] = own.get((r.shard, r.src), 0) + 1
    shards = {k for k, _ in drawn}
    assert all(own.get(k, 0) <= v for k, v in drawn.items()) and all(k in drawn or k[0] not in shards for k in own)
    assert sum(drawn.values()) == len(slots)
    for src, (blocks, want) in n.items():
        full = [r.block for r in slots if r.src == src and r.epoch == 0]
        assert len(set(full)) == len(full) == min(blocks, want) and all(0 <= b < blocks for b in full)


def test_whole_texts_come_back_from_the_mix(docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    mixed = mixing.mixed_documents(mixing.mix(docs, block=8)).collect()
    whole = [r for r in mixed if len(words_of(r.text)) == r.n_tokens]
    assert whole and all(r.text in texts[r.doc_id] for r in whole)


def test_line_dedup_against_brute_force(docs, nothing, spark):
    assert line_dedup.dedup_lines(nothing, line_dedup.insert(line_dedup.empty(spark), nothing)).count() == 0
    index = line_dedup.insert(line_dedup.empty(spark, shards=4), docs)
    got = line_dedup.dedup_lines(docs, index).collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for r in docs.collect():
        for x in (r.text or "").split("\n"):
            holders.setdefault(key(x), set()).add(r.doc_id)
    text = {}
    for r in docs.collect():
        own = (r.text or "").split("\n")
        left = [x for x in own if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and r.doc_id != max(holders[key(x)]))]
        text[r.doc_id] = ("\n".join(left), len(own), len(own) - len(left))
    assert len(got) == docs.count() and all((r.kept_text, r.n_lines, r.n_dropped) == text[r.doc_id] for r in got) and sum(r.n_dropped for r in got) > 5
    assert {"fp", "text_sha"} <= set(line_dedup.dedup_lines(docs, index).columns)


def test_line_dedup_is_reversible(docs, spark):
    decisions = lambda i, d: sorted(map(str, line_dedup.dedup_lines(d, i).select("doc_id", "kept_text").collect()))
    some, more = docs.where("doc_id < 12"), docs.where("doc_id >= 12")
    first = line_dedup.insert(line_dedup.empty(spark, shards=3), some)
    both = line_dedup.insert(first, more)
    whole = line_dedup.insert(line_dedup.empty(spark, shards=3), docs)
    assert decisions(both, docs) == decisions(whole, docs)
    back = line_dedup.delete(both, more.select("doc_id"))
    assert decisions(back, some) == decisions(first, some)
    assert sorted(map(str, back.counts.collect())) == sorted(map(str, first.counts.collect()))
    assert {r.shard: r.n for r in back.filters.collect() if r.n} == {r.shard: r.n for r in first.filters.collect() if r.n}


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    f = line_dedup.CuckooFilter(3000)
    assert f.insert(keys) and f.has(keys).all()
    f.delete(keys[:1500])
    assert f.has(keys[1500:]).all() and f.has(keys[:1500]).mean() < 0.01
    small = line_dedup.CuckooFilter(4)
    assert not small.insert(keys)


def test_shards_follow_the_keys(spark, monkeypatch):
    lines = [f"shared line number {k}, and it is long enough to be counted here" for k in range(12)]
    d = spark.createDataFrame([(i, "\n".join(lines[i % 3 :] + [f"own {i}"])) for i in range(20)], "doc_id long, text string")
    kept = lambda index: sorted(map(str, line_dedup.dedup_lines(d, index).select("doc_id", "kept_text").collect()))
    want = kept(line_dedup.insert(line_dedup.empty(spark), d))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    index = line_dedup.insert(line_dedup.insert(line_dedup.empty(spark, shards=1), d.where("doc_id < 9")), d.where("doc_id >= 9"))
    assert index.shards == 8 and index.filters.agg(F.sum("n")).first()[0] == 12 and kept(index) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert kept(index) == want


def test_keys_travel_to_filters_beyond_the_broadcast_bound(docs, spark, monkeypatch):
    index = line_dedup.insert(line_dedup.empty(spark, shards=4), docs)
    want = sorted(map(str, line_dedup.shared_lines(index, index.postings).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert sorted(map(str, line_dedup.shared_lines(index, index.postings).collect())) == want


def brute_components(ids, fps, radius=3):
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(ids))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("limit", [4096, 8])
def test_simhash_links(spark, limit):
    rng = random.Random(4)
    fps = []
    for _ in range(30):
        base = rng.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(rng.randrange(0, 20))]
    fps = list(dict.fromkeys(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = dict(components(simhash.near_links(d, limit=limit)).collect())
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(range(len(fps)), fps)


def test_covering_masks():
    rng = random.Random(0)
    for level in (0, 1):
        m = [x & (2**64 - 1) for x in simhash.masks(3, level)]
        for _ in range(500):
            d = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(d & x == 0 for x in m)


def test_simhash_query(docs, nothing):
    assert simhash.simhash(nothing).count() == 0
    got = simhash.simhash(docs).collect()
    assert len(got) == docs.count()
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    want = dict(zip(sorted(fp), brute_components(sorted(fp), [fp[i] for i in sorted(fp)]), strict=True))
    assert all(r.component_id == want[r.doc_id] for r in got)
    assert fp[40] == fp[41] == fp[42] == 0
    import xxhash
    assert simhash.fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_template_language():
    assert chat.fold(chat.parse("a{{ 'b' + 1 }}{% if 1 == 1 %}c{% else %}d{% endif %}")) == [("text", "ab1c")]
    for bad in ("{{ m.text }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ 'x' | eval }}", "{% for m in messages %}", "{% endif %}", "{{ open }}", "{% for m in other %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad).compiled()
    t = chat.Template("<{% for m in messages %}{% if not loop.first and m.role != 'x' %},{% endif %}{{ loop.index }}{{ m.text | trim | upper }}{% endfor %}>").compiled()
    assert "".join(p for _, ps in t([{"role": "u", "text": " a"}, {"role": "u", "text": "b"}]) for p, _ in ps) == "<1A,2B>"
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("<\\|im_end>%\n0A") for _ in range(20))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s) and chat.unescape_name(chat.escape_name(s)) == s


def test_chat_round_trip(spark):
    data = [*chat.HOSTILE, (5, 1, "assistant", "<\\|<|im_end|>\n"), (5, 0, "user\n<|x", None), (5, 1, "assistant", "b"), (5, None, None, "z"), (None, 0, "assistant", "<"), (6, 0, "user", "long " * 50_000)]
    d = spark.createDataFrame([(*r, 9) for r in data], "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(d)).collect()}
    for c in {r[0] for r in data}:
        own = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in data if r[0] == c)
        loss = "".join(t for _, r, t in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(d.limit(0))).count() == 0


def test_language_id(spark, nothing):
    vocab = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schön", "nicht"], "fr": ["été", "les", "dans", "où"]}
    rng = random.Random(0)
    data = [(i, " ".join(rng.choices(vocab[k], k=12)), k) for i, k in enumerate(["en", "de", "fr"] * 40)] + [(200, None, "en"), (201, "12 34 !", "en"), (202, "the and the", None), (203, "the thing " * 40_000, "en"), (0, data0 := "und der und", "de")]
    d = spark.createDataFrame([(*r, 1.0) for r in data], "doc_id long, text string, lang string, score double")
    out = language_id.held_out(F.col("doc_id"))
    got = language_id.predict(d, language_id.fit(d, ~out)).collect()
    assert len(got) == len(data)
    for r, (i, t, k) in zip(sorted(got, key=lambda r: (r.doc_id, r.lang_pred)), sorted(data, key=lambda x: (x[0], x[2] or "")), strict=True):
        if i in (200, 201):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (k or "en") and 0 <= r.score <= 1
    assert data0
    assert language_id.predict(d, language_id.fit(nothing, F.lit(True))).where("lang_pred <> 'und'").isEmpty()


def test_language_id_against_plain_counts(spark, monkeypatch):
    """Multinomial naive Bayes with a Python dictionary of n-gram counts; as many buckets as there need be to keep n-grams apart."""
    import math
    from collections import Counter

    rng = random.Random(7)
    vocab = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schön", "nicht"], "fr": ["été", "les", "dans", "où"]}
    data = [(i, " ".join(rng.choices(vocab["en"] + vocab[k], k=rng.randrange(1, 6))), k) for i, k in enumerate(["en", "de", "fr", "en"] * 30)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    bits = 19
    model = language_id.fit(d, F.lit(True), bits=bits)
    grams = lambda t: [f" {t.lower()} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)]
    counts, sizes = {}, Counter(k for *_, k in data)
    for _, t, k in data:
        counts.setdefault(k, Counter()).update(grams(t))
    total = {k: sum(c.values()) + 0.5 * 2**bits for k, c in counts.items()}
    monkeypatch.setattr(language_id, "SPAN", 7)
    monkeypatch.setattr(language_id, "CELLS", 50)
    texts = [t for _, t, _ in data] + ["½ ² 12", "Ⅷ", "ª", "中"]
    for t, lang, score in zip(texts, *language_id.predict_texts(model, texts), strict=True):
        if t in ("½ ² 12", "Ⅷ"):  # number characters are no letters
            assert (lang, score) == ("und", 0.0)
            continue
        logs = {k: sum(math.log((counts[k][g] + 0.5) / total[k]) for g in grams(t)) for k in counts}
        best = max(sorted(logs), key=lambda k: round(logs[k] + math.log(sizes[k] / len(data)), 4))
        assert lang == best
        p = {k: math.exp((v - logs[best]) / math.sqrt(len(grams(t)))) for k, v in logs.items()}
        assert abs(score - p[best] / sum(p.values())) < 1e-3


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:340] = x[7]
    data = [(i, x[i].tolist(), 0.5) for i in range(700)] + [(800, None, 0.1), (801, [0.0] * 16, 0.1), (802, [float("nan")] * 16, 0.1), (803, [1.0, None] * 8, 0.1), (804, [1.0] * 3, 0.1), (5, x[5].tolist(), 0.5), (820, [float("inf")] * 16, 0.1)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(d, d.where("vec_id % 20 = 0"), block_rows=256, query_rows=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    hit = 0
    for q, rows_ in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        best = [i for i in np.lexsort((np.arange(700), -np.round(s, 9))) if i != q][:20]
        rows_.sort()
        assert [r for r, *_ in rows_] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in rows_) and q not in [i for _, i, _ in rows_]
        hit += len(set(best) & {i for _, i, _ in rows_})
    assert hit / (20 * len(got)) >= 0.95
    few = ann.search(d.where("vec_id < 6"), d.where("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4, 5]
    assert ann.search(d.limit(0), d.limit(0)).count() == 0


def test_shortlists_grow_in_a_group_of_near_copies(spark):
    """Hundreds of rows closer to each other than codes can tell: their order is still the exact one."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300:700] = x[300] + rng.normal(size=(400, 24)) * 2e-3
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(d, d.where("vec_id % 20 = 0"), rerank=30, books=8, block_rows=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & found)
    assert len(got) == 45 and hit / (20 * len(got)) > 0.98


def test_lookup_tables_are_inner_products():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 12)).astype(np.float32), rng.normal(size=(7, 12)).astype(np.float32)
    for books, words in ((6, 8), (3, 8), (4, 32)):
        m = ann.train(x, books, words, rounds=2)
        codes = m.encode(x)
        assert np.allclose(ann.scores(q, m.codebooks, codes, np.full(300, 2, np.float32)), 2 * q @ m.decode(codes).T, atol=1e-4)
        greedy = m.encode(x, beam=1)
        error = lambda c: ((m.decode(c) - x) ** 2).sum()
        assert error(codes) <= error(greedy)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_recall_on_the_larger_table(spark):
    """All of the table's queries against brute force."""
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = d.select("vec_id", "embedding").toPandas().drop_duplicates("vec_id")
    ids, x = pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), np.float64)
    got = {}
    for r in ann.search(d, d.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & got[ids[q]])
    assert hit / (20 * len(got)) >= 0.95


@pytest.fixture(scope="module")
def judged_docs(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "river", "walks", "quietly", "under", "stone", "of", "and", "morning"]) + str(rng.randrange(9)) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "CHEAP"]) + "!!" for _ in range(80))
    data, labels = [], []
    for i in range(240):
        q, t = int(i % 4 > 0), int(i % 5 == 0)
        text = (good() if q else bad()) + (" you idiot, worthless moron" if t else "")
        data.append((i, text, "en", f"h{i % 6}", 1, 0.5))
        labels.append((i, q, t))
    data += [(900, None, None, None, 1, 0.5), (901, "", "en", "h1", 1, 0.5), (0, data[0][1], "en", "h0", 1, 0.5)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, z double").persist(), spark.createDataFrame(labels + [(1, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_classifier(judged_docs):
    docs, labels = judged_docs
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.judged(docs, model, host=docs["source"], path=docs["lang"]).collect()
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    assert len(got) == docs.count() and np.mean([r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id < 240]) > 0.97
    rate = {r.path_rate for r in got}
    assert all(0 < x < 1 for x in rate)
    kept = quality_classifier.keep_good(docs, model, host=docs["source"], path=docs["lang"])
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    free = quality_classifier.fit(docs, labels.limit(0))
    assert quality_classifier.judged(docs, free, host=docs["source"], path=docs["lang"]).where("not kept").isEmpty()
    assert quality_classifier.judged(docs.limit(0), model, host=docs["source"], path=docs["lang"]).count() == 0


def test_posteriors_shrink(spark):
    rows_ = [("big", "a", 4.0)] * 500 + [("big", "b", -4.0)] * 500 + [("small", "a", -4.0)] + [("mid", "a", 4.0)] * 20
    r = {(x.host, x.path): x for x in quality_classifier.posteriors(spark.createDataFrame(rows_, "host string, path string, z double"), 0.0).collect()}
    assert r[("big", "a")].path_rate > 0.9 > 0.2 > r[("big", "b")].path_rate
    assert r[("small", "a")].path_rate > 0.05  # one bad document does not sink its site


def test_toxicity(judged_docs):
    docs, labels = judged_docs
    got = toxicity.predict(docs, toxicity.fit(docs, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    assert len(got) == docs.count() and all(r.toxic == bool(truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id < 240)
    assert not next(r for r in got if r.doc_id == 900).toxic and all(0 <= r.p_severe <= 1 for r in got)
    assert toxicity.predict(docs, toxicity.fit(docs, labels.limit(0))).where("toxic").isEmpty()


def plain_logit(m, buckets, dense):
    return sum(m.w[b] for b in buckets) + sum(x * y for x, y in zip(dense, m.d, strict=True)) + m.b


def test_toxicity_against_plain_python(judged_docs, monkeypatch):
    """Row by row: the chain's probabilities, and that later models were trained with out-of-fold ones."""
    docs, labels = judged_docs
    trained = []
    fit = toxicity.SparseLogistic.fit
    monkeypatch.setattr(toxicity.SparseLogistic, "fit", lambda self, rows, dense, y, **o: (trained.append((len(y), dense.copy(), np.array(y))), fit(self, rows, dense, y, **o))[1])
    chain = toxicity.fit(docs, labels)
    sigma = lambda z: 1 / (1 + np.exp(-max(-30, min(30, z))))
    for r in toxicity.predict(docs, chain).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        buckets, p = toxicity.word_features(r.text or ""), []
        for m in chain.models:
            p.append(sigma(plain_logit(m, buckets, p)))
        odds = p[1] / (1 - p[1]) * np.exp(chain.shift)
        assert np.allclose([r.p_junk, r.p_toxic, r.p_severe], [p[0], odds / (1 + odds), p[2]], atol=1e-9) and r.toxic == (r.p_toxic >= 0.5)
    # Four folds and the whole for each category but the last, which has no folds; whole fits see one more column each.
    n = max(k for k, *_ in trained)
    whole = [x for k, x, _ in trained if k == n]
    assert [x.shape[1] for x in whole] == [0, 1, 2]
    once = docs.select("doc_id", "text").where("text is not null").distinct()  # id 0 is there twice, and is fitted once
    rows = sorted(once.join(labels.where("toxic is not null"), "doc_id").collect(), key=lambda r: r.doc_id)
    assert len(rows) == n
    each = [toxicity.word_features(r.text) for r in rows]
    junk = np.array([1 - r.quality for r in rows])
    for f in range(4):  # the junk column of rows in fold f comes from a model that saw the other folds only
        rest = [i for i in range(n) if i % 4 != f]
        m = fit(toxicity.SparseLogistic(0), toxicity.Rows.of([each[i] for i in rest]), np.zeros((len(rest), 0)), junk[rest])
        assert np.allclose(whole[1][f::4, 0], [sigma(plain_logit(m, each[i], [])) for i in range(n) if i % 4 == f], atol=1e-9)


def test_toxic_words_are_learned_without_lists(spark):
    rng = random.Random(2)
    base = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "se", "vi", "no", "zu")]
    text = lambda bad: " ".join(rng.choices(base, k=30) + rng.sample(["zorg", "blarg", "fnord"], bad))
    data = [(i, text(i % 4 if i % 3 == 0 else 0), int(i % 3 == 0 and i % 4 > 0)) for i in range(1200)] + [(5000, "fnord " * 200_000, 1), (5001, "ka ta " * 100_000, 0), (5002, text(0), 0), (5002, text(0), 0)]
    d = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    labels = d.where("doc_id < 1000").selectExpr("doc_id", "toxic", "1 as quality")
    got = toxicity.predict(d, toxicity.fit(d, labels)).collect()
    truth = {i: bool(t) for i, _, t in data}
    assert len(got) == len(data) and np.mean([r.toxic == truth[r.doc_id] for r in got if r.doc_id >= 1000]) > 0.98
    severe = {r.doc_id: r.p_severe >= 0.5 for r in got}
    assert np.mean([severe[i] for i in range(1000, 1200) if i % 3 == 0 and i % 4 == 3]) > np.mean([severe[i] for i in range(1000, 1200) if i % 3 == 0 and i % 4 == 1])


def test_quality_against_plain_python(judged_docs):
    """Evidence row by row; then rates, strengths and posteriors by dictionaries."""
    docs, labels = judged_docs
    model = quality_classifier.fit(docs, labels)
    assert np.abs(model.words.w).max() > 0
    rows_ = docs.collect()
    got = quality_classifier.judged(docs, model, host=docs["source"], path=docs["lang"]).collect()
    z = {}
    for r in rows_:
        own = sum(a * b for a, b in zip(quality_classifier.features(None if r.text is None else r.text.encode()), model.weights, strict=True)) - model.prior
        z[r.doc_id] = max(-15, min(15, own + plain_logit(model.words, toxicity.word_features(r.text or ""), [])))
    paths, hosts = {}, {}
    for r in rows_:
        p = round(1e6 / (1 + np.exp(-(z[r.doc_id] + model.prior)))) / 1e6
        for group, key in ((paths, (r.source, r.lang)), (hosts, r.source)):
            n, s = group.get(key, (0, 0.0))
            group[key] = (n + 1, s + p)
    overall = sum(s for _, s in hosts.values()) / len(rows_)

    def strength(groups):  # (n, rate, toward)
        total = sum(n for n, *_ in groups)
        between = max((sum(n * (r - t) ** 2 for n, r, t in groups) - sum(t * (1 - t) for _, _, t in groups)) / total, 1e-9)
        return min(max(sum(n * t * (1 - t) for n, _, t in groups) / total / between, 1.0), 1e4)

    a = strength([(n, s / n, overall) for n, s in hosts.values()])
    host = {k: (s + a * overall) / (n + a) for k, (n, s) in hosts.items()}
    b = strength([(n, s / n, host[k[0]]) for k, (n, s) in paths.items()])
    path = {k: (s + b * host[k[0]]) / (n + b) for k, (n, s) in paths.items()}
    place = {r.doc_id: (r.source, r.lang) for r in rows_}
    for r in got:
        k = place[r.doc_id]
        assert abs(r.evidence - z[r.doc_id]) < 1e-9 and abs(r.host_rate - host[k[0]]) < 1e-5 and abs(r.path_rate - path[k]) < 1e-5
        q = 1 / (1 + np.exp(-(z[r.doc_id] + np.log(path[k] / (1 - path[k])))))
        assert abs(r.quality - q) < 1e-4 and r.kept == (r.quality >= 0.5)


def test_a_very_long_text_and_ties_have_one_quality(spark, judged_docs):
    docs, labels = judged_docs
    model = quality_classifier.fit(docs, labels)
    words = ["river1", "stone2", "morning3", "quietly4"] * 50_000
    d = spark.createDataFrame([(1, " ".join(words), "en", "h", 1), (2, " ".join(words), "en", "h", 2), (2, " ".join(words), "en", "h", 2)], "doc_id long, text string, lang string, source string, z int")
    got = quality_classifier.judged(d, model, host=d["source"], path=d["lang"]).collect()
    assert len(got) == 3 and len({r.quality for r in got}) == 1


@pytest.fixture(scope="module")
def model():
    try:
        return sentencepiece.read_model(sentencepiece.default_model())
    except OSError:
        pytest.skip("no tokenizer files here")


def test_encoding_is_the_librarys_unigram_reading(model):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    other = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    v = sentencepiece.load(model=model)
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("abcthe in  éß中,.!0xñ") for _ in range(rng.randrange(0, 60)))
        ids = sentencepiece.encode_texts(v, [t])[0].tolist()
        assert ids == [i for part in sentencepiece.streaming(v, sentencepiece.normalise(t)) for i in part] == other.encode(t)


def test_streaming_commits_early_and_exactly(model):
    v = sentencepiece.load(model=model)
    text = sentencepiece.normalise("thethingisthatnoblankstandshere" * 40)
    parts = list(sentencepiece.streaming(v, text))
    n = len(text)
    best = [0.0] + [-np.inf] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - v.longest), end):
            s = v.scores.get(text[start:end], v.unknown if start == end - 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    ids = [i for p in parts for i in p]
    score = {i: v.scores[p] for p, i in v.ids.items()}
    codes = sentencepiece.codes_of(text)
    looks = [len(places) for places, _ in sentencepiece.search(v, codes, np.zeros(1, np.int64), np.array([n]))]
    assert len(looks) > 5 and max(looks) < 100
    assert len(parts) > 5 and sum(score[i] for i in ids) == best[n]


def test_lanes_and_the_single_search_agree(model, monkeypatch):
    v = sentencepiece.load(model=model)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcthe in  éß中▁=,.!0xñ") for _ in range(rng.randrange(0, 3000))) for _ in range(30)] + ["=" * 5000, "ab" * 3000, " " * 2000, "", "the " * 3000]
    single = [[i for part in sentencepiece.streaming(v, sentencepiece.normalise(t)) for i in part] for t in texts]
    assert [x.tolist() for x in sentencepiece.encode_texts(v, texts)] == single
    monkeypatch.setattr(sentencepiece, "STRETCH", 10**6)  # whole texts in lanes, whose backpointers need more and more places
    assert [x.tolist() for x in sentencepiece.encode_texts(v, texts)] == single
    monkeypatch.setattr(sentencepiece, "PORTION", 700)  # texts in many portions
    assert [x.tolist() for x in sentencepiece.encode_texts(v, texts)] == single


@pytest.mark.parametrize("unit", ["a", "=", "中", "the"])
def test_long_unbroken_runs_take_linear_time(model, unit):
    import time

    v = sentencepiece.load(model=model)
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        ids = sentencepiece.encode_texts(v, [unit * (n // len(unit))])[0]
        took.append(time.process_time() - began)
    assert sentencepiece.decode_ids(v, ids) == unit * (200_000 // len(unit))
    assert took[1] < 10 * took[0] + 1


def test_equal_sums_take_the_longest_last_piece():
    v = sentencepiece.Vocabulary({"a": 0, "b": 1, "ab": 2, "abab": 3, "▁": 4}, {"a": -1.0, "b": -1.0, "ab": -2.0, "abab": -4.0, "▁": -1.0}, list(range(10, 266)), [b""] * 266, -50.0, 4)
    assert sentencepiece.encode_texts(v, ["abab"])[0].tolist() == [4, 3]
    assert [i for p in sentencepiece.streaming(v, "▁abab") for i in p] == [4, 3]


def test_encode_decode_round_trip(docs, model, nothing):
    odd = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(70, "▁ x▁y  \n\t"), (71, "a" * 5000), (72, "中文\x00é" * 50)], "doc_id long, text string"))
    enc = sentencepiece.encode(odd, model)
    out = sentencepiece.decode(enc, model).collect()
    assert sorted((r.doc_id, str(r.text)) for r in out) == sorted((r.doc_id, str(r.text)) for r in odd.collect())
    assert all((r.ids is None) == (r.text is None) for r in out)
    assert sentencepiece.digests(sentencepiece.decode(sentencepiece.encode(nothing, model), model)).count() == 0
