"""Byte-level BPE against the tiktoken library: ids, appends, edits, odd characters, long runs, nulls."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lattiq.llm import byte_bpe
from lattiq.llm.queries import op11_byte_bpe

PARTS = ["a", "b", "e", "th", "in", " ", "  ", "\n", "'s", "'", "1", "23", "é", "ñ", "日本", "😀", "!", "…", "\t", "aaaa", " the", "\x85", "\x1c", "<|endoftext|>"]


@pytest.fixture(scope="module")
def how():
    return byte_bpe.read_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern()


@pytest.fixture(scope="module")
def tok(how):
    return byte_bpe.tokenizer(*how)


@pytest.fixture(scope="module")
def library(tok):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.pieces.ranks, special_tokens={})


def text_of(rng, n, parts=PARTS):
    return "".join(rng.choice(parts) for _ in range(rng.randrange(n)))


def test_ids_equal_the_library(tok, library, how):
    rng = random.Random(1)
    for k in range(6000):
        t = text_of(rng, 50, PARTS if k % 2 else ["a", "b", "e", "t", "h", "i", "n", "é"])
        assert tok.encode(t).tolist() == library.encode_ordinary(t)
        assert byte_bpe.decode_ids(byte_bpe.tokens(how[0]), tok.encode(t)).tobytes() == t.encode()


def test_every_character_is_classed_as_the_library_does(tok, library):
    for c in range(0, 0x110000, 1):
        if (c < 0x3500 or c % 97 == 0 or 0x10900 <= c < 0x11000 or 0x18D00 <= c < 0x18E10) and not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}a1{chr(c)}1 !{chr(c)}! {chr(c)}  {chr(c)}{chr(c)}x"
            assert tok.encode(t).tolist() == library.encode_ordinary(t), hex(c)


def test_edits_give_what_encoding_anew_gives(tok, library):
    rng = random.Random(2)
    for _ in range(500):
        d = byte_bpe.Document(tok, text_of(rng, 40))
        for _ in range(6):
            d.replace(rng.randrange(len(d.text) + 2), rng.randrange(5), text_of(rng, 4))
            fresh = byte_bpe.Document(tok, d.text)
            assert d.ids().tolist() == library.encode_ordinary(d.text)
            assert d.ends.tolist() == fresh.ends.tolist() and d.last.tolist() == fresh.last.tolist()
        d.append("x'l")
        d.append("l  ")
        d.append("y")
        assert d.ids().tolist() == library.encode_ordinary(d.text)


def test_a_long_run_is_encoded_whole_and_edits_stay_local(tok, library):
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefghiétn") for _ in range(60_000))
    d = byte_bpe.Document(tok, run)
    assert d.ids().tolist() == library.encode_ordinary(run)
    for at, removed, inserted in ((30_000, 0, " "), (20_000, 3, "xyz"), (50_000, 1, ""), (0, 0, "q"), (10**9, 0, "tail")):
        before = tok.pieces.steps
        d.replace(at, removed, inserted)
        assert tok.pieces.steps - before < 300
    assert d.ids().tolist() == library.encode_ordinary(d.text)
    text = " ".join(text_of(rng, 30) for _ in range(100_000))  # over one portion
    assert tok.encode(text).tolist() == library.encode_ordinary(text)


def test_tokens_that_merging_does_not_reach():
    p = byte_bpe.Pieces({bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 300, b"abcd": 301})
    assert p.encode(b"abcd") == [301] and p.encode(b"xabcd") == [120, 256, 99, 100] and p.encode(b"bcabcd") == [300, 256, 99, 100]
    with pytest.raises(ValueError):
        byte_bpe.Pieces({b"a": 0})


def test_query_and_tables(spark, tmp_path, how, library):
    rng = random.Random(4)
    texts = {i: text_of(rng, 60) for i in range(40)} | {50: None, 51: "", 52: "x" * 300_000, 53: texts_of_all_blanks()}
    rows = [(i, t, 7, b"z") for i, t in texts.items()] + [(1, texts[1], 7, b"z"), (None, "no id", 7, b"z")]
    spark.createDataFrame(rows, "doc_id long, text string, ids int, bytes binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_byte_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        t = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = byte_bpe.decode(byte_bpe.encode(docs.limit(0), *how), how[0])
    assert none.count() == 0 and none.columns == ["doc_id", "ids", "bytes"]
    some = byte_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [258, 40]), (4, None), (5, [0])], "doc_id long, ids array<int>"), how[0])
    table = {i: t for t, i in byte_bpe.vocabulary(how[0]).items()}
    assert [r.bytes for r in some.orderBy("doc_id").collect()] == [None, b"", table[258] + table[40], None, table[0]]


def texts_of_all_blanks():
    return " \t\n\x0b\x0c\r\x85 　 " * 20


def test_revised_tables(spark, how, library):
    rng = random.Random(5)
    texts = {i: text_of(rng, 60) for i in range(12)} | {12: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edits = [(i, s, rng.randrange(70), rng.randrange(4), text_of(rng, 5)) for i in range(8) for s in range(3)] + [(12, 1, None, None, "end"), (99, 1, 0, 0, "x"), (None, 1, 0, 0, "x"), (9, 1, 0, None, None)]
    rng.shuffle(edits)
    now = {i: t or "" for i, t in texts.items()}
    for i, _, at, removed, inserted in sorted((e for e in edits if e[0] in now), key=lambda e: e[:2]):
        at = len(now[i]) if at is None else min(at, len(now[i]))
        now[i] = now[i][:at] + (inserted or "") + now[i][at + (removed or 0) :]
    stored = byte_bpe.encode_prefixes(docs, *how)
    revised = byte_bpe.revise(stored, spark.createDataFrame(edits, "doc_id long, seq int, at int, removed int, inserted string"), *how)
    got = {r.doc_id: r.ids for r in byte_bpe.stored_ids(revised, *how).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in now.items()}
