"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

A vocabulary gives every token (a byte string) its rank; a pattern splits a text into pieces, and each
piece is merged separately, lowest rank first and leftmost of equal ranks.  A piece that is itself a token is that token.

Every prefix of a piece has exactly one encoding, and the encoding of a prefix without its last token is
that prefix's encoding less the token.  So one number a byte is enough: ``last[i]``, the last token of the prefix
that ends with byte i.  Token t that covers bytes [s, i] is it exactly if t is what merging t's own bytes ends in
and t may stand behind ``last[s - 1]``: merging the two tokens' bytes ends in these two tokens.  A row of tokens is what
merging gives if every pair of neighbours is, since the first merge across a seam depends on the two tokens at the seam alone.

``last`` is what makes changes cheap.  Bytes that are appended extend it and change no entry (``Pieces.extend``).  After an edit
it is computed again from the edited byte on until as many entries in a row as the longest token has bytes
agree with the old ones; from there all agree (``Document.replace``).  The pattern is matched again only between the
last piece that did not look at the edited place and the next old boundary that is met.

Tables: ``encode`` gives ids, ``decode`` bytes; ``encode_prefixes`` stores ``last`` beside the text, ``revise`` applies a table of edits
to what it stored, and ``stored_ids`` reads ids off it.

Defined results: a null text is the empty text and has no ids; a document without edits is left as it is; null ids decode to
null; repeated rows repeat; extra columns are ignored; an empty table gives an empty table; bytes that are no
UTF-8 are read as U+FFFD; texts of any length are encoded whole, about ``PORTION`` characters at a time.  Edits
of one document apply in the order of ``seq`` and count code points; edits that reach beyond the text are cut to it; edits of unknown documents, and
edits without a document, change nothing.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import blob, chunks, column

PORTION = 1 << 20
#: How many pieces, and pairs of tokens, a worker remembers before it starts anew; longer pieces are not remembered.
REMEMBERED = 1 << 19
LONG = 64
NEVER = 1 << 40
PAIR_BITS = 24
#: Letters and numbers (code points) that the pattern's library, which knows Unicode 16, does not take for such, and that ``regex`` does.
NEWER_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: No newer character stands before this one; texts without any from here on take the plainer, faster pattern.
FIRST_NEWER = "\u0558"


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, one line a token: base64, a blank, the rank."""
    with open(path, "rb") as f:
        return f.read()


def default_ranks() -> str:
    """The public rank file for many languages of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pieces:
    """A vocabulary, and the search over one piece's prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: The tokens as a tree: byte -> (the token that ends here or -1, the tree of what can follow or None).
        self.tree: dict[int, tuple[int, dict | None]] = {}
        for t, rank in ranks.items():
            self._plant(t, rank)
        self.sides: dict[int, tuple[list, list] | None] = {}
        #: What ``fits`` found, by a << PAIR_BITS | b.
        self.pairs: dict[int, bool] = {}
        #: Bytes searched from so far.
        self.steps = 0
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")

    def _plant(self, token: bytes, rank: int) -> None:
        node = self.tree
        for b in token[:-1]:
            own, below = node.get(b, (-1, None))
            if below is None:
                below = {}
                node[b] = (own, below)
            node = below
        node[token[-1]] = (rank, node.get(token[-1], (-1, None))[1])

    def history(self, token: int) -> tuple[list, list] | None:
        """How merging the token's own bytes goes, seen from its left end and from its right end.

        Each is a list of (the part at that end, the rank of the next merge); None if it doesn't end in the token.
        """
        if token in self.sides:
            return self.sides[token]
        t = self.bytes_of[token]
        parts = [t[i : i + 1] for i in range(len(t))]
        left, right = [], []
        while True:
            following = [self.ranks.get(a + b, NEVER) for a, b in itertools.pairwise(parts)]
            rank = min(following, default=NEVER)
            left.append((parts[0], rank))
            right.append((parts[-1], rank))
            if rank == NEVER:
                break
            at = following.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = self.sides[token] = (left, right) if len(parts) == 1 else None
        return out

    def alone(self, token: int) -> bool:
        """Whether merging the token's bytes ends in the token."""
        return self.history(token) is not None

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends in [a, b]: their own merges run in order of rank, and none across the seam comes first."""
        one, two = self.history(a), self.history(b)
        ok = one is not None and two is not None
        i = j = 0
        while ok:
            (x, mine), (y, other) = one[1][i], two[0][j]
            across = self.ranks.get(x + y, NEVER)
            if across < mine and across <= other:
                ok = False
            elif mine == other == NEVER:
                break
            elif mine <= other:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[a << PAIR_BITS | b] = ok
        return ok

    def extend(self, piece: bytes, last: list[int], old: np.ndarray | None = None, shift: int = 0, after: int = 0) -> list[int]:
        """Complete ``last`` for all of ``piece``; the entries it has are kept.

        ``old`` holds the entries of the old piece that the last byte was in; byte i was its byte i - ``shift`` from byte ``after`` on.
        """
        n, had, tree, pairs = len(piece), len(last), self.tree, self.pairs
        if had >= n:
            return last[:n]
        last = last + [-1] * (n - had)
        same = 0
        for s in range(max(0, had - self.longest), n):
            before = last[s - 1] << PAIR_BITS if s else -1
            node = tree
            for e in range(s, n):
                hit = node.get(piece[e])
                if hit is None:
                    break
                token, node = hit
                if token >= 0 and e >= had and last[e] < 0:
                    ok = pairs.get(before | token) if s else self.alone(token)
                    if ok is None:
                        ok = self.fits(last[s - 1], token)
                    if ok:
                        last[e] = token
                if node is None:
                    break
            if old is not None and s >= had:
                same = same + 1 if s >= after and 0 <= s - shift < len(old) and old[s - shift] == last[s] else 0
                if same > self.longest:
                    last[s + 1 :] = old[s + 1 - shift : n - shift].tolist()
                    break
            self.steps += 1
        return last

    def read(self, piece: bytes, last: list[int] | np.ndarray) -> list[int]:
        """The ids of a piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, end = [], len(piece)
        while end:
            out.append(int(last[end - 1]))
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(piece, self.extend(piece, []))


class Tokenizer:
    """A vocabulary with a pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.pieces = Pieces(vocabulary(ranks))
        # White space is what Unicode calls so, as in the library's regular expressions.
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.plain = regex.compile(pattern, regex.V1)
        for kind, newer in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)):
            ranges = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in newer.split())
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{ranges}]]")
        self.exact = regex.compile(pattern, regex.V1)
        self.late = re.compile(f"[{FIRST_NEWER}-\U0010ffff]")
        self._forget()

    def pattern_for(self, text: str) -> regex.Pattern:
        return self.exact if self.late.search(text) else self.plain

    def split(self, text: str) -> Iterator[list[str]]:
        """The pieces, list by list.  A match looks one character past its end at most, so those that end earlier in a portion stand."""
        at, size, pattern = 0, PORTION, self.pattern_for(text)
        while at < len(text):
            found = pattern.findall(text[at : at + size])
            if at + size < len(text):
                end, part = size, []
                while found and end >= size - 1:
                    part.append(found.pop())
                    end -= len(part[-1])
                if not found:  # one long piece
                    size *= 2
                    continue
                at += end
                size = PORTION
            else:
                at = len(text)
            yield found

    def _new(self, piece: str) -> int:
        """Encode a piece into the pool; gives its number there."""
        self.pool.extend(self.pieces.encode(piece.encode()))
        self.begins.append(len(self.pool))
        number = len(self.begins) - 2
        if len(piece) <= LONG:
            self.known[piece] = number
        return number

    def encode(self, text: str) -> np.ndarray:
        out = []
        for found in self.split(text):
            if len(self.begins) > REMEMBERED or len(self.pool) > 4 * REMEMBERED:
                self._forget()
            at = np.fromiter(map(self.known.get, found, itertools.repeat(-1)), np.int64, len(found))
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = self.known.get(found[i], -1)
                if at[i] < 0:
                    at[i] = self._new(found[i])
            begins = np.frombuffer(self.begins, np.int64)
            out.append(gathered(np.frombuffer(self.pool, np.int32), begins[at], begins[at + 1] - begins[at]))
            del begins  # the pool grows again
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.begins = array("i"), array("q", [0])


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` end to end."""
    ends = np.cumsum(sizes)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def vocabulary(ranks: bytes) -> dict[bytes, int]:
    """A rank file's tokens."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}


@functools.lru_cache(maxsize=2)
def tokens(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' bytes end to end, where each rank's begin and how many they are."""
    by = {r: t for t, r in vocabulary(ranks).items()}
    own = [by.get(i, b"") for i in range(max(by, default=-1) + 1)]
    sizes = np.array([len(t) for t in own], np.int64)
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_ids(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The bytes of ids; ids outside the vocabulary are an error."""
    pool, starts, sizes = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
        raise ValueError("an id is outside the vocabulary")
    return gathered(pool, starts[ids], sizes[ids])


@functools.lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(ranks, pattern)


class Document:
    """A text with its pieces' ends (in characters) and the last token of each byte prefix within a piece."""

    def __init__(self, tok: Tokenizer, text: str = "", ends: np.ndarray | None = None, last: np.ndarray | None = None):
        self.tok, self.text = tok, text
        if ends is None:
            found = [p for part in tok.split(text) for p in part]
            ends = np.cumsum([len(p) for p in found], dtype=np.int64)
            last = [t for p in found for t in tok.pieces.extend(p.encode(), [])]
        self.ends, self.last = np.asarray(ends, np.int64), np.asarray(last, np.int32)

    def append(self, more: str) -> None:
        self.replace(len(self.text), 0, more)

    def replace(self, at: int, removed: int, inserted: str) -> None:
        """Put ``inserted`` for the ``removed`` characters from ``at`` on; only what lies near is encoded again."""
        old, ends = self.text, self.ends
        at = min(max(at, 0), len(old))
        removed = min(max(removed, 0), len(old) - at)
        text, shift = old[:at] + inserted + old[at + removed :], len(inserted) - removed
        stop = at + len(inserted)  # the characters from here on are old ones
        kept = int(np.searchsorted(ends, at - 1, "left"))  # these pieces looked at no character from ``at`` on
        begin = int(ends[kept - 1]) if kept else 0
        # Match anew until a boundary behind the edit is an old one.
        fresh, now, joined, pattern = [], begin, len(ends), self.tok.pattern_for(text)
        while now < len(text):
            if now >= stop:
                k = int(np.searchsorted(ends, now - shift, "left"))
                if now == shift or (k < len(ends) and ends[k] == now - shift):
                    joined = k + 1 if now > shift else 0
                    break
            now = pattern.match(text, now).end()
            fresh.append(now)
        last, place, start = [], len(old[:begin].encode()), begin
        first, moved = place, len(inserted.encode()) - len(old[at : at + removed].encode())
        for end in fresh:
            piece = text[start:end].encode()
            own, held, offset, after = [], None, 0, len(piece)
            if start == begin and kept < len(ends):  # an old piece began here, too: its entries before the edit stand
                own = self.last[first : first + len(text[begin : min(at, end, int(ends[kept]))].encode())].tolist()
            if end > stop and len(piece) > 2 * self.tok.pieces.longest:
                k = int(np.searchsorted(ends, end - shift, "left"))
                was = int(ends[k - 1]) if k else 0
                was_at = len(old[:was].encode())
                held = self.last[was_at : was_at + len(old[was : int(ends[k])].encode())]
                offset, after = was_at + moved - place, len(text[start : max(start, stop)].encode())
            last += self.tok.pieces.extend(piece, own, held, offset, after)
            place, start = place + len(piece), end
        behind = len(old[int(ends[joined - 1]) if joined else 0 :].encode())
        self.last = np.concatenate([self.last[:first], np.array(last, np.int32), self.last[len(self.last) - behind :]])
        self.ends = np.concatenate([ends[:kept], np.array(fresh, np.int64), ends[joined:] + shift])
        self.text = text

    def ids(self) -> np.ndarray:
        out, start, place = [], 0, 0
        for end in self.ends.tolist():
            piece = self.text[start:end].encode()
            out += self.tok.pieces.read(piece, self.last[place : place + len(piece)])
            start, place = end, place + len(piece)
        return np.array(out, np.int32)


def _ids_of(rows: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _string(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace")


def _through(df: DataFrame, ranks: bytes, pattern: str, sized: str, work: Callable[[Tokenizer, pa.RecordBatch], list[pa.Array]], added: dict[str, str]) -> DataFrame:
    """Rows of ``df`` (doc_id first) through ``work``, in batches of bounded size: doc_id and the columns that ``work`` gives."""
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(held.value, pattern)
        for batch in batches:
            for part in chunks(batch, sized):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *work(tok, part)], ["doc_id", *added])

    return df.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in {"doc_id": df.schema["doc_id"].dataType.simpleString(), **added}.items()))


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``.  ``ranks`` is the rank file's bytes, so that executors need no file."""
    d = docs.select(column(docs, id_col).alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return _through(d, ranks, pattern, "t", lambda tok, part: [_ids_of([tok.encode(_string(t)) for t in part.column("t").to_pylist()])], {"ids": "array<int>"})


def decode(encoded: DataFrame, ranks: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, bytes) for every row of ``encoded``."""
    d = encoded.select(column(encoded, id_col).alias("doc_id"), column(encoded, ids_col).cast("array<int>").alias("ids"))
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens(held.value)
        for batch in batches:
            n = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, upto = 0, np.cumsum(n)
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PORTION)))
                part = batch.slice(at, stop - at)
                ids = part.column("ids")
                flat = ids.flatten().to_numpy()
                found = decode_ids(table, flat)
                sizes = np.r_[0, np.cumsum(table[2][flat])][np.r_[0, np.cumsum(n[at:stop])]].astype(np.int32)
                known = pa.array(ids.is_valid().to_numpy(zero_copy_only=False))
                text = pa.Array.from_buffers(pa.binary(), len(ids), [known.buffers()[1], pa.py_buffer(sizes), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, text], ["doc_id", "ids", "bytes"])
                at = stop

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")


_STORED = {"text": "string", "ends": "binary", "last": "binary"}


def _store(found: list[Document]) -> list[pa.Array]:
    return [pa.array([d.text for d in found], pa.string()), *[pa.array([getattr(d, k).tobytes() for d in found], pa.binary()) for k in ("ends", "last")]]


def _stored(tok: Tokenizer, part: pa.RecordBatch) -> list[Document]:
    own = zip(*[part.column(k).to_pylist() for k in _STORED], strict=True)
    return [Document(tok, _string(t), np.frombuffer(e, np.int64), np.frombuffer(x, np.int32)) for t, e, x in own]


def encode_prefixes(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ends, last): what ``revise`` and ``stored_ids`` take; 4 bytes for each byte and 8 for each piece beside the text."""
    d = docs.select(column(docs, id_col).alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return _through(d, ranks, pattern, "t", lambda tok, part: _store([Document(tok, _string(t)) for t in part.column("t").to_pylist()]), _STORED)


def revise(stored: DataFrame, edits: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``stored`` after ``edits`` (doc_id, seq, at, removed, inserted); ``at`` beyond the end, or null, appends."""
    own = edits.where("doc_id is not null").select("doc_id", F.struct(
        F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"), F.coalesce(F.col("removed").cast("long"), F.lit(0)).alias("removed"),
        F.coalesce(F.col("inserted").cast("string"), F.lit("")).alias("inserted")).alias("e"))
    lists = own.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("edits"))
    d = stored.join(lists, "doc_id", "left").select("doc_id", blob(F.col("text")).alias("text"), "ends", "last", "edits")

    def work(tok: Tokenizer, part: pa.RecordBatch) -> list[pa.Array]:
        found = _stored(tok, part)
        for doc, own in zip(found, part.column("edits").to_pylist(), strict=True):
            for e in own or ():
                doc.replace(len(doc.text) if e["at"] is None else e["at"], e["removed"], e["inserted"])
        return _store(found)

    return _through(d, ranks, pattern, "text", work, _STORED)


def stored_ids(stored: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) read off stored prefixes."""
    d = stored.select("doc_id", blob(F.col("text")).alias("text"), "ends", "last")
    return _through(d, ranks, pattern, "text", lambda tok, part: [_ids_of([x.ids() for x in _stored(tok, part)])], {"ids": "array<int>"})


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
