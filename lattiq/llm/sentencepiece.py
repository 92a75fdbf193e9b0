"""SentencePiece encoding by streaming Viterbi, and decoding.

Pieces and their scores are read from a model file (its path is a parameter).  A text becomes the
pieces whose scores add up to most, with unknown characters as bytes, as the unigram
reading of SentencePiece defines it; the supplied file's scores are merge ranks, and they
are used as they stand.  Sums are in double precision (the library's are in single); of equal sums the
one whose last piece is longest wins.

``search`` goes through its input once, one character a step.  What begins at a position is followed only as long
as some piece begins like it.  The search keeps the best sums of the positions that a
piece can still reach back to (as many as the longest piece has characters), and for each of
them the position where its path stood when the search last looked.  Every ``LOOK`` steps it looks whether the paths of all positions
that can still be extended meet in one boundary; what lies before it is decided whatever follows: its ids are
given out and its backpointers' places are used again.  Time is linear in the input; memory is
that window, plus the backpointers of what is not decided yet.

Many streams run side by side in numpy, one a lane.  Texts are dealt to lanes in stretches of
about ``STRETCH`` characters that end before a word: no piece of the vocabulary spans that boundary, so all
paths meet there.  A run without such a boundary, however long, stays in its lane.

Normalisation is the model's identity: blanks become U+2581 with one put in front.  The character
U+2581 itself is encoded as bytes, so that decoding gives back every text exactly.

Defined results: a null text has null ids, an empty one none; null ids decode to null; repeated rows
repeat; extra columns are ignored; texts of any length are encoded whole, about ``PORTION`` characters at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import blob, chunks, column

MARK = "▁"
#: Stands for a U+2581 that was in the text: a lone surrogate, which no text can hold.
LITERAL = "\ud800"
UNKNOWN_COST = 10.0
LOOK = 64
STRETCH = 512
PORTION = 1 << 20
#: What ``search`` gives for a character that is no piece.
UNKNOWN = -1
#: Pieces are found by the top bits of their hashes.
SLOT_BITS = 21


@dataclass
class Vocabulary:
    """A model file's pieces: normal ones with scores, and the ids of single bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    pieces: list[bytes]  # by id: what it decodes to
    unknown: float
    longest: int

    def __post_init__(self):
        self.one_way = not any(MARK in p.lstrip(MARK) for p in self.ids)  # no piece spans "x▁"
        names = list(self.ids)
        h = np.array([poly(p) for p in names], np.uint64)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        self.may = self.bits(h)  # some piece may have this hash
        self.open = self.bits(np.fromiter({x for p in names for x in prefixes(p)}, np.uint64))  # some piece may begin like this
        # Slots by the top bits; pieces whose slot is taken stand in a second table, kept by other bits, or a third.
        self.tables, left = [], np.arange(len(h))
        ids, scores = np.array([self.ids[p] for p in names], np.int32), np.array([self.scores[p] for p in names])
        while len(left):
            slot = self.slot(h[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << SLOT_BITS, len(first), np.int32)
            table[slot[first]] = np.arange(len(first))
            own = left[first]
            self.tables.append((table, np.append(h[own], np.uint64(0)), np.append(ids[own], np.int32(0)), np.append(scores[own], 0.0)))
            left = np.delete(left, first)
        self.pool = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.sizes = np.array([len(p) for p in self.pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def slot(h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(64 - SLOT_BITS - 7 * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    @classmethod
    def bits(cls, h: np.ndarray) -> np.ndarray:
        """A bit for each slot: whether it is one of these hashes'."""
        held = np.zeros(1 << SLOT_BITS, bool)
        held[cls.slot(h, 0)] = True
        return np.packbits(held, bitorder="little")

    @staticmethod
    def among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Places of the hashes whose slots are set."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)
        return np.flatnonzero(bits[slot >> np.uint32(3)] >> (slot.astype(np.uint8) & np.uint8(7)) & np.uint8(1))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashes are pieces (places, in order), with their scores and ids."""
        may = self.among(self.may, h)
        h = h[may]
        places, scores, ids = [], [], []
        for k, (table, own, own_ids, own_scores) in enumerate(self.tables):
            at = table[self.slot(h, k)]
            hit = np.flatnonzero(own[at] == h)
            at = at[hit]
            places.append(may[hit])
            scores.append(own_scores[at])
            ids.append(own_ids[at])
        hit = np.concatenate(places)
        order = np.argsort(hit, kind="stable")
        return hit[order], np.concatenate(scores)[order], np.concatenate(ids)[order]


PRIME = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def prefixes(s: str) -> Iterator[int]:
    """The hashes of all beginnings of a piece, itself last."""
    h = 1469598103934665603
    for c in s:
        h = ((h ^ ord(c)) * PRIME + 0x9E3779B97F4A7C15) & _M64
        yield h


def poly(s: str) -> int:
    *_, h = prefixes(s)
    return h


@functools.lru_cache(maxsize=4)
def load(model_file: str | None = None, model: bytes | None = None) -> Vocabulary:
    """Read a SentencePiece model file (or its bytes)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    if model is None:
        with open(model_file, "rb") as f:
            model = f.read()
    proto.ParseFromString(model)
    kind = pb.ModelProto.SentencePiece
    ids, scores, single, out = {}, {}, [0] * 256, []
    for i, p in enumerate(proto.pieces):
        if p.type == kind.BYTE:
            single[int(p.piece[1:-1], 16)] = i
            out.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type in (kind.NORMAL, kind.USER_DEFINED) and p.piece:
            ids[p.piece], scores[p.piece] = i, p.score
            out.append(p.piece.replace(MARK, " ").encode())
        else:
            out.append(b"")
    return Vocabulary(ids, scores, single, out, min(scores.values()) - UNKNOWN_COST, max(map(len, ids)))


SEED, STEP = np.uint64(1469598103934665603), np.uint64(0x9E3779B97F4A7C15)


def search(v: Vocabulary, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pieces of streams, as they are decided: (place in ``codes`` of a piece's last character, id or UNKNOWN).

    Stream i is ``codes[starts[i] : starts[i] + lengths[i]]``; longer ones come first.
    """
    width, n = v.longest + 1, len(starts)
    row = np.zeros(width, np.int64)  # the position that each row of the window stands for
    sums = np.full((width, n), -np.inf)
    root = np.zeros((width, n), np.int64)  # where a position's path stood at the last look
    sums[0] = 0
    held = 4 * max(LOOK, width)  # places for backpointers: a power of two times this
    back, ids = np.zeros((held, n), np.uint8), np.zeros((held, n), np.int32)
    done = np.zeros(n, np.int64)
    # Beginnings that some piece may still continue, the oldest first: lane, row of the window, hash so far.
    lane, at, h = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    active, ended, every = n, n, np.arange(n, dtype=np.int32)  # streams [active, ended) are at their end but not given out yet

    for t in range(int(lengths[0]) if n else 0):
        while active and lengths[active - 1] <= t:
            active -= 1
        new = (t + 1) % width
        if len(lane) and active < ended:
            here = np.flatnonzero(lane < active)
            lane, at, h = lane[here], at[here], h[here]
        lane, at = np.r_[lane, every[:active]], np.r_[at, np.full(active, t % width, np.int32)]
        h = np.r_[h, np.full(active, SEED)] ^ codes[starts[:active] + t].astype(np.uint64)[lane]
        h *= np.uint64(PRIME)
        h += STEP
        live = v.among(v.open, h)
        live = live[at[live] != new]  # that row's place is the next position's
        lane, at, h = lane[live], at[live], h[live]
        hit, score, piece = v.look_up(h)
        who, begin = lane[hit], at[hit]
        alone = np.ones(active, bool)
        alone[who[begin == t % width]] = False
        alone = every[:active][alone]  # whose new character is no piece
        who, begin = np.r_[who, alone], np.r_[begin, np.full(len(alone), t % width, np.int32)]
        piece = np.r_[piece, np.full(len(alone), UNKNOWN, np.int32)]
        total = np.r_[score, np.full(len(alone), v.unknown)] + sums[begin, who]
        top = np.full(active, -np.inf)
        np.maximum.at(top, who, total)
        # Of equal sums the earliest beginning wins: it is written last.
        won = np.flatnonzero(total == top[who])[::-1]
        best, found, lanes = np.zeros(active, np.int32), np.zeros(active, np.int32), every[:active]
        best[who[won]], found[who[won]] = begin[won], piece[won]
        sums[new, :active] = top
        root[new, :active] = root[best, lanes]
        row[new] = t + 1
        place = (t + 1) % held
        back[place, :active] = t + 1 - row[best]
        ids[place, :active] = found

        if (t + 1) % LOOK and t + 1 < lengths[0]:
            continue
        over = np.arange(active, ended) if active < ended else np.zeros(0, np.int64)
        last = t + 1 == lengths[0]
        if last:  # all that is left ends here or before
            over, near = np.arange(ended), np.zeros(0, np.int64)
        elif t + 1 >= width:
            ahead = np.delete(root[:, :active], (t + 2) % width, axis=0)  # all rows that a later piece can begin at
            near = np.flatnonzero((ahead == ahead[0]).all(0))
        else:
            near = np.zeros(0, np.int64)
        to = np.r_[root[new, near], lengths[over]]
        who = np.r_[near, over].astype(np.int64)
        if len(who):
            yield _walk(back, ids, held, starts, done, who, to)
            done[who] = to
        ended = active
        if last:
            return
        root[:, near] = row[:, None]
        # Where paths have not met for long, their backpointers need more places.
        while active and t + 1 - int(done[:active].min()) + 2 * LOOK + width > held:
            p = np.arange(max(0, t + 2 - held), t + 2)
            wider = [np.zeros((2 * held, active), x.dtype) for x in (back, ids)]
            for x, old in zip(wider, (back, ids), strict=True):
                x[p % (2 * held)] = old[p % held, :active]
            (back, ids), held = wider, 2 * held


def search_one(v: Vocabulary, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same search for one stream, in plain Python: it is the faster one where few streams are left."""
    longest, score_of, id_of, unknown = v.longest, v.scores.get, v.ids, v.unknown
    sums, root, width, n = {0: 0.0}, {0: 0}, v.longest + 1, len(text)
    back: dict[int, int] = {}
    done = 0
    for end in range(1, n + 1):
        top, at = None, end - 1
        for start in range(max(0, end - longest), end):
            s = score_of(text[start:end])
            if s is None:
                if start != end - 1:
                    continue
                s = unknown
            s += sums[start]
            if top is None or s > top:
                top, at = s, start
        sums[end], back[end], root[end] = top, at, root[at]
        if end >= width:
            del sums[end - width], root[end - width]
        if end % LOOK and end < n:
            continue
        live = {end} if end == n else {root[p] for p in range(max(0, end - longest + 1), end + 1)}
        to = live.pop()
        if live:
            continue
        if to > done:
            cuts = [to]
            while cuts[-1] > done:
                cuts.append(back.pop(cuts[-1]))
            yield np.array(cuts[:-1], np.int64) - 1, np.array([id_of.get(text[a:b], UNKNOWN) for a, b in zip(cuts[1:], cuts[:-1], strict=True)], np.int32)
        for p in range(done, to):
            back.pop(p, None)
        done = to
        root = {p: p for p in root}


def _walk(back, ids, held, starts, done, who, to) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of streams ``who`` between ``done`` and ``to``; all paths are walked back together, one piece a step."""
    places, found = [], []
    to = to.copy()
    while len(who := who[live := to > done[who]]):
        to = to[live]
        places.append(starts[who] + to - 1)
        found.append(ids[to % held, who])
        to = to - back[to % held, who]
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def normalise(text: str) -> str:
    return MARK + text.replace(MARK, LITERAL).replace(" ", MARK) if text else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def stretches(v: Vocabulary, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text's beginning, and in each STRETCH characters at the first boundary that no piece spans."""
    begins = np.r_[0, ends[:-1]]
    begins = begins[begins < ends]
    if not v.one_way or not len(codes):
        return begins
    mark = codes == ord(MARK)
    cuts = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
    cell = cuts // STRETCH
    cuts = cuts[np.r_[True, cell[1:] != cell[:-1]]] if len(cuts) else cuts
    return np.unique(np.r_[begins, cuts])


def bytes_of(v: Vocabulary, code: int) -> list[int]:
    """The ids of a character that is no piece."""
    return [v.bytes_[b] for b in (MARK if chr(code) == LITERAL else chr(code)).encode()]


def expanded(v: Vocabulary, codes: np.ndarray, places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in order, with unknown characters as bytes, and how many ids stand at each place."""
    n = np.ones(len(places), np.int64)
    other = np.flatnonzero(found == UNKNOWN)
    if not len(other):
        return found, n
    kinds, which = np.unique(codes[places[other]], return_inverse=True)
    own = [np.array(bytes_of(v, int(c)), np.int32) for c in kinds]
    n[other] = np.array([len(x) for x in own])[which]
    out = np.repeat(found, n)
    first = np.cumsum(n) - n
    for k, x in enumerate(own):
        out[first[other[which == k]][:, None] + np.arange(len(x))] = x
    return out, n


def portion(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of normalised texts, end to end, and how many each text has."""
    codes, ends = codes_of("".join(texts)), np.cumsum([len(t) for t in texts])
    begins = stretches(v, codes, ends)
    lengths = np.diff(np.r_[begins, len(codes)])
    here = np.full(len(codes), UNKNOWN - 1, np.int32)
    alone = lengths > 8 * STRETCH  # a run without a boundary
    for first, n in zip(begins[alone], lengths[alone], strict=True):
        for places, found in search_one(v, codes[first : first + n].tobytes().decode("utf-32-le", "surrogatepass")):
            here[first + places] = found
    begins, lengths = begins[~alone], lengths[~alone]
    order = np.argsort(-lengths, kind="stable")
    for places, found in search(v, codes, begins[order], lengths[order]):
        here[places] = found
    places = np.flatnonzero(here >= UNKNOWN)
    ids, n = expanded(v, codes, places, here[places])
    sums = np.r_[0, np.cumsum(n)]
    upto = sums[np.searchsorted(places, ends)] if len(texts) else np.zeros(0, np.int64)
    return ids, np.diff(np.r_[0, upto])


def portions(v: Vocabulary, text: str) -> Iterator[str]:
    """A normalised text in portions that end where no piece spans, of at least PORTION characters."""
    at = 0
    while len(text) - at > PORTION and v.one_way:
        cut = at + PORTION
        while (cut := text.find(MARK, cut)) > 0 and text[cut - 1] == MARK:
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_texts(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The ids of texts."""
    parts = [(i, p) for i, t in enumerate(texts) for p in portions(v, normalise(t))]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    first = 0
    while first < len(parts):
        stop, size = first, 0
        while stop < len(parts) and (stop == first or size + len(parts[stop][1]) <= 2 * PORTION):
            size += len(parts[stop][1])
            stop += 1
        ids, n = portion(v, [p for _, p in parts[first:stop]])
        for (i, _), own in zip(parts[first:stop], np.split(ids, np.cumsum(n)[:-1]), strict=True):
            out[i].append(own)
        first = stop
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def streaming(v: Vocabulary, text: str) -> Iterator[list[int]]:
    """The ids of one normalised text in order, part by part, each as soon as it is decided."""
    codes = codes_of(text)
    for places, found in search_one(v, text):
        yield expanded(v, codes, places[::-1], found[::-1])[0].tolist()


def decode_many(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of ids that stand end to end, ``counts`` of them each; the blank that encoding put in front is taken off."""
    size = v.sizes[ids]
    ends = np.cumsum(size)
    raw = v.pool[np.arange(int(size.sum())) + np.repeat(v.starts[ids] - (ends - size), size)].tobytes()
    cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [t[1:] if t.startswith(" ") else t for t in texts]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of one sequence of ids."""
    return decode_many(v, np.asarray(ids, np.int64), np.array([len(ids)]))[0]


def encode(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``.  ``model`` is the model file's bytes, so that executors need no file."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model=held.value)
        for batch in batches:
            for part in chunks(batch, "t", 2 * PORTION):
                texts = part.column("t").to_pylist()
                rows = encode_texts(v, [(t or b"").decode("utf-8", "replace") for t in texts])
                ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
                mask = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)), mask=mask)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    d = docs.select(column(docs, id_col).alias("doc_id"), blob(column(docs, text_col)).alias("t"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for every row of ``encoded``."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model=held.value)
        for batch in batches:
            at, size = 0, batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 500_000)) + at)
                part = batch.slice(at, stop - at)
                ids = part.column("ids")
                found = decode_many(v, ids.flatten().to_numpy().astype(np.int64), size[at:stop])
                text = [t if ok else None for t, ok in zip(found, ids.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(text, pa.string())], ["doc_id", "ids", "text"])
                at = stop

    d = encoded.select(column(encoded, id_col).alias("doc_id"), column(encoded, ids_col).cast("array<int>").alias("ids"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def default_model() -> str:
    """The public 32k model file of this machine, where it is installed."""
    return "/opt/tokenizers/piece_bpe_32k.model"


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_ids, ids_hash, text_sha256) of decoded rows; ids_hash is XXH64 over the ids in order."""
    return decoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
