"""Language-model scores with a log-frequency Bloom filter.

Counts of words, word pairs and word triples, quantised on a log scale, are held in a Bloom filter: a gram of level q is
stored under (gram, 1) .. (gram, q), and its level is read back by probing (gram, 1), (gram, 2), ... until a probe fails.
Probabilities are smoothed from such probes: a triple's share of its pair is mixed with the pair's share of its word, and that
with the word's own share, each the more the rarer the context is.

The filter is cut into ranges of the grams' hash.  Each range is built by one task from the counts of all its grams and sized
for them, so no gram is left out at any size; there are as many ranges as the text needs.  Up to ``most_bytes`` the filter is
broadcast.  A larger one stays in the shared folder: each chunk of texts then asks each range for its grams, and the answers, the same
as a broadcast filter's, come back to the chunk.

The plain add-one score beside it is exact: each chunk's distinct words are joined to the corpus counts, by ranges as well.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, as_bytes, cut, fold, given_back, mix64

END = b""  # no word is empty
_START, _PAIR, _TRIPLE, _WORD = np.uint64(0x5D1E57A7), np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0xE7037ED1A0B428DB)
_FLUSH = 2_000_000
_LOW = np.uint64(0xFFFFFFFF)


# --- texts ----------------------------------------------------------------------------------------


_BYTE = mix64(np.arange(7001, 7257, dtype=np.uint64))
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE, _WINDOW = 0x9E3779B97F4A7C15, 1 << 20
_powers: list[np.ndarray] = []


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``raw[start:end]``: a polynomial of its bytes from running sums, a window of the texts at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    edges = np.searchsorted(starts, np.arange(0, len(raw) + _WINDOW, _WINDOW)).tolist()
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        low, high = int(starts[a]), int(ends[b - 1])
        if not _powers or len(_powers[0]) <= high - low:
            n = max(high - low, _WINDOW) + 256
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, dtype=np.uint64)]) for x in (_BASE, pow(_BASE, -1, 2**64))]
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * _powers[1][: high - low], out=sums[1:])
        first, last = starts[a:b] - low, ends[a:b] - low
        out[a:b] = (sums[last] - sums[first]) * _powers[0][last]
    return mix64(out + (ends - starts).astype(np.uint64))


def _once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values' first places, in the values' order, and each value's rank."""
    low = int(len(h)).bit_length()
    mask = np.uint64((1 << low) - 1)
    both = np.sort((h & ~mask) | np.arange(len(h), dtype=np.uint64))
    order = (both & mask).astype(np.int64)
    new = np.r_[True, h[order[1:]] != h[order[:-1]]]
    if (new[1:] & (both[1:] & ~mask == both[:-1] & ~mask)).any():  # values that differ in their last bits only
        _, first, rank = np.unique(h, return_index=True, return_inverse=True)
        return first, rank
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


@dataclass
class Tokens:
    """The words of some texts, each distinct one once, in order of their hashes."""

    words: list[bytes]
    h: np.ndarray  # of the distinct words, rising
    at: np.ndarray  # each token's word
    starts: np.ndarray  # of each text

    @staticmethod
    def of(texts: list[bytes]) -> Tokens:
        joined = b"\n".join(texts).translate(LOWER)
        raw = np.frombuffer(joined, dtype=np.uint8) if joined else np.zeros(0, dtype=np.uint8)
        blank = np.r_[True, _BLANK[raw], True]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edges[0::2], edges[1::2]
        h = np.r_[_hashes(raw, first, last), np.uint64(0)]  # 0 is the end
        places, rank = _once(h)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        text = np.searchsorted(offsets, first, side="right") - 1
        n = np.bincount(text, minlength=len(texts))
        at = np.empty(len(first) + len(texts), dtype=np.int64)
        ends = np.cumsum(n + 1) - 1
        at[np.arange(len(first)) + text] = rank[:-1]
        at[ends] = rank[-1]
        first, last = np.r_[first, 0][places], np.r_[last, 0][places]
        return Tokens([joined[a:b] for a, b in zip(first.tolist(), last.tolist())], h[places], at, np.r_[0, ends[:-1] + 1])

    def _before(self, of_word: np.ndarray, of_start: np.uint64) -> np.ndarray:
        """A number of each token's predecessor."""
        out = np.empty(len(self.at), dtype=np.uint64)
        out[1:] = of_word[self.at[:-1]]
        out[self.starts] = of_start
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the pair and the triple that end at each token, and which tokens have a triple (all but a text's first)."""
        start = np.array([_START])
        pairs = mix64(self._before(mix64(self.h ^ _PAIR), mix64(start ^ _PAIR)[0]) + self.h[self.at])
        first, lone = mix64(self.h ^ _TRIPLE), mix64(start ^ _TRIPLE)[0]
        two = self._before(first, lone)
        two[1:] = two[:-1].copy()  # the predecessor's predecessor; wrong for a text's first token only, which has no triple
        inner = np.ones(len(self.at), dtype=bool)
        inner[self.starts] = False
        return pairs, mix64(two + pairs), inner


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ _WORD)


def portions(texts: list[bytes], most: int = 4 << 20):
    """The texts in parts of about so many bytes."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + 64
        if n > most:
            yield part
            part, n = [], 0
    if part:
        yield part


# --- the filter -----------------------------------------------------------------------------------


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each factor of the root of two."""
    return 1 + np.floor(2 * np.log2(np.maximum(count, 1)) + 1e-9).astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for; 0 for none."""
    low, high = np.ceil(2 ** ((levels - 1) / 2) - 1e-9), np.ceil(2 ** (levels / 2) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(high, low)) / 2, 0.0)


def split(keys: np.ndarray, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's range, its highest bits, and the 32 bits after them."""
    of = (keys >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(keys), dtype=np.int64)
    return of, ((keys << np.uint64(range_bits)) >> np.uint64(32)).astype(np.uint32)


def _spots(suffix: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of a suffix's probes at level ``q``, of 32 bits."""
    h = mix64(suffix.astype(np.uint64) + np.uint64(q * 0x9E3779B97F4A7C15 % 2**64))
    return h & _LOW, (h >> np.uint64(32)) | np.uint64(1)


def _bit(h: np.ndarray, step: np.ndarray, i: int, room) -> np.ndarray:
    return (((h + np.uint64(i) * step) & _LOW) * room) >> np.uint64(32)


def filled(suffix: np.ndarray, count: np.ndarray, probes: int) -> tuple[int, np.ndarray]:
    """The number of bits that all of a range's grams fill by half, and the bits."""
    q = level(count)
    room = min(max(64, int(np.ceil(int(q.sum()) * probes / np.log(2)))), 2**32 - 1)
    on = np.zeros(room, dtype=bool)
    order = np.argsort(-q, kind="stable")
    suffix, q = suffix[order], q[order]
    for i in range(1, int(q.max(initial=0)) + 1):
        h, step = _spots(suffix[: np.searchsorted(-q, -i, side="right")], i)
        for place in range(probes):
            on[_bit(h, step, place, np.uint64(room)).astype(np.int64)] = True
    return room, np.packbits(on, bitorder="little")


def read_levels(bits: np.ndarray, base: np.ndarray, room: np.ndarray, suffix: np.ndarray, probes: int) -> np.ndarray:
    """Levels of suffixes in ranges of ``room`` bits from bit ``base``, by probes of rising level until one fails."""
    found, at, q = np.zeros(len(suffix), dtype=np.int64), None, 0
    while len(suffix) and q < 128:
        q += 1
        h, step = _spots(suffix, q)
        hit = np.uint8(1)
        for _ in range(probes):
            spot = h & _LOW
            spot *= room
            spot >>= np.uint64(32)
            spot += base
            shift = spot.astype(np.uint8)
            shift &= np.uint8(7)
            spot >>= np.uint64(3)
            on = bits.take(spot.view(np.int64))
            on >>= shift
            hit = on & hit
            h += step
        hit = np.flatnonzero(hit)
        at, base, room, suffix = hit if at is None else at[hit], base[hit], room[hit], suffix[hit]
        found[at] = q
    return found


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that differ in their first ``bits`` bits, rising, and each key's place among them."""
    low = max(1, int(len(keys) - 1).bit_length())
    if bits + low > 64:
        return np.unique(keys, return_inverse=True)
    mask = np.uint64((1 << low) - 1)
    both = np.sort((keys & ~mask) | np.arange(len(keys), dtype=np.uint64))
    order, both = (both & mask).astype(np.int64), both & ~mask
    new = np.r_[True, both[1:] != both[:-1]] if len(both) else np.zeros(0, dtype=bool)
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return both[new], back


@dataclass
class CountFilter:
    """All ranges' bits one after the other."""

    bits: np.ndarray  # bytes
    base: np.ndarray  # first bit of each range
    room: np.ndarray  # bits of each range
    range_bits: int
    probes: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        own, back = distinct(keys, self.range_bits + 32)
        of, suffix = split(own, self.range_bits)
        return read_levels(self.bits, self.base[of], self.room[of], suffix, self.probes)[back]


def collected(ranges: DataFrame, size: int, range_bits: int, probes: int) -> CountFilter:
    """The filter of ``ranges(range, room, bits)``, of ``size`` bytes in all, a sixteenth of the ranges at a time."""
    bits, base, room = np.zeros(size + 8, dtype=np.uint8), np.zeros(1 << range_bits, dtype=np.uint64), np.full(1 << range_bits, 64, dtype=np.uint64)
    at, step = 8, max(1, (1 << range_bits) // 16)  # a range without grams has the first 64 bits, all empty
    for low in range(0, 1 << range_bits, step):
        for r, n, part in ranges.where(F.col("range").between(low, low + step - 1)).select("range", "room", "bits").toLocalIterator():
            base[r], room[r] = 8 * at, n
            bits[at : at + len(part)] = np.frombuffer(part, dtype=np.uint8)
            at += len(part)
    return CountFilter(bits, base, room, range_bits, probes)


def mapped(sent: Broadcast, size: int) -> np.ndarray:
    """The ``size`` broadcast bytes, mapped from the file that Spark keeps of a broadcast: an executor's workers share its pages and have no copies.

    The bytes stand in the file as one pickled run.  Where there is no such file (Spark encrypts it), or none with the run, it is the worker's copy.
    """
    path = sent.__dict__.get("_path")
    if path:
        with open(path, "rb") as f:
            at = f.read(4096).find(pickle.BYTEARRAY8 + size.to_bytes(8, "little"))
        if at >= 0:
            return np.memmap(path, np.uint8, "r", at + 9, (size,)).view(np.ndarray)
    return sent.value


@dataclass
class Answers:
    """Levels of some sorted keys, as the ranges gave them."""

    keys: np.ndarray
    found: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.keys, keys)]


# --- blobs ----------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all, which compresses."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _packed(suffix: np.ndarray) -> bytes:
    """Sorted suffixes as differences."""
    return _planes(np.diff(suffix, prepend=np.uint32(0)))


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(x), dtype=np.uint32)


def _highs(keys: np.ndarray, bits: int) -> list[int]:
    """Where each range of sorted keys ends."""
    lows = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
    return [*np.searchsorted(keys, lows).tolist(), len(keys)]


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Range, start and end of the ranges that sorted keys have."""
    edges = [0, *_highs(keys, bits)]
    return [(r, a, b) for r, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


_GRAMS = "range int, suffix binary, words binary, count binary"
_RANGES = "range int, room long, bits binary, words binary, count binary, n long, v long"
_ASKED = "range int, chunk long, suffix binary, words binary"
_TOLD = "chunk long, range int, levels binary, count binary"


def _counted(training: DataFrame, range_bits: int) -> DataFrame:
    """Each part of the texts gives each range its grams' suffixes and, apart, its words, with their counts."""

    def grams(t: Tokens):
        pairs, triples, inner = t.keys()
        return [pairs, triples[inner], word_keys(np.full(len(t.starts), _START))], zip(t.words, t.h.tolist(), np.bincount(t.at, minlength=len(t.words)).tolist())

    def run(batches):
        held, n, seen = [], 0, {}

        def out():
            words = sorted(seen, key=seen.__getitem__)
            h, own = (np.array([seen[w][i] for w in words], dtype=np.uint64) for i in (0, 1))
            keys = np.concatenate(held)
            held.clear()
            seen.clear()
            keys.sort()  # in place: these are the largest arrays of a part
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            count, keys = np.diff(first, append=len(keys)), keys[first]
            of_word = word_keys(h)
            order = np.argsort(of_word)
            rows, low, word_low = [], 0, 0
            for r, (high, word_high) in enumerate(zip(_highs(keys, range_bits), _highs(of_word[order], range_bits))):  # range by range: no second copy of all
                few = order[word_low:word_high]
                k, c = np.r_[keys[low:high], of_word[few]], np.r_[count[low:high], own[few].astype(np.int64)]
                if len(k):
                    sorting = np.argsort(k, kind="stable")
                    rows.append((r, _packed(split(k[sorting], range_bits)[1]), None, _planes(np.minimum(c[sorting], 2**32 - 1))))
                low, word_low = high, word_high
            del keys, count, first
            rows += [(r, None, b" ".join(words[a:b]), _planes(own[a:b])) for r, a, b in _cuts(h, range_bits)]
            r, s, w, c = zip(*rows)
            return _table(_GRAMS, range=r, suffix=s, words=w, count=c).to_batches()

        for b in batches:
            for part in portions(as_bytes(b.column(0))):
                keys, words = grams(Tokens.of(part))
                held += keys
                n += len(keys[0])
                for w, h, c in words:
                    had = seen.get(w)
                    seen[w] = (h, c if had is None else had[1] + c)
                if n > _FLUSH:
                    given_back(None)
                    yield from given_back(out())
                    n = 0
        if held:
            yield from given_back(out())

    return training.select("text").mapInArrow(run, _GRAMS)


def _merged(suffixes, counts):
    suffix, back = np.unique(np.concatenate(suffixes), return_inverse=True)
    return suffix, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def train(training: DataFrame, range_bits: int = 7, probes: int = 4) -> DataFrame:
    """The filter of ``training(text)`` as a table ``(range, room, bits, words, count, n, v)`` in the shared folder.

    Beside a range's bits stand its words with their exact counts, the number of tokens ``n`` and of distinct words ``v``.  A range is
    one task: give more range bits with more text (some 100 MB of texts a range is well).
    """

    def build(table: pa.Table) -> pa.Table:
        suffixes, counts, total, n = [], [], defaultdict(int), 0
        for s, w, c in zip(*(table[x].to_pylist() for x in ("suffix", "words", "count"))):
            c = _from_planes(c)
            if w is not None:
                for word, k in zip(w.split(b" "), c.tolist()):
                    total[word] += k
                continue
            suffixes.append(_unpacked(s))
            counts.append(c.astype(np.int64))
            n += len(c)
            if n > 2 * _FLUSH and len(counts) > 8:
                s, c = _merged(suffixes, counts)
                suffixes, counts, n = [s], [c], 0
        words = list(total)
        own = np.array([total[w] for w in words], dtype=np.int64)
        rows = []
        if suffixes:
            room, bits = filled(*_merged(suffixes, counts), probes)
            rows.append((room, bits.tobytes(), None, None, 0, 0))
        if words:
            rows.append((None, None, b" ".join(words), own.tobytes(), int(own.sum()), len(own)))
        r = table["range"][0].as_py()
        room, bits, words, count, n, v = zip(*rows)
        return _table(_RANGES, range=[r] * len(rows), room=room, bits=bits, words=words, count=count, n=n, v=v)

    return cut(_counted(training, range_bits).groupBy("range").applyInArrow(lambda table: given_back(build(table)), _RANGES), "ranges")


def score_tokens(model: CountFilter | Answers, t: Tokens, n: int, v: int, pair_weight: float = 400.0, triple_weight: float = 10.0) -> np.ndarray:
    """log10 probability of each token, by the counts that the model's levels stand for.

    P1(w) = (c(w) + 1) / (n + v + 1); P2(w | v) = (c(v, w) + a P1(w)) / (c(v) + a); P3(w | u, v) = (c(u, v, w) + b P2(w | v)) / (c(u, v) + b);
    a text's first token has P2 after the start.  A gram's count is at most its context's.
    """
    pairs, triples, inner = t.keys()
    stands = expected(np.arange(129))
    read = lambda keys: stands[model.levels(keys)]
    own = read(word_keys(np.r_[t.h, _START]))
    word = own[t.at]
    context = np.r_[own[-1], word[:-1]]
    context[t.starts] = own[-1]

    pair = np.minimum(read(pairs), np.minimum(context, word))
    out = (word + 1) / (n + v + 1.0)
    out = (pair + pair_weight * out) / (context + pair_weight)
    before = np.r_[0.0, pair[:-1]][inner]
    triple = np.minimum(read(triples[inner]), np.minimum(before, pair[inner]))
    out[inner] = (triple + triple_weight * out[inner]) / (before + triple_weight)
    return np.log10(out)


def evaluate(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 7, held: int = 2, pair_weight: float = 400.0, triple_weight: float = 10.0,
    probes: int = 4, chunk_bytes: int = 2 << 20, range_bits: int | None = None, most_bytes: int = 256 << 20,
) -> DataFrame:
    """Learn from the rows whose fold of the id is not ``held``, and score all: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null or empty text is one end token.  Null ids and repeated rows stay (rows that repeat id and text are scored in one task);
    a very long text is one chunk of its own; other columns, whatever their names, are ignored; without training rows all counts are 0; an empty table gives an
    empty result.  A filter of up to ``most_bytes`` is broadcast, a larger one is asked range by range.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(F.col(doc_id), modulus) == held).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if range_bits is None:
        range_bits = max(7, int(np.ceil(np.log2(max(1, size / (64 << 20))))))
    chunks = max(1, -(-size // chunk_bytes))
    ranges = train(rows.where("not held_out"), range_bits, probes)
    n, v, filter_bytes = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()
    small = filter_bytes <= most_bytes
    parts = ranges.where("bits is not null").select("range", "room", "bits")
    sent = sent_bytes = layout = None
    if small:
        model = collected(parts, filter_bytes, range_bits, probes)
        sent, sent_bytes, layout = docs.sparkSession.sparkContext.broadcast(model.bits), len(model.bits), (model.base, model.room, range_bits, probes)
        del model

    def keys_of(t: Tokens) -> np.ndarray:
        pairs, triples, inner = t.keys()
        return np.unique(np.concatenate([pairs, triples[inner], word_keys(np.r_[t.h, _START])]))

    def ask(table: pa.Table) -> pa.Table:
        texts, chunk = as_bytes(table["text"].combine_chunks()), table["chunk"][0].as_py()
        t = Tokens.of(texts)
        out = [(r, None, b" ".join(t.words[a:b])) for r, a, b in _cuts(t.h, range_bits)]
        if not small:
            keys = keys_of(t)
            suffix = split(keys, range_bits)[1]
            out += [(r, _packed(suffix[a:b]), None) for r, a, b in _cuts(keys, range_bits)]
        r, s, w = zip(*out)
        return _table(_ASKED, range=r, chunk=[chunk] * len(r), suffix=s, words=w)

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        total, bits, room = {}, None, 64
        for w, c, b, k in zip(*(own[x].to_pylist() for x in ("words", "count", "bits", "room"))):
            if w is not None:
                total = dict(zip(w.split(b" "), np.frombuffer(c, dtype=np.int64).tolist()))
            elif b is not None:
                bits, room = np.frombuffer(b, dtype=np.uint8), k
        chunk, of, levels, counts = [], [], [], []
        for r, k, s, w in zip(*(asked[x].to_pylist() for x in ("range", "chunk", "suffix", "words"))):
            chunk.append(k)
            of.append(r)
            if w is not None:
                levels.append(None)
                counts.append(np.array([total.get(x, 0) for x in w.split(b" ")], dtype=np.int64).tobytes())
            else:
                s = _unpacked(s)
                given = np.zeros(len(s)) if bits is None else read_levels(bits, np.zeros(len(s), dtype=np.uint64), np.full(len(s), room, dtype=np.uint64), s, probes)
                levels.append(given.astype(np.uint8).tobytes())
                counts.append(None)
        return _table(_TOLD, chunk=chunk, range=of, levels=levels, count=counts)

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        t, told = Tokens.of(as_bytes(table["text"].combine_chunks())), told.sort_by("range")
        both = lambda c: b"".join(told[c].drop_null().to_pylist())
        count = np.frombuffer(both("count"), dtype=np.int64)
        model = CountFilter(mapped(sent, sent_bytes), *layout) if small else Answers(keys_of(t), np.frombuffer(both("levels"), dtype=np.uint8).astype(np.int64))
        total = lambda x: np.add.reduceat(x, t.starts)
        length = np.diff(np.r_[t.starts, len(t.at)])
        base = total(np.log10(count + 1.0)[t.at]) - length * np.log10(n + v + 1.0)
        out = total(score_tokens(model, t, n, v, pair_weight, triple_weight))
        columns = [table["doc_id"], table["held_out"], pa.array(length.astype(np.int64)), pa.array(total((count > 0)[t.at].astype(np.int64))), pa.array([n] * len(length), pa.int64()), pa.array(base), pa.array(out)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by_chunk = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).groupBy("chunk")
    held_back = ranges.where("words is not null").drop("bits").withColumn("bits", F.lit(None).cast("binary")) if small else ranges
    told = held_back.groupBy("range").cogroup(by_chunk.applyInArrow(lambda table: given_back(ask(table)), _ASKED).groupBy("range"))
    told = told.applyInArrow(lambda own, asked: given_back(answer(own, asked)), _TOLD)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(lambda table, told: given_back(score(table, told)), schema)
