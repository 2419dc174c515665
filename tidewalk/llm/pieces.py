"""SentencePiece BPE encoding and decoding over a prefix table, and counts through a digest cache.

Encoding keeps, for each prefix of a text, the one token that the prefix's encoding ends in.
An automaton lists the pieces that end at a position; a piece is the last token if it is compatible
with the last token of the prefix before it, that is, if the pair alone encodes to itself.
The ids are then read off backwards.  Pieces here merge whenever their concatenation is a
piece (highest score first, then leftmost), whichever two parts it comes from, so compatibility
replays the two tokens' own merges against those across their boundary.

A text is cut where no piece can span the cut: before a run of spaces that follows another
character, and around line breaks, if the vocabulary has no piece that forbids it.  Units repeat, so a worker
keeps a bounded memo of them; a unit that isn't there is encoded again with the same result.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import as_text, cut, sliced, spread_join, table_path

SPACE = "▁"


class Memo(dict):
    """unit -> value, computed on a miss; two generations of ``most`` entries at most."""

    def __init__(self, compute, most: int = 200_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, unit):
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(unit) <= 256:
            self[unit] = value
        return value


def _separable(pieces) -> tuple[bool, bool]:
    """Whether no piece has a space after another character; whether none has a line break and more."""
    return not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces), not any("\n" in p and len(p) > 1 for p in pieces)


class PieceCodec:
    """Encoder and decoder of a SentencePiece BPE model with a dummy prefix, no other normalisation, and no escaped spaces removed.

    Models of other kinds are refused.
    """

    #: Texts by which a model of another kind is told.
    PROBES = ("the  hand of\tstone ", " \ufb01\u00e9\u3000A\u0301 x", "unbelievable internationalisation", "a\n\nb", "12,345")

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._read(lib)
        if any(lib.normalize(t) != SPACE + t.replace(" ", SPACE) or self.encode(t) != lib.encode(t) for t in self.PROBES):
            raise ValueError("not a BPE model with a dummy prefix and plain text")

    def _read(self, lib) -> None:
        self.size, self.unk = lib.get_piece_size(), lib.unk_id()
        self.piece = [lib.id_to_piece(i) for i in range(self.size)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(self.size) if lib.is_byte(i)}
        self.special = {i for i in range(self.size) if lib.is_control(i) or lib.is_unknown(i)}
        plain = [i for i in range(self.size) if not (lib.is_byte(i) or i in self.special or lib.is_unused(i))]
        self.score = {self.piece[i]: lib.get_score(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.piece[i], i)
        self.automaton.make_automaton()
        self.text = {i: self.piece[i] for i in plain}  # of tokens, and of characters that are no piece
        self.length = {i: len(p) for i, p in self.text.items()}
        self.lone: dict[str, int] = {}
        self.replays: dict[int, list] = {}
        self.pairs: dict[int, bool] = {}
        spaces, breaks = _separable(self.score)
        self.quick = spaces and breaks
        self.units = re.compile((f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if spaces else "(?s).+").findall

    def _replay(self, token: int) -> tuple[list, bool]:
        """The token's own merges as (score, first symbol, last symbol) after each, and whether they end in one symbol."""
        if (found := self.replays.get(token)) is None:
            symbols, steps = list(self.text[token]), []
            steps.append((None, symbols[0], symbols[-1]))
            while len(symbols) > 1:
                best = max(((s, -i) for i in range(len(symbols) - 1) if (s := self.score.get(symbols[i] + symbols[i + 1])) is not None), default=None)
                if best is None:
                    break
                i = -best[1]
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                steps.append((best[0], symbols[0], symbols[-1]))
            found = self.replays[token] = steps, len(symbols) == 1
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay those two tokens."""
        (a, _), (b, whole) = self._replay(left), self._replay(right)
        i = j = 0
        fits = whole
        while fits:
            across = self.score.get(a[i][2] + b[j][1])
            next_a = a[i + 1][0] if i + 1 < len(a) else None
            next_b = b[j + 1][0] if j + 1 < len(b) else None
            if across is not None and (next_a is None or across > next_a) and (next_b is None or across >= next_b):
                fits = False
            elif next_a is None and next_b is None:
                break
            elif next_b is None or next_a is not None and next_a >= next_b:
                i += 1
            else:
                j += 1
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        self.pairs[left << 32 | right] = fits
        return fits

    def _lone(self, char: str) -> int:
        """A token of its own for a character that is no piece."""
        if (found := self.lone.get(char)) is None:
            found = self.lone[char] = self.size + len(self.lone)
            self.text[found] = char
        return found

    def encode_unit(self, unit: str) -> list[int]:
        n, length, known, fits = len(unit), self.length, self.pairs.get, self._compatible
        last = [-1] * n  # at i: the last token of the prefix that ends with character i
        for end, token in self.automaton.iter(unit):
            if last[end] < 0:
                start = end - length[token]
                if start < 0:
                    ok = self._replay(token)[1]
                else:
                    if (before := last[start]) < 0:  # nothing ended there
                        before = last[start] = self._lone(unit[start])
                    if (ok := known(before << 32 | token)) is None:
                        ok = fits(before, token)
                if ok:
                    last[end] = token
        ids, at = [], n - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                token = self._lone(unit[at])
            if token < self.size:
                ids.append(token)
                at -= length[token]
            else:
                char = self.text[token].encode()
                ids += [self.byte[x] for x in reversed(char)] if self.byte else [self.unk]
                at -= 1
        ids.reverse()
        return ids

    def cut(self, text: str) -> list[str]:
        """The text in units that encode on their own.

        A unit is written without the one space before it, unless it starts with a line break;
        two line breaks mark what follows one.
        """
        if self.quick and " " not in text[:1] and "  " not in text and SPACE not in text:
            return text.replace("\n", " \n").split(" ") if text else []
        units = self.units(SPACE + text.replace(" ", SPACE)) if text else []
        return [u[1:] if u[0] == SPACE else u if u[0] == "\n" else "\n\n" + u for u in units]

    def encode_cut(self, unit: str) -> list[int]:
        """Ids of a unit as ``cut`` writes it."""
        return self.encode_unit(unit[2:] if unit[:2] == "\n\n" else unit if unit[:1] == "\n" else SPACE + unit)

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.cut(text) for i in self.encode_cut(unit)]

    def decode_units(self, ids: list[int]) -> str:
        """Text of ids, the dummy prefix still in front."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.special:
                piece = " ⁇ " if i == self.unk else ""
            elif (piece := self.text.get(i)) is None:  # a byte
                held.append(int(self.piece[i][3:5], 16))
                continue
            if held:
                out.append(_lenient(held))
                held = bytearray()
            out.append(piece)
        if held:
            out.append(_lenient(held))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_units(ids)
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and self.piece[first].startswith(SPACE) and text.startswith(" ") else text


def _lenient(raw: bytes) -> str:
    """UTF-8, each byte that is part of no character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[bytes, tuple] = {}


def _codec(model: bytes):
    """One codec and its memo a worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        codec = PieceCodec(model)

        def both(unit):
            ids = codec.encode_cut(unit)
            return ",".join(map(str, ids)), codec.decode_units(ids)

        _CODECS[key] = codec, Memo(both)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    """A tokenizer file; it travels to the workers in the task, so they need no copy of their own."""
    with open(path, "rb") as f:
        return f.read()


def round_trip(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, the columns in ``keep``, and with ``ids`` the ids.

    A null text is empty; an empty text has no ids and decodes to itself; a long one is encoded whole.  One row per input row:
    null ids and repeated rows are kept; other columns, whatever their names, are ignored.  An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), *keep)
    kept = [f for f in source.schema.fields[1:]]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = types + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        codec, memo = _codec(sent.value)
        for b in sliced(batches):
            n, a, d, flat, ends = [], [], [], array("i"), array("i", [0])
            for t in as_text(b.column(0)):
                parts = list(map(memo.__getitem__, codec.cut(t)))
                joined = ",".join([x for x, _ in parts])
                back = "".join([x for _, x in parts])[1:]  # without the dummy prefix
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                d.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    flat.extend(map(int, joined.split(",") if joined else ()))
                    ends.append(len(flat))
            more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))] if ids else []
            columns = [b.column(i) for i in range(1, b.num_columns)] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *more]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return source.mapInArrow(run, schema)


# --- token counts -------------------------------------------------------------------------------


class Counter:
    """Token counts as the library gives them.

    Where no piece has a space after another character, a text is counted by its parts between spaces:
    the library puts a space before any text, so part by part it sees the same characters.
    """

    def __init__(self, model: bytes):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        kind = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(lib.get_piece_size())]
        apart = _separable([lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not kind[i]])[0]
        same = lib.encode("a  b") + lib.encode("c") == lib.encode("a  b c") and lib.normalize(" a ") == f"{SPACE}{SPACE}a{SPACE}"
        self.parts = re.compile(" *[^ ]+| +").findall if apart and same else None
        self.memo = Memo(self._count)

    def _count(self, part: str) -> int:
        """Tokens of a part after its first space; of that space alone if the part is empty."""
        return len(self.lib.encode(part)) or len(self.lib.encode("a ")) - len(self.lib.encode("a"))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.parts is None:
            return len(self.lib.encode(text))
        text = text.replace(SPACE, " ")
        parts = text.split(" ") if "  " not in text and text[0] != " " else [x[1:] for x in self.parts(" " + text)]
        return sum(map(self.memo.__getitem__, parts))


_COUNTERS: dict[bytes, Counter] = {}


def _counter(model: bytes) -> Counter:
    key = hashlib.sha256(model).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(model)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model: bytes, cache_path: str | None = None, text: str = "text", doc_id: str = "doc_id", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, through a cache of counts by content.

    The cache is a Parquet table (digest, tokenizer, n_tokens) at ``cache_path``, one in the
    shared folder for this call only by default.  Digests are of the text with the space mark
    written as a space, which the tokenizer can't tell apart.  Digests alone are joined to the cache; texts move only if some digest is not there for this tokenizer
    version, and then one row of each such digest is encoded and its count appended; a repeated append after a
    failure does no harm.  Null texts count as empty, long ones are read whole; null ids and repeated rows are kept; other columns, whatever their names, are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    version = hashlib.sha256(model).hexdigest()
    cache_path = cache_path or table_path(spark, "token-counts")
    there = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    schema = "digest binary, tokenizer string, n_tokens long"
    stored = lambda: spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.replace(whole, F.lit(SPACE), F.lit(" "))
    digest = F.unhex(F.sha2(plain, 256)).alias("digest")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), digest, F.octet_length(whole).cast("long").alias("n_bytes")), "digests")
    # of each digest its number of rows, and one of their ids
    distinct = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "distinct")
    misses = cut(distinct.join(stored(), "digest", "left_anti"), "misses") if there else distinct
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        count, last = _counter(sent.value), None
        for b in sliced(batches):
            found, n = [], []
            for d, t in zip(b.column(0).to_pylist(), as_text(b.column(1))):
                if d != last:  # repeated rows stand side by side
                    found.append(d)
                    n.append(count(t))
                    last = d
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    if not there or not misses.isEmpty():
        own = misses.select(F.col("digest").alias("_digest"), "first").hint("merge")
        texts = docs.select(F.col(doc_id).alias("doc_id"), digest, plain.alias("text"))
        texts = texts.join(own, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("digest", "text")
        texts.mapInArrow(run, schema).write.mode("append").parquet(cache_path)
    counts = cut(distinct.select("digest", "n").join(stored(), "digest"), "counts")
    return spread_join(rows, counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
