"""Language identification with bit-sliced Bloom filters of n-grams.

The model is one table of slots with a bit per language; an n-gram owns ``probes``
slots, and a language's bit is set in all of them if its training texts have the n-gram.  The AND of an
n-gram's slots is the set of all languages whose filter has it, read in one go.  A text's n-grams
are looked up, the bits counted by language, the counts corrected for each
filter's false positives, and the largest share wins.

N-grams are windows of five bytes of the lower-cased text with a space on either side.  All n-grams of the
training texts go in.  The classifier is fitted on about ``sample`` texts of each language, taken by hash, or all if there are fewer: over a boundless
corpus every language would have met every n-gram.  The table has as many slots as the largest language needs, ``most_words`` 64-bit words at most in
all, beyond which filters only get denser, which the correction allows for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_text, cut, fold, mix64, sliced

_LETTER = re.compile(r"[^\W\d_]").search
WIDTH = 5


def grams(text: str) -> np.ndarray:
    """The windows of bytes as numbers, one for each place."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint64)
    if len(raw) < WIDTH:
        raw = np.r_[raw, np.full(WIDTH - len(raw), 32, dtype=np.uint64)]
    n = len(raw) - WIDTH + 1
    out = raw[:n].copy()
    for i in range(1, WIDTH):
        out |= raw[i : i + n] << np.uint64(8 * i)
    return out


def slots(keys: np.ndarray, n: int, probes: int) -> list[np.ndarray]:
    """Places of the n-grams among ``n`` slots, a power of two."""
    h = mix64(keys)
    step, mask = (h >> np.uint64(32)) | np.uint64(1), np.uint64(n - 1)
    return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(probes)]


@dataclass
class LanguageFilters:
    languages: list[str]
    table: np.ndarray  # a row of 64-bit words for each slot, a bit per language
    false: np.ndarray  # share of n-grams of no language that a filter says it has
    probes: int

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram a row of bits, one of each language that has it."""
        first, *rest = slots(keys, len(self.table), self.probes)
        found = self.table[first]
        for s in rest:
            found &= self.table[s]
        n = len(self.languages)
        return np.unpackbits(found.view(np.uint8)[:, : -(-n // 8)], axis=1, bitorder="little")[:, :n]

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its share of all languages' corrected counts; ``und``, 0 for a text without a letter."""
        if not self.languages or not _LETTER(text):
            return "und", 0.0
        keys, times = np.unique(grams(text), return_counts=True)
        hits, total = times.astype(np.float64) @ self.masks(keys), times.sum()
        held = np.maximum((hits - self.false * total) / np.maximum(1 - self.false, 1e-9), 0) + 1e-9
        best = int(held.argmax())  # a tie goes to the first language in order of name
        return self.languages[best], float(held[best] / held.sum())


def _grams(training: DataFrame) -> DataFrame:
    """``(lang, gram)`` of all training texts, each once."""

    def run(batches):
        for b in sliced(batches):
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), as_text(b.column(1))):
                by.setdefault(lang, []).append(np.unique(grams(text)))
            for lang, parts in by.items():
                keys = np.unique(np.concatenate(parts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys)], names=["lang", "gram"])

    return training.mapInArrow(run, "lang string, gram long").distinct()


def train(training: DataFrame, sample: int = 20_000, probes: int = 3, most_words: int = 1 << 24) -> LanguageFilters:
    """Filters from ``training(lang, text)``; rows with a null language or text teach nothing.

    ``sample`` texts of each language, give or take the chance of a hash, are learned from.  Any number of languages; only slots, never n-grams, reach the driver.
    """
    rows = training.select("lang", "text").where("lang is not null and text is not null")
    texts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(texts)
    if not languages:
        return LanguageFilters([], np.zeros((1, 1), dtype=np.uint64), np.zeros(0), probes)
    large = {x: sample / n for x, n in texts.items() if n > sample}
    if large:
        share = F.coalesce(F.create_map(*(F.lit(v) for x in large.items() for v in x))[F.col("lang")], F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < share)
    found = cut(_grams(rows), "language-grams")
    own = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    words = -(-len(languages) // 64)
    room = 1 << max(10, int(np.ceil(np.log2(max(own.values(), default=1) * probes / np.log(2)))))
    room = min(room, 1 << int(np.log2(max(1024, most_words // words))))
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        for b in batches:
            keys = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            bit = np.array([place[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            at = np.concatenate(slots(keys, room, probes))
            mask = np.tile(np.uint64(1) << (bit % 64).astype(np.uint64), probes)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(bit // 64, probes)), pa.array(mask.view(np.int64))], names=["slot", "word", "mask"])

    # a row for each slot that is set, however many n-grams there are
    masks = found.mapInArrow(run, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((room, words), dtype=np.uint64)
    table[masks["slot"].to_numpy(), masks["word"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    fill = np.array([float((table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(languages))])
    return LanguageFilters(languages, table, fill**probes, probes)


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``lang_pred`` and ``score``, one row per input row.

    Null, empty and letterless texts are ``und`` with score 0; long ones are read whole.  Rows with null ids and repeated rows stay; other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text).alias("_text"), *keep)
    names = source.columns[1:]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches):
        model = sent.value
        for b in sliced(batches):
            found = [model.predict(t) for t in as_text(b.column(0))]
            columns = [b.column(i) for i in range(1, b.num_columns)] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, f"{types}, lang_pred string, score double")


def evaluate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", modulus: int = 5, **how) -> DataFrame:
    """Learn from the rows whose fold of the id is not 0, and predict all rows: ``doc_id, held_out, lang_pred, score``.

    Edge cases are those of ``train`` and ``identify``; a null id counts as the empty text.  Without training rows all are ``und``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), (fold(F.col(doc_id), modulus) == 0).alias("held_out"))
    return identify(rows, train(rows.where("not held_out"), **how), keep=("doc_id", "held_out"))
