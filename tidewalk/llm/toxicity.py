"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character 6-grams of the lower-cased text, with a space at either end
and for each run of other signs than letters and digits.  The model is fitted on at most ``sample`` labelled rows, half of
them of either class if there are as many, taken by hash of the id.  Over these, document
frequencies by class give each n-gram its naive Bayes log-count ratio and a likelihood
ratio; the ``n_features`` n-grams that tell the classes apart best become features, each worth its
log-count ratio where it occurs, and a logistic regression on them is fitted.  Scoring reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_text, cut, fold, mix64, sliced

WIDTH = 6
_TABLE = 1 << 20
_OTHER = re.compile(r"[\W_]+").sub


def hashes(text: str) -> np.ndarray:
    """A hash of each character n-gram, one for each place."""
    chars = np.frombuffer(f" {_OTHER(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    if len(chars) < WIDTH:
        chars = np.r_[chars, np.full(WIDTH - len(chars), 32, dtype=np.uint64)]
    n = len(chars) - WIDTH + 1
    h = chars[:n].copy()
    for i in range(1, WIDTH):
        h *= np.uint64(0x100000001B3)
        h += chars[i : i + n]
    return (mix64(h) >> np.uint64(1)).astype(np.int64)


class _Marks:
    """Which n-grams may be among some keys: a fixed table that lets few others through."""

    def __init__(self, keys: np.ndarray):
        self.on = np.zeros(_TABLE, dtype=bool)
        self.on[keys & (_TABLE - 1)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return h[self.on[h & (_TABLE - 1)]]


@dataclass
class ToxicityModel:
    keys: np.ndarray  # sorted hashes
    weight: np.ndarray  # regression weight times log-count ratio
    bias: float
    prior: float  # smoothed share of label 1 among all labels learned from
    marks: _Marks = field(init=False)

    def __post_init__(self):
        self.marks = _Marks(self.keys)

    def positions(self, text: str) -> np.ndarray:
        """Which features the text has."""
        h = np.unique(self.marks(hashes(text)))
        if not len(h) or not len(self.keys):
            return np.array([], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at[self.keys[at] == h]

    def score(self, text: str) -> float:
        if not text or text.isspace():
            return min(self.prior, 0.49999)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[self.positions(text)].sum(), -40, 40))))


def _frequencies(labelled: DataFrame) -> DataFrame:
    """``(gram, p, q)``: in how many texts of label 1 and of label 0 each n-gram is."""

    def run(batches):
        held, n = ([], []), 0
        for b in sliced(batches):
            for text, toxic in zip(as_text(b.column(0)), b.column(1).to_pylist()):
                held[toxic].append(np.unique(hashes(text)))
                n += len(held[toxic][-1])
                if n > 4_000_000:
                    yield from out(held)
                    held, n = ([], []), 0
        yield from out(held)

    def out(held):
        for toxic in (0, 1):
            if held[toxic]:
                keys, n = np.unique(np.concatenate(held[toxic]), return_counts=True)
                n, none = pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), n if toxic else none, none if toxic else n], names=["gram", "p", "q"])

    return labelled.select("text", "toxic").mapInArrow(run, "gram long, p long, q long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def _evidence(pos: int, neg: int) -> Column:
    """Log likelihood ratio of an n-gram's counts ``p`` of ``pos`` and ``q`` of ``neg`` against one share for both."""
    p, q, both, total = F.col("p"), F.col("q"), F.col("p") + F.col("q"), float(pos + neg)
    part = lambda a, expected: F.when(a > 0, a * F.log(a / expected)).otherwise(0.0)
    return part(p, pos * both / total) + part(q, neg * both / total) + part(pos - p, pos * (total - both) / total) + part(neg - q, neg * (total - both) / total)


def _fit(indices: np.ndarray, lengths: np.ndarray, ratio: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows whose entries are the ratios, by accelerated gradient steps; the classes weigh alike."""
    n, m = len(lengths), len(ratio)
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    value = ratio[indices]
    scale = 1 / max(np.sqrt(np.bincount(owner, weights=value**2, minlength=n).max(initial=0.0)), 1e-9)  # longest row to length 1
    value = value * scale
    w, b = np.zeros(m), 0.0
    back_w, back_b, momentum = w, b, 1.0
    each = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
    for _ in range(rounds):
        z = np.bincount(owner, weights=value * w[indices], minlength=n) + b
        g = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new_w = w - 2.0 * (np.bincount(indices, weights=value * g[owner], minlength=m) + ridge * w)
        new_b = b - 2.0 * g.sum()
        then = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        k, momentum = (momentum - 1) / then, then
        w, b, back_w, back_b = new_w + k * (new_w - back_w), new_b + k * (new_b - back_b), new_w, new_b
    return back_w * scale, float(back_b)


def _labels(labels: DataFrame, modulus: int) -> DataFrame:
    """``(_id, toxic)`` to learn from; of several labels of one id the largest counts."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("_id").isNotNull())
    return own.where(fold(F.col("_id"), modulus) != 0).groupBy("_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))


def labelled_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, sample: int = 24_000) -> DataFrame:
    """``(text, toxic)`` of at most ``sample`` labelled ids whose fold is not 0, half of either class.

    Of several labels of one id the largest counts, of several texts of one id the first in order.  The chosen
    ids, a bounded number, are broadcast, so no other text is shuffled.
    """
    own = _labels(labels, modulus)
    some = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for y in (1, 0)]
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "_id")
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def train(labelled: DataFrame, n_features: int = 2048, ridge: float = 3e-6, prior: float | None = None) -> ToxicityModel:
    """A model from the bounded rows ``labelled(text, toxic)``.

    Only ``n_features`` n-grams with their counts, and which of them each row has, reach the driver.  ``prior`` is the share of label 1, by default that of these
    rows; without rows of both classes every score is the share.
    """
    labelled = cut(labelled, "labelled")
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    prior = (pos + 0.5) / (pos + neg + 1) if prior is None else prior
    if not pos or not neg:
        return ToxicityModel(np.array([], dtype=np.int64), np.array([]), float(np.log(prior / (1 - prior))), prior)
    best = _frequencies(labelled).orderBy(F.round(_evidence(pos, neg), 9).desc(), "gram").limit(n_features).toArrow().sort_by("gram")
    keys, p, q = (best[c].to_numpy() for c in ("gram", "p", "q"))
    ratio = np.log((p + 1) / (pos + 1)) - np.log((q + 1) / (neg + 1))
    sent = labelled.sparkSession.sparkContext.broadcast(ToxicityModel(keys, ratio, 0.0, prior))

    def run(batches):
        for b in sliced(batches):
            has = [sent.value.positions(t) for t in as_text(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int32())), b.column(1)], names=["at", "toxic"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "at array<int>, toxic int").toArrow().combine_chunks()
    at, y = rows["at"].combine_chunks(), rows["toxic"].to_numpy().astype(np.float64)
    lengths = np.diff(at.offsets.to_numpy())
    weight, bias = _fit(at.flatten().to_numpy(), lengths, ratio, y, ridge)
    return ToxicityModel(keys, weight * ratio, bias, prior)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, sample: int = 24_000, **how) -> ToxicityModel:
    """A model from the labelled rows whose fold of the id is not 0; its prior is the share of label 1 among all labels learned from."""
    n, ones = _labels(labels, modulus).agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    return train(labelled_rows(docs, labels, text, doc_id, modulus, sample), prior=(ones + 0.5) / (n + 1), **how)


def classify(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5), one row per input row.

    Null and blank texts get the share of label 1 among the labels learned from, at most 0.49999, so they are kept; long texts are read whole.
    Null ids and repeated rows stay; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(text).alias("_text"), *keep)
    names = source.columns[1:]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches):
        model = sent.value
        for b in sliced(batches):
            p = np.array([model.score(t) for t in as_text(b.column(0))], dtype=np.float64)
            columns = [b.column(i) for i in range(1, b.num_columns)] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    return source.mapInArrow(run, f"{types}, score double, predicted int")


def reject(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more.

    Null and blank texts stay, and so do null ids and repeated rows of texts that stay; columns are kept whatever their names; an empty table gives an empty result.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        model = sent.value
        for b in sliced(batches):
            yield b.filter(pa.array([model.score(t) < threshold for t in as_text(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def evaluate(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, sample: int = 24_000, **how) -> DataFrame:
    """Learn from labelled rows whose fold of the id is not 0, and score all rows: ``doc_id, held_out, score, predicted``.

    Edge cases are those of ``fit`` and ``classify``; a null id counts as the empty text and teaches nothing; without labels every score is one half, just below.
    """
    model = fit(docs, labels, text, doc_id, modulus, sample, **how)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id), modulus) == 0).alias("held_out"))
    return classify(rows, model, keep=("doc_id", "held_out"))
