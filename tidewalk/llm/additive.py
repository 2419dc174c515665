"""Approximate nearest neighbours by cosine, with additive quantisation.

A unit vector is coded as the sum of one full-dimensional codeword of each codebook, found by
beam search; codebooks are trained one after the other on residuals, over a bounded sample.  Each row stores its
codes and the norm of the sum.  Equal vectors are coded once, with all their ids.  A query makes one table of inner products with all codewords, scores
every row by looking its codes up and the stored norm, and reranks the best exactly
on the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import search


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def _codebook(x: np.ndarray, size: int, rounds: int, rng) -> np.ndarray:
    """k-means centres; a centre without rows moves to the row that is coded worst."""
    centres = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=size)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        total = np.zeros_like(centres)
        total[some] = np.add.reduceat(x[order], np.r_[0, np.cumsum(n)[:-1]][some], axis=0)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if (n == 0).any():
            worst = np.argsort(-((x - centres[near]) ** 2).sum(1))[: int((n == 0).sum())]
            centres[np.flatnonzero(n == 0)[: len(worst)]] = x[worst]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of every row: the best of ``beam`` partial sums kept from codebook to codebook."""
    out = []
    for part in np.array_split(x, max(1, len(x) // 2048)):
        n = len(part)
        left = part[:, None, :]  # residual of each partial sum
        codes = np.zeros((n, 1, 0), dtype=np.int32)
        for book in books:
            size = len(book)
            loss = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
            flat = loss.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1), 1)
            came, code = best // size, best % size
            rows = np.arange(n)[:, None]
            left = left[rows, came] - book[code]
            codes = np.concatenate([codes[rows, came], code[:, :, None].astype(np.int32)], axis=2)
        out.append(codes[:, 0])
    return np.concatenate(out) if out else np.zeros((0, len(books)), dtype=np.int32)


def train(sample: np.ndarray, n_books: int = 16, size: int = 256, rounds: int = 8) -> np.ndarray:
    """Codebooks (n_books, size, dimensions) from unit vectors, each on what the ones before leave of the sample."""
    rng = np.random.default_rng(7)
    books: list[np.ndarray] = []
    left = sample.astype(np.float32)
    for _ in range(n_books):
        books.append(_codebook(left, size, rounds, rng))
        left = left - books[-1][_nearest(left, books[-1])]
    return np.array(books, dtype=np.float64)


class AdditiveIndex:
    """Codes and norms of a block of vectors, and the vectors themselves for the last step."""

    def __init__(self, ids, vectors, books: np.ndarray, beam: int, rerank: float):
        self.books, self.rerank = books, rerank
        self.rows, of = np.unique(search.padded(vectors), axis=0, return_inverse=True)  # copies have one code, and one place in the cut
        ids, of = np.asarray(ids, dtype=np.int64), of.ravel()
        order = np.lexsort((ids, of))
        self.ids = np.split(ids[order], np.cumsum(np.bincount(of))[:-1])  # of each distinct vector, rising
        self.holds: dict[int, set[int]] = {}
        for i, x in zip(ids.tolist(), of.tolist()):
            self.holds.setdefault(i, set()).add(x)
        self.length = np.sqrt((self.rows**2).sum(1))
        width = books.shape[2]
        unit = np.array([search.matched(x, width) for x in self.rows / self.length[:, None]], dtype=np.float32)
        self.codes = encode(unit, books.astype(np.float32), beam).T.copy()
        coded = sum(b[c] for b, c in zip(books, self.codes))
        self.norm = np.maximum(np.sqrt((coded**2).sum(1)), 1e-9)

    def search(self, query_ids: list[int], queries: list[np.ndarray], k: int):
        """Ids and scores of the nearest rows found for each query."""
        return [self._search(i, x, k) for i, x in zip(query_ids, queries)]

    def _search(self, query_id: int, x: np.ndarray, k: int):
        width, dims = self.books.shape[2], self.rows.shape[1]
        tables = self.books @ search.matched(x, width)
        guess = tables[0][self.codes[0]]
        for table, code in zip(tables[1:], self.codes[1:]):
            guess += table[code]
        guess /= self.norm
        few = min(max(4 * k, int(np.ceil(self.rerank * len(guess)))) + len(self.holds.get(query_id, ())), len(guess))
        some = np.flatnonzero(guess >= -np.partition(-guess, few - 1)[few - 1])  # equal guesses are never cut apart
        q = search.matched(x, dims)
        exact = (self.rows[some] * q).sum(1) / (self.length[some] * np.sqrt((x * x).sum()))
        ids, scores = [], []
        for at in np.argsort(-exact, kind="stable").tolist():
            if len(ids) >= k and exact[at] < scores[-1]:
                break
            own = self.ids[some[at]]
            own = own[own != query_id][:k].tolist()
            ids += own
            scores += [exact[at]] * len(own)
        ids, scores = np.array(ids, dtype=np.int64), np.array(scores, dtype=np.float64)
        best = search.top(ids, scores, k)
        return ids[best].tolist(), scores[best].tolist()


def nearest(
    rows: DataFrame, is_query, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id",
    n_books: int = 16, size: int = 256, beam: int = 4, rerank: float = 0.03, sample: int = 8_192, block: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest other rows found, score the exact cosine.

    Every row is indexed; codebooks are trained on the ``sample`` rows with the smallest hashes.  A share ``rerank`` of the distinct vectors of each block, ``4 k`` at least, and
    those of equal guess, are compared exactly.  Ties go to the smaller id; fewer candidates give fewer rows.  Null, empty and zero vectors, those with null
    or non-finite components, and rows with a null id take no part; shorter vectors count as filled up with zeros.  A row never finds rows of its own id.  A repeated row is that many
    candidates and asks once; rows of one id with different vectors ask each, with ranks of their own.  Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    x = F.col(vector).cast("array<double>")
    rows = rows.where(search._usable(vector) & F.exists(x, lambda v: v != 0))
    taken = rows.select(F.col(vector).alias("v"), F.xxhash64(vec_id).alias("h")).orderBy("h").limit(sample).select(F.col("v").cast("array<double>").alias("v")).toArrow()
    held = [np.array(v) for v in taken["v"].to_pylist()]
    unit = search.padded(held) if held else np.ones((1, 1))
    books = train(unit / np.sqrt((unit**2).sum(1))[:, None], n_books, min(size, max(1, len(unit))))
    sent = rows.sparkSession.sparkContext.broadcast(books)
    return search.blocked(rows, is_query, lambda ids, vs: AdditiveIndex(ids, vs, sent.value, beam, rerank), k, "double", vector, vec_id, block)
