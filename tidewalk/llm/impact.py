"""Exact top-k inner products over an impact-ordered index, a score at a time.

A posting segment holds the rows of a block whose component in one dimension falls into one quantised level.
Its impact for a query is the query's component times the level.  A query reads the segments by descending
absolute impact and adds them up in one accumulator per row.  What a row may still gain or lose is bounded by the
largest and smallest impact left in each dimension, and by the width of the levels; reading stops only when these
bounds prove that few rows can be among the best, and those are scored exactly.

Queries are read for in batches: the segments that each of them reads next are columns of one matrix of impacts, zero where a query doesn't read
yet, and one product with the postings adds them to all accumulators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import search

SCALE = 256
#: Shares of the segments read at each look at the bounds.  Before half of them, bounds can't tell rows apart.
LOOKS = (0.5, 0.7, 0.85, 1.0)


class ImpactIndex:
    """Index over integer vectors; levels are ``width`` apart."""

    def __init__(self, ids, vectors, width: int = 32):
        self.ids = np.asarray(ids, dtype=np.int64)
        self.rows = np.floor(SCALE * search.padded(vectors)).astype(np.int64)
        level = self.rows // width  # floor, also below zero
        self.half = (width - 1) / 2
        postings, dims, mids, first = [], [], [], []
        for d in range(level.shape[1]):
            values, of = np.unique(level[:, d], return_inverse=True)
            first.append(len(dims))
            postings.append(of[:, None] == np.arange(len(values)))
            dims += [d] * len(values)
            mids += (values * width + self.half).tolist()
        self.postings = np.concatenate(postings, axis=1).astype(np.float32)  # a column of rows for each segment
        self.dims, self.mids, self.first = np.array(dims), np.array(mids), np.array(first)
        self.few = max(64, len(self.ids) // 12)  # below that, scoring them exactly is cheaper than reading on

    def search(self, query_ids: list[int], queries: list[np.ndarray], k: int):
        """Ids and scores of the best rows for each query."""
        n, width = self.rows.shape
        q = np.stack([search.matched(np.floor(SCALE * x).astype(np.int64), width) for x in queries])
        impact = q[:, self.dims] * self.mids  # a row for each query
        order = np.argsort(-np.abs(impact), axis=1, kind="stable")
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], axis=1)  # when each segment is read
        # what the levels' width hides, and what single precision may lose
        blur = np.abs(q).sum(axis=1) * self.half + np.abs(impact).sum(axis=1) * width * 2.0**-22
        total, some, open_, at = np.zeros((len(q), n), dtype=np.float32), {}, np.arange(len(q)), 0
        for share in LOOKS:
            upto = int(np.ceil(share * order.shape[1]))
            own, mine = turn[open_], impact[open_]
            total[open_] += np.where((own >= at) & (own < upto), mine, 0).astype(np.float32) @ self.postings.T
            left, at = np.where(own >= upto, mine, 0.0), upto  # a row already met in a dimension gains 0 there
            gain = np.maximum(np.maximum.reduceat(left, self.first, axis=1), 0).sum(axis=1) + blur[open_]
            loss = np.minimum(np.minimum.reduceat(left, self.first, axis=1), 0).sum(axis=1) - blur[open_]
            going = []
            for i, more, less in zip(open_.tolist(), gain.tolist(), loss.tolist()):
                other = self.ids != query_ids[i]
                if n > k:
                    least = np.where(other, total[i] + np.float64(less), -np.inf)
                    some[i] = np.flatnonzero((total[i] + np.float64(more) >= np.partition(least, n - k)[n - k]) & other)
                else:
                    some[i] = np.flatnonzero(other)
                if n > k and len(some[i]) > self.few:
                    going.append(i)
            open_ = np.array(going, dtype=np.int64)
            if not len(open_):
                break
        out = []
        for i in range(len(q)):
            exact = self.rows[some[i]] @ q[i]
            best = search.top(self.ids[some[i]], exact, k)
            out.append((self.ids[some[i]][best].tolist(), exact[best].tolist()))
        return out


def top_inner_products(rows: DataFrame, is_query, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id", block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` other rows with the largest inner product.

    Components are floor(256 * x).  Ties go to the smaller id; fewer candidates give fewer rows.  Null vectors, empty
    ones, those with null or non-finite components, and rows with a null id take no part; shorter vectors count as filled up with zeros.
    A row never finds rows of its own id.  A repeated row is that many candidates and asks once; rows of one id with different vectors ask each, with
    ranks of their own.  Other columns, whatever their names, are ignored; an empty table gives an empty result.
    Components are taken to be below 2**20, so that scores fit a long.
    """
    return search.blocked(rows, is_query, ImpactIndex, k, "long", vector, vec_id, block)
