"""Block search: a set of query rows against all rows, in blocks of bounded size.

Candidates are dealt out by a hash of their row into blocks of about ``block`` rows, one block a task.  A task reads its
block, builds an index over it, and asks it for every query of the batch that was broadcast; it holds one block and one batch.
Queries are sent in batches of ``most_bytes`` at most, a job each, so nothing of a query is shuffled and no broadcast grows with the table.  Each block
yields a query's best rows; the best of those, cut down before the shuffle, are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, vectors


def _usable(vector: str):
    """Not null, not empty, and all components finite."""
    x = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def blocked(
    rows: DataFrame, is_query, build, k: int, score_type: str, vector: str = "embedding", vec_id: str = "vec_id", block: int = 4096, most_bytes: int = 32 << 20
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query, best first, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``; ``build(ids, vectors)`` makes a block's index, whose
    ``search(query_ids, queries, k)`` returns for each query ids and scores of at least the ``k`` best rows with another id than the query's.  Unusable
    vectors take no part.  Rows with a null id are candidates of no query and no queries.  A repeated row is that many candidates and one query;
    rows of one id with different vectors are a query each, with ranks of its own.  Other columns, whatever their names, are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & _usable("vector"))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n // block))
    # the whole row decides the block, so that copies of one id spread as well
    dealt = rows.repartitionById(blocks, F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    asked = cut(rows.where(is_query(F.col("vec_id"))).distinct().withColumn("query", F.xxhash64("vec_id", "vector")), "queries")
    batches = max(1, -(-asked.count() * 8 * ((longest or 0) + 2) // most_bytes))
    arrow = {"long": pa.int64(), "double": pa.float64()}[score_type]
    best = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))

    def batch(part: int) -> DataFrame:
        held = asked.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == part).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((held["vec_id"].to_pylist(), held["query"].to_pylist(), [x for c in held["vector"].chunks for x in vectors(c)]))

        def run(parts):
            ids, own = [], []
            for b in parts:
                ids += b.column(0).to_pylist()
                own += vectors(b.column(1))
            if not ids:
                return
            index = build(ids, own)
            del own
            out = [], [], [], []
            all_ids, all_keys, all_vectors = sent.value
            for at in range(0, len(all_ids), 64):
                part = slice(at, at + 64)
                for i, q, (found, score) in zip(all_ids[part], all_keys[part], index.search(all_ids[part], all_vectors[part], k)):
                    for to, more in zip(out, ([i] * len(found), [q] * len(found), found, score)):
                        to.extend(more)
                if len(out[0]) > 100_000:
                    yield _found(out, arrow)
                    out = [], [], [], []
            yield _found(out, arrow)

        found = dealt.mapInArrow(run, f"query_id long, query long, vec_id long, score {score_type}")
        return found.select("query_id", best.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    if batches == 1:
        return batch(0)
    out = [cut(batch(part), "found") for part in range(batches)]
    return spark.read.schema(out[0].schema).parquet(*(x._tidewalk_path for x in out))


def _found(out, arrow) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), arrow)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["query_id", "query", "vec_id", "score"])


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def padded(held: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max(map(len, held))
    if all(len(x) == width for x in held):
        return np.vstack(held)
    out = np.zeros((len(held), width))
    for row, x in zip(out, held):
        row[: len(x)] = x
    return out


def matched(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` filled up or cut to ``width``; what is cut meets only zeros."""
    return x[:width] if len(x) >= width else np.r_[x, np.zeros(width - len(x), dtype=x.dtype)]
