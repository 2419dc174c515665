"""SimHash near-duplicates: fingerprints, pivot distance tables, verified links, classes.

Candidates: two 64-bit fingerprints that differ in at most ``radius`` bits agree in whole on at
least 3 of ``radius + 3`` bit fields, so pairs are looked for only within buckets that share
three fields (20 bucket keys of about 32 bits for the usual radius of 3).  Distances to pivots
alone can't deal pairs out to machines: nearly uniform fingerprints all lie about 32 from any
pivot, so no range of distances is selective.  Within a bucket the pivot distance table does
the work: distances to 16 reference fingerprints are computed once for each distinct fingerprint and travel with it, pairs whose
coordinates differ by more than the radius anywhere are discarded (triangle inequality), and
the survivors are verified on the fingerprints themselves.

A bucket never yields all its pairs: it yields the edges of a spanning forest.  Buckets over
``block`` rows are dealt out as pairs of blocks, so that a task holds two blocks at most.

``deduplicate`` is for whole corpora: it links by similarity, with fingerprints of 256 bits, a radius that no similar pair
exceeds, the same pivot tables, and a last look at the shingles themselves (module ``nearcopies``).
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import nearcopies
from .common import LOWER, as_bytes, cut, sliced, spread_join
from .graph import components
from .hamming import majority, near, pivots

_PIVOTS = 16


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each of a UTF-8 text's word shingles; a text of fewer words is one, one without words none."""
    words = text.translate(LOWER).split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint_all(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text, unsigned; 0 without words."""
    h = [shingle_hashes(t, width, seed) for t in texts]
    n = np.array([len(x) for x in h], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    if n.any():
        out[n > 0] = majority(np.concatenate(h), np.r_[0, np.cumsum(n[n > 0])[:-1]])
    return out


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    return int(fingerprint_all([text], width, seed)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in sliced(batches, 128):
            fps = fingerprint_all(as_bytes(b.column(1)), width, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _coordinates(fp: str) -> tuple[Column, ...]:
    """Distances to the pivots, a byte each in two longs."""
    refs = pivots(_PIVOTS).view(np.int64).ravel().tolist()
    far = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(r))).cast("long") for r in refs]
    packed = []
    for at in (0, 8):
        c = far[at]
        for i in range(1, 8):
            c = c.bitwiseOR(F.shiftleft(far[at + i], 8 * i))
        packed.append(c)
    return tuple(c.alias(f"p{i}") for i, c in enumerate(packed))


def _small(fps, table, group, largest, radius):
    """Forests of many small sorted groups at once: compare rows 1, 2, ... apart in one group."""
    parent = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    n, edges = len(fps), []
    for step in range(1, largest):
        left = np.flatnonzero(group[:-step] == group[step:]) if step < n else np.array([], dtype=np.int64)
        if not len(left):
            break
        hit = left[near(fps[:, None], table, left, left + step, radius)]
        for a, b in zip(hit.tolist(), (hit + step).tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((a, b))
    return edges


def _large(fps, table, radius, width=64):
    """Forest of one large group: grow classes; found rows are never compared again."""
    order = np.lexsort((table[:, 1], table[:, 0]))
    fps, table = fps[order], table[order]
    first, edges = table[:, 0], []
    open_ = np.arange(len(fps))  # not yet in a class, in order of the first coordinate
    while len(open_):
        front, open_ = open_[:1], open_[1:]
        while len(front) and len(open_):
            here, front = front[:width], front[width:]
            here = here[np.argsort(first[here], kind="stable")]
            lo = np.searchsorted(first[open_], first[here[0]] - radius)
            hi = np.searchsorted(first[open_], first[here[-1]] + radius, side="right")
            found = []
            for x in here.tolist():
                rest = open_[lo:hi]
                hit = rest[near(fps[:, None], table, x, rest, radius)]
                if len(hit):
                    edges += [(x, y) for y in hit.tolist()]
                    found.append(hit)
                    open_ = open_[~np.isin(open_, hit, assume_unique=True)]
                    hi -= len(hit)
            front = np.concatenate([front, *found])
    return [(int(order[a]), int(order[b])) for a, b in edges]


def forest(fps: np.ndarray, group: np.ndarray, table: np.ndarray, radius: int, small: int = 32) -> list[tuple[int, int]]:
    """Row pairs linking every class of each group; ``group`` is sorted, ``table`` has the fingerprints' pivot distances."""
    if not len(fps):
        return []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    little = np.flatnonzero(np.repeat(sizes <= small, sizes))
    edges = [(int(little[a]), int(little[b])) for a, b in _small(fps[little], table[little], group[little], small, radius)]
    for at, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        edges += [(at + a, at + b) for a, b in _large(fps[at : at + n], table[at : at + n], radius)]
    return edges


def links(distinct: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``distinct(fp)`` whose components are those of all pairs within ``radius``."""
    fields = radius + 3
    edge = [64 * i // fields for i in range(fields + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(fields), 3)):
        mask = sum(((1 << (edge[c + 1] - edge[c])) - 1) << edge[c] for c in chosen)
        mask -= (mask >> 63) << 64
        # a hash of a bucket's key stands for it: two buckets under one hash only compare more pairs
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask))))
    keyed = distinct.select("fp", *_coordinates("fp"), F.explode(F.array(*keys)).alias("bucket"))
    full = cut(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("m", F.ceil(F.col("n") / block).cast("int")), "buckets")
    dealt = (
        spread_join(keyed, full, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp", "p0", "p1")
    )

    def run(batches):
        held = np.zeros((0, 4), dtype=np.int64)

        def out(rows):
            fps = rows[:, 1].copy()
            pairs = np.array(forest(fps.view(np.uint64), rows[:, 0], rows[:, 2:].copy().view(np.uint8).astype(np.int16), radius), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, 0]]), pa.array(fps[pairs[:, 1]])], names=["u", "v"])

        for b in batches:
            held = np.r_[held, np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)]
            whole = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0  # the last group may go on
            if whole:
                yield out(held[:whole])
            held = held[whole:]
        if len(held):
            yield out(held)

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest doc_id reachable over links, the document's own included.  Null or empty texts
    have fingerprint zero and link like any other; texts are read whole, however long.  A null doc_id keeps its row and joins its
    class, and never names one (a class of null ids only has a null id).  Repeated rows repeat.
    Other columns of ``docs``, whatever their names, are ignored; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, text, doc_id, width, seed), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "names")
    classes = cut(spread_join(rooted, names.withColumnRenamed("n", "members"), "root", "members").select("fp", "n", "component_id"), "classes")
    return spread_join(fps, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id, with all its columns.

    Texts link when the Jaccard similarity of their ``width``-word shingles is ``similarity`` or more; see ``nearcopies.deduplicate``.
    """
    return nearcopies.deduplicate(docs, text, doc_id, width, similarity, **how)
