"""Near copies by word shingles: one row of each class of texts with a Jaccard similarity of 0.8 or more.

Each distinct text has a SimHash fingerprint of 256 bits over its set of shingles, the distances of that to 16 pivots, and the keys of
20 bands of three min-hashes.

Candidates are texts that agree in a band; a pair at the threshold shares none of the 20 with a probability of 6e-7.  Among candidates the
pivot distance table discards pairs whose coordinates differ by more than ``radius`` anywhere, then the fingerprints those that differ in more
than ``radius`` bits, and the survivors are compared on the shingle sets themselves, so no pair links below the threshold.  At a similarity of 0.8
fingerprints differ in 39 bits of 256 on average (48 for sets of four and five); 80 are exceeded with a probability below 1e-6, while unrelated
texts differ in 128.

Candidate pairs are never listed.  Texts that hang together over bands form a group, and each group of up to ``few`` texts
is one task's; larger ones are dealt out band by band.  A band of more than ``block`` texts or ``most`` shingles is dealt out in blocks, each with the band's first
text beside it, and only bands that are not one class after that are dealt out again as pairs of blocks.  In a group classes
grow: a found text is compared to those that are not in a class yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, as_bytes, cut, mix64, spread_join
from .graph import components
from .hamming import near, pivot_table, pivots, wide

_BANDS, _ROWS, _WORDS, _PIVOTS = 20, 3, 4, 16
_TURN = mix64(np.arange(1, _BANDS * _ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix64(np.arange(1001, _BANDS * _ROWS + 1001, dtype=np.uint64))
_STEP = np.uint64(0xA0761D6478BD642F)


def shingles(text: bytes, width: int = 5, known: dict | None = None) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted.  A shorter text is one shingle; one without words has the shingle 0."""
    known = {} if known is None else known
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    if len(known) > 400_000:
        known.clear()
    h = []
    for w in words:
        if (x := known.get(w)) is None:
            x = known[w] = xxhash.xxh64_intdigest(w)
        h.append(x)
    h, width = np.array(h, dtype=np.uint64), min(width, len(words))
    n = len(h) - width + 1
    out = mix64(h[:n])
    for i in range(1, width):
        out = mix64((out ^ _STEP) + h[i : i + n])
    return np.unique(out)


def bands(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of the bands of the shingle sets that begin at ``starts``, a row for each."""
    key = np.tile(np.arange(1, _BANDS + 1, dtype=np.uint64), (len(starts), 1))
    for band in range(_BANDS):
        for i in range(band * _ROWS, (band + 1) * _ROWS):
            key[:, band] = mix64(key[:, band] + np.minimum.reduceat(found * _TURN[i] + _SHIFT[i], starts))
    return key.view(np.int64)


def forest(sets: list[np.ndarray], prints: np.ndarray, table: np.ndarray, threshold: float, radius: int) -> list[tuple[int, int]]:
    """Pairs linking every class of the sets: those of all pairs with a Jaccard similarity of ``threshold`` or more."""
    size = np.array([len(x) for x in sets])
    open_, edges = np.arange(len(sets)), []
    while len(open_) > 1:
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            x = front.pop()
            some = near(prints, table, x, open_, radius)
            some = some[(size[open_[some]] >= threshold * size[x] - 1e-9) & (size[x] >= threshold * size[open_[some]] - 1e-9)]
            if not len(some):
                continue
            own, held = sets[x], [sets[y] for y in open_[some]]
            flat = np.concatenate(held)
            same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(same, np.r_[0, np.cumsum(size[open_[some]])[:-1]], dtype=np.int64)
            some = some[both >= threshold * (size[x] + size[open_[some]] - both) - 1e-9]
            found = open_[some].tolist()
            edges += [(x, y) for y in found]
            front += found
            open_ = np.delete(open_, some)
    return edges


def _node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _signs(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``(node, size, keys, print, far)`` of each distinct text: shingles, bands, fingerprint, pivot distances."""
    refs = pivots(_PIVOTS, _WORDS)

    def sign(batches):
        known: dict = {}
        for b in batches:
            nodes, texts = b.column(0).to_numpy(zero_copy_only=False), as_bytes(b.column(1))
            for at in range(0, len(texts), 128):
                sets = [shingles(t, width, known) for t in texts[at : at + 128]]
                flat, size = np.concatenate(sets), np.array([len(x) for x in sets])
                starts = np.r_[0, np.cumsum(size)[:-1]]
                prints = wide(flat, starts, _WORDS)
                far = pivot_table(prints, refs)
                columns = [
                    pa.array(nodes[at : at + 128], pa.int64()), pa.array(size, pa.int64()), pa.array(list(bands(flat, starts)), pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in prints], pa.binary()), pa.array([x.tobytes() for x in far], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "keys", "print", "far"])

    signed = docs.select(_node(text).alias("node"), F.col(text).alias("text")).mapInArrow(sign, "node long, size long, keys array<long>, print binary, far binary")
    return cut(signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "keys", "print", "far"))), "signs")


def links(docs: DataFrame, texts: DataFrame, text: str, doc_id: str, width: int, threshold: float, radius: int, few: int, block: int, most: int) -> DataFrame:
    """Edges (u, v) between texts whose components are the classes; ``texts(node, id)`` has a row of each."""
    signs = _signs(docs, text, width)
    keyed = signs.select("node", "size", F.explode("keys").alias("k"))
    full = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.sum("size").alias("all")).where("n > 1")
    full = cut(full.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("all") / most)).cast("int")).drop("all"), "full-bands")
    shared = cut(spread_join(keyed.drop("size"), full, "k"), "shared-bands")
    roots = cut(components(shared.select(F.col("node").alias("u"), F.col("first").alias("v"))), "groups")
    groups = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = cut(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("members", F.col("n")), "group-sizes")
    sized = cut(spread_join(groups, sizes, "root"), "groups")
    banded = shared.join(sized.where(F.col("members") > few).select("node"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    banded = cut(banded, "banded")
    beside = banded.where("node = first and blocks > 1").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = banded.unionByName(beside).select("node", F.xxhash64("k", "own").alias("g")).unionByName(sized.where(F.col("members") <= few).select("node", F.col("root").alias("g")))

    def compare(batches):
        known: dict = {}
        at, held = None, {}

        def out():
            nodes, rows = np.array(list(held), dtype=np.int64), list(held.values())
            prints, far = (np.frombuffer(b"".join(r[i] for r in rows), dtype=kind).reshape(len(rows), -1) for i, kind in ((1, np.uint64), (2, np.int16)))
            pairs = np.array(forest([r[0] for r in rows], prints, far, threshold, radius), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["u", "v"])

        for b in batches:
            for g, node, x, far, t in zip(*(b.column(i).to_pylist() for i in range(4)), as_bytes(b.column(4))):
                if g != at:
                    if len(held) > 1:
                        yield out()
                    at, held = g, {}
                if node not in held:
                    held[node] = shingles(t, width, known), x, far
        if len(held) > 1:
            yield out()

    def compared(asked: DataFrame) -> DataFrame:
        asked = asked.groupBy("node").agg(F.collect_set("g").alias("g")).join(texts.select("node", "id"), "node").join(signs.select("node", "print", "far"), "node").withColumnRenamed("node", "_asked")
        rows = docs.select(_node(text).alias("node"), F.col(doc_id).alias("_id"), F.col(text).alias("text"))
        sent = rows.join(asked.hint("merge"), (F.col("node") == F.col("_asked")) & F.col("_id").eqNullSafe(F.col("id"))).select(F.explode("g").alias("g"), "node", "print", "far", "text")
        return cut(sent.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long").distinct(), "links")

    found = compared(asked)
    many = banded.where("blocks > 1")
    if many.isEmpty():
        return found
    # bands of several blocks: done if the blocks have become one class, else every two blocks are compared
    classes = components(found).withColumnRenamed("node", "_node")
    open_ = many.join(classes, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    open_ = open_.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k")
    pairs = many.join(open_, "k").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    pairs = pairs.select("node", F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    return found.unionByName(compared(pairs))


def deduplicate(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, threshold: float = 0.8, radius: int = 80, few: int = 256, block: int = 2048, most: int = 1_000_000
) -> DataFrame:
    """One row of each class of near copies, with all its columns: the one with the smallest id, a null id last.

    Texts link when the Jaccard similarity of their sets of ``width``-word shingles is ``threshold`` or more (``radius`` is that of 0.8: give a wider one with a lower threshold).  Null texts and
    those without words are one class; texts are read whole, however long.  A row is known by its id and its text, so neither repeated nor null ids lose or keep others.
    Columns named as internal ones are kept as they are; an empty table gives an empty result.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), _node(text).alias("node"))
    plain = held.select("id", "text")
    first = held.groupBy("node", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("best"))
    texts = cut(first.select("node", "best.none", "best.id", "best.n"), "texts")
    roots = components(links(plain, texts, "text", "id", width, threshold, radius, few, block, most)).withColumnRenamed("node", "linked")
    rooted = texts.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node"))
    keep = rooted.groupBy("root").agg(F.min(F.struct("none", "id", "node", "n")).alias("best"))
    keep = cut(keep.select(F.col("best.node").alias("_keep"), F.col("best.id").alias("_id"), F.col("best.n").alias("_n")), "kept")
    # the rows that stay grow with the corpus: joined by shuffle at every size
    held = held.join(keep.hint("merge"), (F.col("node") == F.col("_keep")) & F.col("id").eqNullSafe(F.col("_id")))
    return held.where("_n = 1").select("row.*").unionByName(held.where("_n > 1").dropDuplicates(["_keep"]).select("row.*"))
