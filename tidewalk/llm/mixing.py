"""Mixing sources to target weights by temperature.

Each source's weight is its token share to the power alpha, normalised.  Alpha is found by bisection
so that the mix has a target entropy, or is the flattest one in which no source is repeated more often than a limit.
The weights are realised within a token budget by block permutations: a source that is
to be seen 2.3 times gives two whole blocks, each a permutation of all its documents, and the first
part of a third one, up to the tokens it still owes.

Only sums over sources reach the driver.  A source's last block is cut by a threshold on the hash that
permutes it, found from sums over 4,096 ranges of that hash, then over 4,096 parts of one range, then within one part, so no source's
documents are ever gathered in one place.  Texts are counted once, into a table of hashes and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

RANGES = 4096


def words(text: str = "text") -> Column:
    """Words of a text, the default measure of tokens."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(doc_id: str, text: str, seed: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(seed, F.col(doc_id), F.col(text)), F.lit(1 << 52)) / F.lit(float(1 << 52))


@dataclass(frozen=True)
class Temperature:
    alpha: float
    log_z: float  # log of the sum of share ** alpha
    budget: float  # tokens

    def weight(self, share: Column) -> Column:
        return F.exp(self.alpha * F.log(share) - self.log_z)


def temperature(sources: DataFrame, target_entropy: float | None = None, max_epochs: float | None = None, budget: float | None = None) -> Temperature:
    """Alpha and budget for ``sources(source, tokens)``.

    Give either a target entropy (nats; the nearest that alpha between 0 and 8 can give) or a limit on how often any source may be seen
    (1 at least; alpha between 0 and 1).  Without a budget it is the smallest that shows every source once in whole.
    """
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give target_entropy or max_epochs")
    sources = sources.where("tokens > 0")
    total, least, most = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return Temperature(1.0, 0.0, 0.0)
    share = F.log(F.col("tokens") / F.lit(float(total)))

    def sums(alphas):
        row = sources.agg(*(f(F.exp(float(a) * share)).alias(f"{n}{i}") for i, a in enumerate(alphas) for n, f in (("z", F.sum), ("s", lambda x: F.sum(x * share))))).first()
        return np.array([row[f"z{i}"] for i in range(len(alphas))]), np.array([row[f"s{i}"] for i in range(len(alphas))])

    def enough(alphas):
        """Whether alpha is large enough, for each; true from some alpha on."""
        z, s = sums(alphas)
        if target_entropy is not None:
            return np.log(z) - alphas * s / z <= target_entropy
        seen = lambda n: (n / total) ** (alphas - 1) / z  # noqa: E731  epochs of a source of n tokens in a budget of all tokens
        factor = budget / total if budget else 1 / np.minimum(seen(least), seen(most))
        return factor * np.maximum(seen(least), seen(most)) <= max(max_epochs, 1.0) * (1 + 1e-12)

    low, high = 0.0, 8.0 if target_entropy is not None else 1.0
    for _ in range(8):  # each round halves the interval five times over
        alphas = np.linspace(low, high, 33)
        at = int(np.argmax(good)) if (good := enough(alphas)).any() else len(alphas) - 1
        if at == 0:
            high = low
            break
        low, high = alphas[at - 1], alphas[at]
    z, _ = sums([high])
    weights = lambda n: (n / total) ** high / z[0]
    once = max(n / weights(n) for n in (least, most))
    return Temperature(float(high), float(np.log(z[0])), float(budget or once))


def _last_open(sums: DataFrame, at: str, *keep: str) -> DataFrame:
    """Of ``sums(s, at, n, left)`` each source's last place whose predecessors leave something owed, and what they leave."""
    held = sums.withColumn("before", F.sum("n").over(W.partitionBy("s").orderBy(at)) - F.col("n")).where("before < left")
    return held.groupBy("s", *keep).agg(F.max_by(F.col("left") - F.col("before"), at).alias("left"), F.max(at).alias(at))


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", tokens: Column | None = None,
    target_entropy: float | None = None, max_epochs: float | None = 2.0, budget: float | None = None, seed: int = 17,
) -> DataFrame:
    """``docs`` with ``_block`` and ``_place``, a row for each time a document is seen.

    ``_block`` counts a document's repetitions from 0; in the order of ``_place``, in [0, 1), the sources come in their weights throughout.
    A null source counts as the empty one.  Null and empty texts have no tokens; a source without any is shown once.
    Repeated rows have one place, and are shown together or not at all; null ids stay; texts are counted whole, however long.  Columns of any names are
    kept, but for ``_block`` and ``_place``, which are replaced.  An empty table gives an empty result.
    """
    if target_entropy is not None:
        max_epochs = None
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    last = _place(doc_id, text, F.lit(seed))
    counted = cut(docs.select(key.alias("s"), last.alias("u"), (words(text) if tokens is None else tokens).alias("n")), "counted")
    counted = counted.withColumns({"r": F.floor(F.col("u") * RANGES), "part": F.floor(F.col("u") * (RANGES * RANGES)) % RANGES})
    ranges = cut(counted.groupBy("s", "r").agg(F.sum("n").alias("n")), "ranges")
    sources = ranges.groupBy("s").agg(F.sum("n").alias("tokens"))
    found = temperature(sources.select(F.col("s").alias("source"), "tokens"), target_entropy, max_epochs, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    # how often each source is seen, and the tokens its last block owes
    seen = F.when(F.col("tokens") > 0, found.weight(F.col("tokens") / F.lit(float(total))) * F.lit(found.budget) / F.col("tokens")).otherwise(F.lit(1.0))
    plan = sources.withColumn("seen", seen).withColumn("seen", F.when(F.abs(F.col("seen") - F.round("seen")) < 1e-9, F.round("seen")).otherwise(F.col("seen")))
    plan = cut(plan.withColumn("whole", F.floor("seen").cast("int")).select("s", "seen", "whole", ((F.col("seen") - F.col("whole")) * F.col("tokens")).alias("owed")), "plan")
    edge = _last_open(ranges.join(plan.where("owed > 0"), "s").select("s", "r", "n", F.col("owed").alias("left")), "r")
    within = _last_open(counted.join(edge, ["s", "r"]).groupBy("s", "r", "part", "left").agg(F.sum("n").alias("n")), "part", "r")
    # within the part where the block ends: the last place whose predecessors leave something owed
    inside = _last_open(counted.join(within, ["s", "r", "part"]).groupBy("s", "u", "left").agg(F.sum("n").alias("n")), "u").withColumnRenamed("u", "until")
    plan = cut(plan.join(inside.drop("left"), "s", "left").select(F.col("s").alias("_s"), "seen", "whole", F.coalesce("until", F.lit(-1.0)).alias("until")), "plan")
    # the documents' own columns stay in a struct, out of the way of the names used here
    kept = [c for c in docs.columns if c not in ("_block", "_place")]
    shown = docs.select(F.struct(*kept).alias("_row"), key.alias("_key"), last.alias("_last")).join(plan, F.col("_key") == F.col("_s"))
    shown = shown.withColumn("_times", F.col("whole") + (F.col("_last") <= F.col("until")).cast("int")).where("_times > 0")
    shown = shown.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    again = F.pmod(F.xxhash64(F.lit(seed) + 1 + F.col("_block"), F.col(f"_row.{doc_id}"), F.col(f"_row.{text}")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    place = F.when(F.col("_block") < F.col("whole"), again).otherwise(F.col("_last"))
    return shown.select("_row.*", "_block", F.least((F.col("_block") + place) / F.greatest("seen", F.lit(1e-300)), F.lit(1.0 - 2.0**-53)).alias("_place"))


def in_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of ``mix`` in the order of ``_place``, which is dropped with ``_block``: partition by partition, and so file by file where they are written.

    Places are even in [0, 1), so equal intervals of them are partitions of like size, without a look at the data.
    """
    parts = parts or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mixed.repartitionById(parts, F.floor(F.col("_place") * parts).cast("int")).sortWithinPartitions("_place", "_block")
    return dealt.drop("_block", "_place")
