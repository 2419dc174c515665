"""The pipeline's near-dedup against brute force over all pairs."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidewalk.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_texts():
    rng = np.random.default_rng(11)
    texts = []
    for n in (60, 200, 400):
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        for _ in range(8):
            texts.append(" ".join(words))
            words = list(words)
            for at in rng.integers(0, n, max(1, n // 60)):
                words[at] = f"x{rng.integers(0, 10**6)}"
    return texts + [" ".join(f"y{x}" for x in rng.integers(0, 5000, 80)) for _ in range(10)] + [None, "", " \n", "one two", "ONE  two", "one three"]


def brute(texts):
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and of[i] != of[j]:
                of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
    return of


@pytest.mark.parametrize("how", [{}, {"few": 2, "block": 3}, {"few": 2, "most": 500}])
def test_one_of_each_class(spark, how):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = simhash.deduplicate(df, **how)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))
    assert nearcopies.deduplicate(df.where("false")).count() == 0


def test_stage_takes_near_copies_wider_than_three_bits(spark):
    texts = near_texts()[8:24]
    far = [(a, b) for a in texts for b in texts if a < b and len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))]
    far = [(a, b) for a, b in far if (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 3]
    assert far
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(far[0])], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()] == [0]


def test_a_row_is_known_by_id_and_text(spark):
    a, b, c = near_texts()[0], near_texts()[8], near_texts()[30]
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (1, a)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert Counter((r.doc_id, r.text) for r in nearcopies.deduplicate(df).collect()) == Counter([(1, a), (1, b), (None, c)])
