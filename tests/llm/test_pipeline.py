"""Every stage of the pipeline against brute force, on rows with nulls, repeats, copies, secrets, toxic and long texts; and empty tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_nearcopies import brute
from tests.llm.test_operators import BASE, brute_mix, words
from tidewalk.llm import queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
STAGE = dict(corpus_pipeline.STAGES)
SECRET = "password: Zq81xKw7Lm02 and token=Abc9Def8Ghi7Jkl6"


def corpus():
    rng = np.random.default_rng(31)
    rows, labels = [], []
    for i in range(120):
        w = [f"w{x}" for x in rng.integers(0, 900, 30)]
        if i % 6 == 0:
            w[10:12] = ["vile", "horrid"]
        rows.append((i, " ".join(w), ("a" if i % 3 else f"b{i % 4}")))
        labels.append((i, 1, int(i % 6 == 0)))
    base = [r for r in rows if r[0] % 6]
    rows += [(200 + n, r[1], "a") for n, r in enumerate(base[:10])]  # exact copies
    rows += [(300 + n, r[1] + f" tail{n}", "b1") for n, r in enumerate(base[5:15])]  # near ones
    rows += [(400 + n, f"{base[20 + n][1]} {SECRET}{n} x {base[21 + n][1]}", "b2") for n in range(4)]
    rows += [(500, " ".join(f"long{x}" for x in rng.integers(0, 10_000, 30_000)), "a"), (501, None, "a"), (502, "", None), (503, " \n", "b1"), (504, "one", "a")]
    rows += [rows[1], rows[1], (None, rows[2][1], "a"), (None, "nobody's text", "a"), (None, "nobody's text", "a"), (None, None, None)]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxic_texts_go(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    kept = STAGE["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert counted(kept) == Counter(tuple(r) for r in docs.collect() if model.score(r.text or "") < 0.5)
    ids = {r.doc_id for r in kept.collect()}
    held_out = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((i in ids) == bool(i % 6) for i in held_out) and {501, 502, 503, None} <= ids


def test_one_of_each_class_stays(spark, docs, folder):
    kept = STAGE["simhash near-dedup"](spark, docs, folder)
    assert kept.columns == docs.columns
    rows = sorted({tuple(r) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    classes = brute([r[1] for r in rows])
    assert counted(kept) == Counter(rows[c] for c in set(classes))


def test_secrets_are_marked(spark, docs, folder):
    kept = STAGE["secret scans"](spark, docs, folder)
    assert kept.columns == docs.columns

    def marked(t):
        if t is None or "password" not in t:
            return t
        spans = sorted((m.start(), m.end()) for k, (_, p) in enumerate(BASE) for m in re.finditer(p, t) if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k])
        for a, b in reversed(spans):
            t = t[:a] + "[SECRET]" + t[b:]
        return t

    want = Counter()
    for r in docs.collect():
        t = marked(r.text)
        want[(r.doc_id, t, r.lang, r.source, r.n_chars if t == r.text else len(t))] += 1
    assert counted(kept) == want and sum("[SECRET]" in (r[1] or "") for r in want) == 4


def test_sources_are_mixed_in_order(spark, docs, folder):
    kept = STAGE["mixing"](spark, docs, folder)
    assert kept.columns == docs.columns
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)
    held = docs.select("*", place.alias("place")).collect()
    want = brute_mix([(tuple(r)[:5], r.source or "", len(words(r.text)), r.place) for r in held], max_epochs=2.0)
    times = Counter()
    for (row, _), n in want.items():
        times[row] += n
    rows = [tuple(r) for r in kept.collect()]
    assert Counter(rows) == times and max(times.values()) > 1
    once = {r for r, n in Counter(tuple(r)[:5] for r in held).items() if n == 1}
    assert all(a != b for a, b in zip(rows, rows[1:]) if a in once)


def test_encoding(spark, docs, folder):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    got = STAGE["sentencepiece"](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == Counter((r.doc_id, r.source, tuple(lib.encode(r.text or ""))) for r in docs.collect())


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    want = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, now, folder).collect())
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == want
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
