"""The language model: every gram is held, scores equal a brute-force model's, broadcast or not."""

import math
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np

from tidewalk.llm import language_model

WORDS = "the of and stone river paper green light under over".split()


def quantised(c):
    return float(language_model.expected(language_model.level(np.array([c])))[0]) if c else 0.0


def brute(rows, a=400.0, b=10.0):
    """{row: (n_tokens, base_score, score)} with exact counts, quantised as the filter's."""
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [w for w in (t or "").lower().split()] + [""]) for i, t in rows]
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for _, held, t in tokens:
        if not held:
            texts += 1
            one.update(t)
            two.update(zip([None, *t], t))
            three.update(zip([None, *t], t, t[1:]))
    n, v = sum(one.values()), len(one)
    out = []
    for i, _, t in tokens:
        total = 0.0
        for k, w in enumerate(t):
            before = t[k - 1] if k else None
            word, context = quantised(one[w]), quantised(one[before] if k else texts)
            pair = min(quantised(two[before, w]), context, word)
            p = (pair + a * (word + 1) / (n + v + 1)) / (context + a)
            if k:
                first = t[k - 2] if k > 1 else None
                wide = min(quantised(two[first, before]), quantised(one[first] if k > 1 else texts), quantised(one[before]))
                p = (min(quantised(three[first, before, w]), wide, pair) + b * p) / (wide + b)
            total += math.log10(p)
        out.append((i, len(t), round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), 6), round(total, 6)))
    return Counter(out)


def small_corpus():
    rng = np.random.default_rng(21)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 50)))) for i in range(120)] + [(200, " ".join(f"w{x}" for x in rng.integers(0, 3000, 20_000)))]
    return rows + [(3, rows[3][1]), (3, rows[3][1]), (None, "The Stone"), (None, None), (None, None), (300, None), (301, " \n"), (302, "one")]


def test_scores_equal_brute_force(spark):
    rows = small_corpus()
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, n long, chunk string, range binary").repartition(3)
    for how in ({}, {"most_bytes": 0}, {"range_bits": 2, "most_bytes": 0, "chunk_bytes": 5000}):
        got = language_model.evaluate(df, probes=28, **how).collect()
        assert Counter((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == brute(rows)


def test_a_filter_beyond_the_broadcast_answers_the_same(spark):
    df = spark.createDataFrame(small_corpus(), "doc_id long, text string")
    one, two = (sorted((r.doc_id or -1, r.score) for r in language_model.evaluate(df, most_bytes=m).collect()) for m in (1 << 28, 0))
    assert one == two


def test_every_training_gram_is_held(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(400)]
    ranges = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    rows = ranges.where("bits is not null").select("range", "room", "bits")
    model = language_model.collected(rows, sum(len(r.bits) for r in rows.collect()), 3, 4)
    t = language_model.Tokens.of([x.encode() for x in texts])
    pairs, triples, inner = t.keys()
    for keys in (pairs, triples[inner], language_model.word_keys(t.h[t.at])):
        distinct, n = np.unique(keys, return_counts=True)
        got, want = model.levels(distinct), language_model.level(n)
        assert (got >= want).all() and (got == want).mean() > 0.85
    assert all(np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8)).mean() <= 0.51 for r in rows.collect())
    assert ranges.agg({"n": "sum", "v": "sum"}).first()[0:] in ((t.at.size, len(t.words)), (len(t.words), t.at.size))


def test_copies_score_above_single_texts(spark):
    rng = np.random.default_rng(15)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 50)) for _ in range(300)]
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = list(zip(ids, [*texts, *texts[:60]]))
    got = {r.doc_id: r.score / r.n_tokens for r in language_model.evaluate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = np.array([got[i] for i in ids[60:300]])
    twice = np.array([got[i] for i in ids[:60]])
    assert (twice > np.quantile(once, 0.9)).mean() > 0.9


def test_workers_map_the_broadcast_filter_and_hold_no_copy(spark):
    bits = np.random.default_rng(31).integers(0, 256, 5_000_000, dtype=np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    rows = spark.sparkContext.parallelize(range(2), 2).map(lambda _: (language_model.mapped(sent, len(bits)), "_value" in sent.__dict__)).collect()
    assert all((got == bits).all() and not copied for got, copied in rows)
    other = spark.sparkContext.broadcast(b"no run of that size")
    assert spark.sparkContext.parallelize([0], 1).map(lambda _: language_model.mapped(other, 5)).collect() == [b"no run of that size"]


def test_counting_leaves_little_memory_held():
    """What a worker still holds after some 60 MB of texts were counted: it stays beside the filter and the JVM."""
    ended = subprocess.run([sys.executable, "-c", _COUNT], capture_output=True, text=True, timeout=300)
    assert ended.returncode == 0, ended.stderr
    assert float(ended.stdout) < 150


_COUNT = """
import re
import numpy as np, pyarrow as pa
from tidewalk.llm import language_model

class Rows:
    def select(self, *_):
        return self
    def mapInArrow(self, run, _):
        return run

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = np.random.default_rng(5)
    for _ in range(6):
        words = np.char.add("word", np.minimum(rng.zipf(1.2, 1_300_000), 2_000_000).astype(str))
        yield pa.record_batch([pa.array([" ".join(words[k : k + 260]) for k in range(0, len(words), 260)])], ["text"])

before = held()
for b in language_model._counted(Rows(), 7)(batches()):
    del b
print(held() - before)
"""


def test_tokens_are_the_words():
    rng = np.random.default_rng(24)
    signs = [b"a", b"B", b"\x00", "é".encode(), b" ", b"\t", b"\r\n", b"\x0b", b"\x0c", b"long", "\u3000".encode()]
    texts = [b"", b" ", b"one", b"Two one", b"x" * 3_000_000 + b" y"] + [b"".join(rng.choice(np.array(signs, dtype=object), rng.integers(0, 30))) for _ in range(300)]
    for some in (texts, texts[:1], texts[:2], texts[2:4]):
        t = language_model.Tokens.of(some)
        ends = [*t.starts[1:].tolist(), len(t.at)]
        assert [[t.words[i] for i in t.at[a:b].tolist()] for a, b in zip(t.starts.tolist(), ends)] == [[*x.lower().split(), b""] for x in some]
        assert len(set(t.words)) == len(t.words) and (np.diff(t.h.astype(object)) > 0).all()
    both = language_model.Tokens.of(texts[:4]), language_model.Tokens.of(texts[3:1:-1])
    assert {w: h for w, h in zip(both[1].words, both[1].h)}.items() <= {w: h for w, h in zip(both[0].words, both[0].h)}.items()


def test_packing():
    rng = np.random.default_rng(13)
    suffix = np.unique(rng.integers(0, 2**32, 5000, dtype=np.uint32))
    assert (language_model._unpacked(language_model._packed(suffix)) == suffix).all()
    assert (np.abs(language_model.expected(language_model.level(np.arange(1, 200))) / np.arange(1, 200) - 1) < 0.25).all()


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.evaluate(empty).count() == language_model.evaluate(empty, most_bytes=-1).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = language_model.evaluate(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == 0.0
