"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from staylens.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score string, id string, weight string"  # the last three clash with columns the operator adds


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) for f in words + [" ".join(p) for p in zip(words, words[1:])]]


def brute(rows, target, percent=25, least=20, buckets=10000):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(h % buckets for _, _, f in found for h in f), Counter(h % buckets for x in target for h in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for id, n, f in found:
        weight = sum(gain(h % buckets) for h in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        out.append([id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = rank + 1
    return out


def texts(seed=3, n=80):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abAB0é日") for _ in range(r.choice([1, 3, 7, 8, 9, 16, 17, 25]))) for _ in range(200)]
    out = [(i * 2, r.choice([" ", "-", "  ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(n)]
    out += [(900, None), (901, ""), (902, " -- "), (903, "x" * 3000 + " " + "y" * 256 + " a" * 30), (904, "a " * 5000), (None, vocabulary[0] * 3 + " b" * 25), (-4, "z " * 40)]
    return out + [out[5], out[5], out[6], (None, vocabulary[0] * 3 + " b" * 25)]


@pytest.mark.parametrize("slice_words", [1 << 18, 37])
def test_features(monkeypatch, slice_words):
    """Every slice length gives the features of every text, with repeats."""
    monkeypatch.setattr(importance, "SLICE", slice_words)
    rows, got, words = texts(), Counter(), 0
    for counted, bucket, owner in importance.features(pa.array([t for _, t in rows], pa.string()), 10000):
        words += counted
        got.update(zip(owner.tolist(), bucket.tolist()))
    assert got == Counter((i, h % 10000) for i, (_, t) in enumerate(rows) for h in features(t)[1])
    assert words.tolist() == [features(t)[0] for _, t in rows]


def test_crc_of_long_and_short_ranges():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 2000).astype(np.uint8)
    length = np.concatenate([r.integers(0, 20, (50, 2)), r.integers(200, 400, (5, 2))])
    start = r.integers(0, 1500, (55, 2))
    want = [zlib.crc32(b"".join(data[s : s + n].tobytes() for s, n in zip(*x))) for x in zip(start, length)]
    assert importance.matrix_crcs(data, start, length).tolist() == want


def test_draw(spark):
    rows, target = texts(), ["a b zz", None, "", "z z z", texts(4)[3][1]]
    docs = spark.createDataFrame([(i, t, "own", "own", "own") for i, t in rows], SCHEMA).repartition(3)
    found = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got, want = [tuple(r) for r in found.collect()], [tuple(r) for r in brute(rows, target)]
    assert Counter(got) == Counter(want)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 1 + 25 * sum(r[1] >= 20 for r in got) // 100))


def test_many_equal_scores(spark):
    """A third of the rows have one id and one text: their ranks are gapless all the same."""
    rows = [(1, "a " * 30)] * 400 + [(i, f"b{i} " * 30) for i in range(2, 800)]
    found = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame([("a a",)], "text string"), percent=100)
    assert Counter(tuple(r) for r in found.collect()) == Counter(tuple(r) for r in brute(rows, ["a a"], percent=100))


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert importance.resampled(none, docs).collect() == []
    got = importance.resampled(docs, none, percent=50).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in brute([(1, "a " * 30), (2, "b " * 30)], [], percent=50))
