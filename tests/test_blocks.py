"""Keys that hold most of the rows: sorted blocks against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import blocks as B
from staylens.operators import forecasts as C
from staylens.operators import timeseries as T


def test_numbered(spark):
    r = random.Random(1)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None]), r.randint(0, 50), i) for i in range(3000)]
    got = B.numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(5), ["k"], ["v", "i"], "n", count=7).collect()
    for key in ("hot", "a", "b", None):
        want = sorted((v, i) for k, v, i in rows if k == key)
        assert [(x["v"], x["i"]) for x in sorted((x for x in got if x["k"] == key), key=lambda x: x["n"])] == want
        assert sorted(x["n"] for x in got if x["k"] == key) == list(range(len(want)))
    assert B.numbered(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], "n").count() == 0


def test_peak_concurrency_of_a_hot_key(spark):
    """Half of all spans belong to one key: its instants lie in many blocks, and the peak is that of a plain sweep."""
    r = random.Random(2)
    spans = [("hot" if i % 2 else r.choice("abc"), s, s + r.choice([0, 1, 5, 400])) for i in range(4000) for s in [r.randint(0, 3000)]]
    spans += [(None, 1, 5), (None, 2, 3), ("late", 10, None)]
    df = spark.createDataFrame(spans, "k string, s int, e int").repartition(4)
    want = {}
    for key in {k for k, _, _ in spans}:
        moves, now, best = {}, 0, None
        for k, s, e in spans:
            if k == key:
                moves[s if s is not None else -1] = moves.get(s if s is not None else -1, 0) + 1
                moves[e if e is not None else -1] = moves.get(e if e is not None else -1, 0) - 1
        for at in sorted(moves):
            now += moves[at]
            best = now if best is None else max(best, now)
        want[key] = best
    assert {x["k"]: x["peak"] for x in T.peak_concurrency(df, "k", "s", "e").collect()} == want
    blocks = T.concurrency_blocks(df, "k", "s", "e", count=16).where("k = 'hot'").count()
    assert blocks >= 6


@pytest.mark.parametrize("size", [1, 2, 7, 4001])
def test_nearest_rank_of_all_rows(spark, size):
    r = np.random.default_rng(size)
    v, w = r.integers(0, 50, size).astype(float), r.normal(size=size)
    rows = [(float(a), float(b)) for a, b in zip(v, w)] + [(None, None)]
    got = C.nearest_rank(spark.createDataFrame(rows, "v double, w double").repartition(3), [], ["v", "w"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    for name, column in (("v", v), ("w", w)):
        for p in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert got[f"{name}_p{int(p * 100)}"] == np.sort(column)[round(p * (size - 1))]


def test_nearest_rank_of_a_million_values(spark):
    """Equal to sorting, a key with a third of the rows among them; no window runs over a constant key."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    pdf = df.toPandas()
    rank = lambda x, p: np.sort(x)[round(p * (len(x) - 1))]
    got = C.nearest_rank(df, [], ["v"], [0.25, 0.9]).first()
    assert (got["v_p25"], got["v_p90"]) == (rank(pdf["v"], 0.25), rank(pdf["v"], 0.9))
    got = {x["k"]: x["v_p50"] for x in C.nearest_rank(df, ["k"], ["v"], [0.5]).collect()}
    assert got == {k: rank(x["v"], 0.5) for k, x in pdf.groupby("k")}


def test_nearest_rank_without_rows(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert C.nearest_rank(none, [], ["v"], [0.5]).collect()[0]["v_p50"] is None
    assert C.nearest_rank(none, ["k"], ["v"], [0.5]).collect() == []
