"""Pair finding against brute force."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.functions.similarity import token_set_ratio
from staylens.operators import matching as G
from staylens.operators import search as Q


def test_fuzzy_pairs_equal_all_pairs(spark):
    rnd = random.Random(5)
    words = ["концерт", "концерты", "маштаков", "маштакова", "выставка", "фото", "джаз", "ночь", "а", "по", "театр", "театра", "зал", "залы", "хор"]
    titles = sorted({" ".join(rnd.sample(words, rnd.randint(1, 4))) for _ in range(140)} | {"аб", "абв", "ночь джаза", "ночь джаз"})
    df = spark.createDataFrame([("d1", t) for t in titles] + [("d2", t) for t in titles[:20]], "day string, title_key string")
    got = {(r["day"], r["a"], r["b"]) for r in G.fuzzy_pairs(df, ["day"]).collect()}
    want = {(d, a, b) for d, part in (("d1", titles), ("d2", titles[:20])) for a, b in itertools.combinations(sorted(part), 2) if token_set_ratio(a, b) > 88}
    assert got == want and len(want) > 100


def test_connected_groups(spark):
    chain = [("k", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("k", "x1", "x2"), ("j", "n000", "n001")]
    got = {(r["day"], r["node"]): r["label"] for r in G.connected_groups(spark.createDataFrame(chain, "day string, a string, b string"), ["day"]).collect()}
    assert {got[("k", f"n{i:03d}")] for i in range(61)} == {"n000"}
    assert got[("k", "x2")] == "x1" and len([k for k in got if k[0] == "j"]) == 2


def km(a, b):
    la, lo, lb, lp = map(np.radians, (a[1], a[2], b[1], b[2]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(h))


def test_one_to_one_matching(spark):
    rnd = random.Random(3)
    left = [(f"l{i}", 52 + rnd.random() / 50, 104 + rnd.random() / 50) for i in range(80)] + [(f"h{i}", 53.0, 105.0) for i in range(40)]
    right = [(f"r{i}", 52 + rnd.random() / 50, 104 + rnd.random() / 50) for i in range(80)] + [(f"g{i}", 53.0, 105.0) for i in range(25)]
    schema = "id string, lat double, lon double"
    pairs = [(r["l"], r["r"]) for r in G.match_one_to_one(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.3).collect()]
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    at = {x[0]: x for x in left + right}
    dist = {p: km(at[p[0]], at[p[1]]) for p in pairs}
    assert max(dist.values()) < 0.3
    best_l, best_r = {a: d for (a, _), d in dist.items()}, {b: d for (_, b), d in dist.items()}
    for a in left:
        for b in right:
            d = km(a, b)
            if d < 0.3:  # no pair could improve both sides
                assert not (d < best_l.get(a[0], 9) - 1e-9 and d < best_r.get(b[0], 9) - 1e-9)
    assert sum(1 for a, _ in pairs if a.startswith("h")) == 25


def test_top_k_equals_sorting(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    queries = [(j, [float(v) for v in rng.normal(size=8)]) for j in range(3)]
    d = spark.createDataFrame(docs, "id long, embedding array<float>").repartition(5)
    got = Q.top_k(d, spark.createDataFrame(queries, "query_id long, embedding array<float>"), 7)
    for q, v in queries:
        v = np.float32(v).astype(float)
        sims = [(1 - np.dot(np.float32(e).astype(float), v) / np.linalg.norm(np.float32(e).astype(float)) / np.linalg.norm(v), i) for i, e in docs]
        assert [r["id"] for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == [i for _, i in sorted(sims)[:7]]


def test_top_k_takes_any_number_of_queries(spark):
    q = spark.range(1001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    d = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1001)], "id long, embedding array<double>")
    got = {r["query_id"]: r["id"] for r in Q.top_k(d, q, 1).collect()}
    assert got == {i: i for i in range(1001)}


def test_long_chain_of_shrinking_distances(spark):
    """Every round settles one pair only: more rounds than frames are kept apart."""
    step, at, left, right = 0.0004, 52.0, [], []
    for i in range(26):
        left.append((f"l{i:02d}", at, 104.0))
        right.append((f"r{i:02d}", at + step * 0.999 ** (2 * i), 104.0))
        at += step * (0.999 ** (2 * i) + 0.999 ** (2 * i + 1))
    schema = "id string, lat double, lon double"
    pairs = G.match_one_to_one(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.3)
    got = {(r["l"], r["r"]) for r in pairs.collect()}
    assert len(got) >= 25 and len({a for a, _ in got}) == len(got) == len({b for _, b in got})


def greedy(left, right, radius):
    """One-to-one pairs by rising distance; coordinates without ties."""
    pairs = sorted((d, i, j) for i, a in enumerate(left) for j, d in enumerate(km_to(a, right)) if d < radius)
    used_l, used_r, out = set(), set(), {}
    for _, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out[left[i][0]] = right[j][0]
    return out


def km_to(a, others):
    lat, lon = np.radians([o[1] for o in others]), np.radians([o[2] for o in others])
    h = np.sin((lat - np.radians(a[1])) / 2) ** 2 + np.cos(lat) * np.cos(np.radians(a[1])) * np.sin((lon - np.radians(a[2])) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(h))


SPOT = "id string, lat double, lon double"


@pytest.mark.parametrize("small, listed", [(20_000, 16), (60, 4)])
def test_matching_equals_greedy(spark, monkeypatch, small, listed):
    """Mutual nearest rounds give the pairs that a sweep by distance gives: through small leaves, and by
    distributed rounds over short lists that are used up."""
    monkeypatch.setattr(G, "SMALL", small)
    monkeypatch.setattr(G.nearest_places, "__defaults__", (listed,))
    monkeypatch.setattr(G, "LEAF", 10)
    monkeypatch.setattr(G, "FAN", 4)
    rnd = random.Random(11)
    left = [(f"l{i:03d}", 52 + rnd.random() ** 3 / 100, 104 + rnd.random() ** 3 / 100) for i in range(90)]
    right = [(f"r{i:03d}", 52.002 + rnd.random() / 500, 104 + rnd.random() / 90) for i in range(70)]
    got = {r["l"]: r["r"] for r in G.match_one_to_one(spark.createDataFrame(left, SPOT).repartition(3), spark.createDataFrame(right, SPOT), 0.4).collect()}
    want = greedy(left, right, 0.4)
    assert got == want and len(got) > 40


def test_nearest_places_equal_all_distances(spark, monkeypatch):
    monkeypatch.setattr(G, "LEAF", 10)
    monkeypatch.setattr(G, "FAN", 4)
    rnd = random.Random(12)
    spot = lambda s, n: [(f"{s}{i:03d}", f"{s}{i:03d}", rnd.choice([52.0, -0.001, 51.99]) + rnd.random() / 300, rnd.choice([104.0, 104.02]) + rnd.random() / 200) for i in range(n)]
    left, right = spot("l", 160), spot("r", 140)
    frame = lambda x: spark.createDataFrame(x, "place string, first string, lat double, lon double")
    got = {(r["side"], r["own"], r["other"]) for r in G.nearest_places(frame(left), frame(right), 0.5, 4).collect()}
    want = set()
    for side, own, other in (("l", left, right), ("r", right, left)):
        for a in own:
            near = sorted((d, o[0]) for d, o in zip(km_to(a[1:], [o[1:] for o in other]), other) if d < 0.5)
            want |= {(side, a[0], o) for _, o in near[:4]}
    assert got == want


def test_matching_of_a_crowded_block(spark):
    """Many rows in one city block, a fifth of them on one spot: all that can be matched is, each row once. STAYLENS_ALL takes 100,000."""
    n = 50_000 if os.environ.get("STAYLENS_ALL") else 2_000
    spots = lambda s, n, hot: spark.range(n, numPartitions=8).select(
        F.concat(F.lit(s), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 5 == hot, 52.001).otherwise(52 + F.rand(hot) / 700).alias("lat"), F.when(F.col("id") % 5 == hot, 104.001).otherwise(104 + F.rand(hot + 7) / 500).alias("lon"))
    pairs = G.match_one_to_one(spots("l", n, 1), spots("r", n, 2), 0.3).toPandas()
    assert len(pairs) == n == pairs["l"].nunique() == pairs["r"].nunique()
    assert pairs["km"].max() < 0.3


def test_matching_without_partners(spark):
    none, one = spark.createDataFrame([], SPOT), spark.createDataFrame([("a", 52.0, 104.0), ("b", None, 104.0), ("c", 0.0, 0.0)], SPOT)
    assert G.match_one_to_one(none, one).collect() == [] == G.match_one_to_one(one, none).collect()
    assert [tuple(r) for r in G.match_one_to_one(one, one).collect()] == [("a", "a", 0.0)]


def test_pairs_within_measures_equal_coordinates_once(spark, monkeypatch):
    """More rows at one place than a sheet holds, ids that are null or repeated, and places that are not known: every pair is there."""
    monkeypatch.setattr(G, "SHEET", 3)
    schema = "id string, lat double, lon double"
    left = [(f"l{i}", 52.0, 104.0) for i in range(7)] + [(None, 52.0, 104.0), ("l0", 52.0, 104.0), ("far", 53.0, 104.0), ("none", None, 104.0)]
    right = [(f"r{i}", 52.01, 104.0) for i in range(5)] + [("r0", 52.01, 104.0), ("none", None, None)]
    a, b = (spark.createDataFrame(rows, schema) for rows in (left, right))
    found = G.pairs_within(a, b, 5.0)
    assert sorted((r.l or "", r.r) for r in found.collect()) == sorted((x or "", y) for x, lat, _ in left if lat == 52.0 for y, at, _ in right if at)
    sheets = G._sheets(a, "l").collect()
    assert max(len(s.ls) for s in sheets) == 3 and len(sheets) == 4
