"""Vector search: exact search in slices and blocks, and the recall of the hashed index."""

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from staylens.operators import search as Q


def brute(docs, queries, k):
    ids, matrix = [i for i, _ in docs], np.array([v for _, v in docs], np.float64)
    out = {}
    for q, v in queries:
        v = np.array(v, np.float64)
        d = 1 - matrix @ v / np.maximum(np.linalg.norm(matrix, axis=1) * np.linalg.norm(v), 1e-300)
        out[q] = [i for _, i in sorted(zip(np.round(d, 9), ids))[:k]]
    return out


def listed(found):
    rows = sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"]))
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(r[1])
    return out


def made(seed=3, n=700, m=40):
    rng = np.random.default_rng(seed)
    docs = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 6)))]
    docs += [(n + i, docs[i][1]) for i in range(20)] + [(n + 50, [0.0] * 6)]
    return docs, [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(m, 6)))]


SCHEMA = "id long, embedding array<double>"


@pytest.mark.parametrize("slice_bytes", [1 << 24, 1000])
def test_exact_search(spark, monkeypatch, slice_bytes):
    """In one slice of queries and in many, equal to sorting all distances; equal vectors by id."""
    monkeypatch.setattr(Q, "DOCUMENT_BLOCK", 64)
    monkeypatch.setattr(Q, "QUERY_BLOCK", 7)
    docs, queries = made()
    found = Q.top_k(spark.createDataFrame(docs + [(5000, None)], SCHEMA).repartition(3), spark.createDataFrame(queries + [(900, None)], "query_id long, embedding array<double>"), 9, slice_bytes=slice_bytes)
    assert listed(found) == brute(docs, queries, 9)


def test_documents_are_not_shuffled(spark):
    """The plan moves best rows only: no exchange lies between the documents and their scores."""
    docs, queries = made()
    d = spark.createDataFrame(docs, SCHEMA)
    plan = Q.top_k(d, spark.createDataFrame(queries, "query_id long, embedding array<double>"), 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange hashpartitioning" in plan and "hashpartitioning" not in below


def test_empty_sides(spark):
    docs, queries = made()
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "query_id long, embedding array<double>")
    assert Q.top_k(d, none, 3).collect() == []
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    assert Q.top_k(d.limit(0), q, 3).collect() == []
    assert Q.hashed_top_k(Q.hashed_index(d.limit(0), 4), q, 3, 4, 16).collect() == []


def test_all_buckets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(Q, "DOCUMENT_BLOCK", 20)
    monkeypatch.setattr(Q, "QUERY_BLOCK", 11)
    docs, queries = made()
    index = Q.hashed_index(spark.createDataFrame(docs, SCHEMA).repartition(3), 5)
    found = Q.hashed_top_k(index, spark.createDataFrame(queries, "query_id long, embedding array<double>"), 6, 5, 32)
    assert listed(found) == brute(docs, queries, 6)


def recall(spark, rows, bits, probes, every):
    v = spark.createDataFrame(rows, SCHEMA)
    asked = [(i, e) for i, e in rows if i % every == 0]
    got = listed(Q.hashed_top_k(Q.hashed_index(v, bits), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 10, bits, probes))
    want = brute(rows, asked, 10)
    return sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))


def test_recall_of_the_index(spark):
    """At the setting of the registered query; the vectors of the tables have no clusters, so most buckets must be probed."""
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert recall(spark, rows, 8, 216, 10) >= 0.9


def test_recall_on_clusters(spark):
    """Vectors that have clusters are found by a sixteenth of the buckets."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(30, 32))
    rows = [(i, [float(x) for x in centre[i % 30] + 0.15 * rng.normal(size=32)]) for i in range(1500)]
    assert recall(spark, rows, 8, 16, 25) >= 0.9


def test_index_holds_term_weights(spark, tmp_path):
    """Vectors are the hashed term counts times the rarity of their places, of unit length; a rebuild clears what is gone."""
    texts = ["red house by the lake", "red red boat", "", "lake view house", "the boat"]
    docs = spark.createDataFrame([(f"d{i}", x, {"source": "a" if i % 2 else "b"}) for i, x in enumerate(texts)], "id string, text string, metadata map<string,string>")
    index = Q.stored_index(docs, str(tmp_path / "index"), 32)
    place = HashingTF(numFeatures=32).indexOf
    counts = np.zeros((len(texts), 32))
    for i, x in enumerate(texts):
        for w in x.lower().split(" "):
            counts[i, place(w)] += 1
    weight = counts * np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1))
    want = weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-300)
    got = {r["id"]: r for r in index.collect()}
    for i in range(len(texts)):
        assert np.allclose(got[f"d{i}"]["embedding"], want[i], atol=1e-6) and got[f"d{i}"]["metadata"] == {"source": "a" if i % 2 else "b"}
    again = Q.stored_index(docs.filter("id <> 'd1'"), str(tmp_path / "index"), 32)
    assert sorted(r["id"] for r in again.collect()) == ["d0", "d2", "d3", "d4"]
