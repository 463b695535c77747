"""The pipeline and the registered queries on small tables."""

import public_tokenizers

import __spark_entry__ as entrypoint
import corpus_pipeline
from staylens.llm.queries import QUERIES


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, before = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {i for i, q in labels.items() if q}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        assert docs.columns[: len(want)] == want and (k == 4 or docs.columns == want)
        assert docs.count() <= before
        if k == 0:
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(clean & kept) >= 0.95 * len(clean)
    assert docs.where("n_tokens * 4 != octet_length(ids)").count() == 0


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i % 37}{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text[::-1], None, "s", 5)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == ([(False, 1), (True, None)] if table else [])


CLASHING = ["own", "every", "__lang", "n_words", "kept", "base_failed", "n_tokens", "entropy", "__row", "__bundle", "__rest", "__n", "__id", "__text", "i", "h", "row", "n", "group", "items", "spans", "n_hit", "n_lines", "n_removed", "bundle"]


def test_clashing_columns_keep_their_values(spark, sf_dir):
    """Extra columns of 25 names that stages use themselves come out as they went in."""
    rows = [(i, " ".join(f"word{i}x{j * j % 97}" for j in range(60)), "en", "s", 1, *[f"{c}{i}" for c in CLASHING]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    want = sorted(r[5:] for r in rows)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        assert sorted(tuple(r)[5:] for r in docs.collect()) == want


def test_close_fingerprints_are_checked(spark, sf_dir, monkeypatch):
    """Pairs that only SimHash proposes are checked by their shingles: the near copy goes, a text that is close by its fingerprint alone stays."""
    near_copies = corpus_pipeline.near_copies
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("w", 400)), (2, words("x", 400)), (3, words("y", 400)), (4, words("y", 399))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, -8)], "i long, fingerprint long")
    monkeypatch.setattr(near_copies.simhash, "fingerprints", lambda docs, text, shingle: docs.drop(text).join(found, "i"))
    monkeypatch.setattr(near_copies, "candidates", lambda nodes, similarity: spark.createDataFrame([], "a bigint, b bigint, alike int"))
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entrypoint.queries())
    assert public_tokenizers.PATTERN
