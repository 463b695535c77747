"""The paired bootstrap against a direct loop over resamples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import forecasts as C


def test_weights_are_poisson():
    w = C.poisson_weights(np.arange(4000) * 7919, 0, 200).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:40])[np.triu_indices(40, 1)]).max() < 0.35
    assert (C.poisson_weights(np.arange(50), 30, 60) == C.poisson_weights(np.arange(50), 0, 100)[:, 30:60]).all()


@pytest.mark.parametrize("rounds", [300, 2500])
def test_equals_direct_loop(spark, monkeypatch, rounds):
    """Also for repeated rows, null differences, null keys, and many keys that leave a task early."""
    monkeypatch.setattr(C, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(C, "KEYS_HELD", 3)
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, 3, 4, 5, None]), i % 9, rnd.gauss(0, 1), rnd.gauss(0, 1.1)) for i in range(150)]
    rows += [rows[0]] * 12 + [(2, 0, None, 1.0), (7, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "h int, o int, m double, n double").repartition(4)
    got = {r["h"]: (r["p_naive_not_worse"], r["rounds"]) for r in C.paired_bootstrap(df, ["h"], "m", "n", rounds, seed=3).collect()}
    numbered = df.groupBy(*df.columns).agg(F.count("*").alias("c")).withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))))
    ids = numbered.select("h", "m", "n", F.xxhash64(F.lit(3), "h", "o", "m", "n", "j").alias("id")).collect()
    assert len({r["id"] for r in ids}) == len(rows)
    want = {}
    for key in {r[0] for r in rows} - {7}:
        own = [r for r in ids if r["h"] == key and r["m"] is not None]
        sums = [sum((abs(r["m"]) - abs(r["n"])) * int(w) for r, w in zip(own, C.poisson_weights(np.array([r["id"] for r in own]), k, k + 1)[:, 0])) for k in range(rounds)]
        want[key] = (sum(s >= 0 for s in sums) / rounds, rounds)
    assert got == want


def test_no_row_per_resample(spark):
    df = spark.createDataFrame([(1, 0.5, 0.4)], "h int, m double, n double")
    plan = C.paired_bootstrap(df, ["h"], "m", "n")._jdf.queryExecution().executedPlan().toString()
    assert "10000" not in plan and plan.count("Generate") <= 2
    assert C.paired_bootstrap(df.limit(0), ["h"], "m", "n").collect() == []
