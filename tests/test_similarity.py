"""Title similarity of columns against the definition for one pair."""

import random

from pyspark.sql import functions as F

from staylens.functions import similarity as SI


def test_common_subsequences(monkeypatch):
    """Across words of 64 bits and groups of few pairs."""
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcé日") for _ in range(n))
    sizes = [0, 1, 5, 63, 64, 65, 128, 130, 200]
    a, b = zip(*[(word(rnd.choice(sizes)), word(rnd.choice(sizes))) for _ in range(300)])
    want = [SI._common_subsequence(x, y) for x, y in zip(a, b)]
    assert SI.common_subsequences(list(a), list(b)).tolist() == want
    monkeypatch.setattr(SI, "CELLS", 500)
    assert SI.common_subsequences(list(a), list(b)).tolist() == want
    assert SI.common_subsequences([], []).tolist() == []
    assert SI.common_subsequences(["a" * 130], ["a" * 130]).tolist() == [130]


def test_columns_equal_the_definition(spark):
    rnd = random.Random(2)
    token = ["концерт", "концерты", "джаз", "ночь", "a", "ab", "музей", "\u00a0", "\u2003x", "\x1c", "  ", "show"]
    title = lambda: rnd.choice([None, "", " "]) if rnd.random() < 0.05 else rnd.choice([" ", "\t"]).join(rnd.choice(token) for _ in range(rnd.randint(1, 9)))
    rows = [(i, title(), title()) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    p = F.col("p")
    got = df.select("i", SI.token_parts(F.col("a"), F.col("b")).alias("p"), SI.token_set_ratio_column(F.col("a"), F.col("b")).alias("ratio")).select("i", "ratio", SI.highest_ratio(p).alias("most")).collect()
    want = {i: SI.token_set_ratio(a, b) for i, a, b in rows}
    assert all(abs(r["ratio"] - want[r["i"]]) < 1e-9 and r["most"] >= r["ratio"] - 1e-9 for r in got)
    assert len({round(w) for w in want.values()}) > 20
