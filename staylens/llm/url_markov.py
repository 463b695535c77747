"""URL filter: rules first, then a ratio of two character language models.

Rules name a host and a path prefix; the longest rule that fits decides. For all other urls, two variable-order Markov
models, one of accepted and one of rejected urls, give the log-likelihood of each character after its longest known context; the
difference per character is compared with a threshold. Models are counts of all labelled urls (here: those that a rule decides):
each order interpolates with the next shorter one by Witten-Bell weights, down to an even distribution, so unseen contexts
fall back. The threshold is calibrated on a held-out tenth of the labelled urls: the midpoint between scores that maximises the
mean of both classes' accuracy.

Characters fold into 32 symbols, and contexts are at most `ORDER` symbols, so a model has at most 32**(ORDER+1) counts
however many urls there are: it is summed by Spark from the counts of each task, and only the sums reach the driver and, as tables,
the tasks. The score histogram of the calibration is bounded as well.

A null url, or one without "://", has an empty host and path, fits no rule and is judged by what characters it has; an empty one scores
zero. With labels of one class only, all urls get that class; with none, all are allowed. Equal urls get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C

ORDER, ALPHABET, STEP = 3, 32, 0.02
FOLD = np.full(256, 31, np.uint8)
FOLD[0x61:0x7B] = np.arange(26)
FOLD[0x41:0x5B] = np.arange(26)
FOLD[0x30:0x3A] = 26
FOLD[ord("/")] = 27
FOLD[ord(".")] = 28
FOLD[[ord("-"), ord("_")]] = 29
FOLD[list(b"?&=#%+")] = 30


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Longest rule that fits: its host or a subdomain, and the path's beginning."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the urls without their scheme, and offsets."""
    short = [u.split("://", 1)[-1] if u else "" for u in column.to_pylist()]
    data, offsets = C.flat(pa.array(short, pa.string()))
    return FOLD[data].astype(np.int64), offsets


def grams(symbols: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Code of each symbol behind its last `order` symbols; contexts begin with the url, -1 where it is shorter."""
    code = symbols.copy()
    at = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        before = np.zeros_like(symbols)
        before[k:] = symbols[:-k]
        code += before << (5 * k)
    code[at < order] = -1
    return code


def counts(labelled: DataFrame) -> DataFrame:
    """Frame (accepted, depth, code, n) of all labelled urls; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros(ALPHABET ** (k + 1), np.int64) for k in range(ORDER + 1)] for _ in range(2)]
        for batch in batches:
            symbols, offsets = folded(batch.column("url"))
            label = np.repeat(np.array(batch.column("accepted").to_pylist(), bool), np.diff(offsets))
            for k in range(ORDER + 1):
                code = grams(symbols, offsets, k)
                for side in range(2):
                    total[side][k] += np.bincount(code[(label == side) & (code >= 0)], minlength=ALPHABET ** (k + 1))
        for side in range(2):
            for k in range(ORDER + 1):
                code = np.flatnonzero(total[side][k])
                yield pa.RecordBatch.from_pydict({"accepted": pa.array([bool(side)] * len(code), pa.bool_()), "depth": pa.array([k] * len(code), pa.int32()), "code": pa.array(code), "n": pa.array(total[side][k][code])})

    partial = labelled.select("url", "accepted").mapInArrow(run, "accepted boolean, depth int, code bigint, n bigint")
    return partial.groupBy("accepted", "depth", "code").agg(F.sum("n").alias("n"))


def tables(counted: DataFrame) -> list[list[np.ndarray]]:
    """Log-probabilities for each class and depth. At most 2 * 32**(ORDER+1) * 32/31 rows are read."""
    total = [[np.zeros(ALPHABET ** (k + 1)) for k in range(ORDER + 1)] for _ in range(2)]
    found = counted.toArrow()
    side, depth, code, n = (found.column(c).to_numpy() for c in ("accepted", "depth", "code", "n"))
    out = []
    for s in range(2):
        below, logs = np.full(1, 1 / ALPHABET), []
        for k in range(ORDER + 1):
            own = (side == s) & (depth == k)
            total[s][k][code[own]] = n[own]
            table = total[s][k].reshape(-1, ALPHABET)
            # the context of depth k - 1 drops the first of k symbols
            prior = np.tile(below.reshape(-1, ALPHABET), (ALPHABET if k else 1, 1)) if k else np.full((1, ALPHABET), 1 / ALPHABET)
            kinds, seen = (table > 0).sum(1, keepdims=True), table.sum(1, keepdims=True)
            smooth = np.where(seen > 0, (table + kinds * prior) / np.maximum(seen + kinds, 1), prior)
            below = smooth.ravel()
            logs.append(np.log(below).astype(np.float32))
        out.append(logs)
    return out


def scored(urls: DataFrame, models: list[list[np.ndarray]], url: str = "url") -> DataFrame:
    """Adds `score`: difference of the log-likelihoods per character, accepted less rejected."""
    shared = urls.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rejected, accepted = shared.value
        for batch in batches:
            symbols, offsets = folded(batch.column(url))
            gain = np.zeros(len(symbols))
            for k in range(ORDER + 1):  # the longest context inside the url wins
                code = grams(symbols, offsets, k)
                has = code >= 0
                gain[has] = accepted[k][code[has]].astype(float) - rejected[k][code[has]]
            total = np.append(0, np.cumsum(gain))
            score = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
            yield from C.replace_columns(pa.Table.from_batches([batch]), score=pa.array(np.round(score, 9))).to_batches()

    return urls.mapInArrow(run, C.schema_with(urls, score="double"))


def threshold(held: DataFrame, models: list[list[np.ndarray]]) -> float:
    """Score that separates held-out classes best, from a histogram in steps of `STEP`."""
    bin_ = F.floor(F.col("score") / STEP).cast("long")
    rows = scored(held, models).groupBy(bin_.alias("bin")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).orderBy("bin").collect()
    if not rows:
        return 0.0
    at, good, bad = (np.array([r[i] for r in rows], float) for i in range(3))
    below_good, below_bad = np.append(0, np.cumsum(good)), np.append(0, np.cumsum(bad))
    value = (1 - below_good / max(good.sum(), 1)) + below_bad / max(bad.sum(), 1)
    if value.max() <= 1:
        return 0.0
    best = int(value.argmax())  # the first bin that is accepted; a gap before it is split in the middle
    low = at[best - 1] + 1 if best else at[0]
    high = at[best] if best < len(at) else at[-1] + 1
    return float((low + high) / 2 * STEP)


def judged(urls: DataFrame, rules: list[tuple[str, bool]], url: str = "url") -> DataFrame:
    """The columns of `urls` and host, path, rule, score, verdict. `rules`: (host/path, allowed), a bounded list."""
    C.prepare(urls)
    host, path = parts(F.col(url))
    found = urls.drop("host", "path", "rule", "score", "verdict").withColumn("host", host).withColumn("path", path).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.create_map(*[x for r, a in rules for x in (F.lit(r), F.lit(a))]) if rules else F.create_map().cast("map<string,boolean>")
    labelled = found.where("rule is not null").select(F.col(url).alias("url"), allowed[F.col("rule")].alias("accepted"))
    held = F.pmod(F.xxhash64("url"), F.lit(10)) == 0
    models = tables(counts(labelled.where(~held)))
    sides = labelled.agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).first()
    limit = threshold(labelled.where(held), models) if sides["good"] and sides["bad"] else float("inf") if sides["bad"] else float("-inf")
    chosen = F.coalesce(allowed[F.col("rule")], F.col("score") >= F.lit(limit))
    return scored(found, models, url).withColumn("verdict", F.when(chosen, "allow").otherwise("block"))
