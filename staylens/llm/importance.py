"""Importance resampling towards a target: documents are drawn without repeats, by chances that rise with their likeness to it.

Words are runs of letters and digits (other than ASCII everything counts as a letter), A-Z lower-cased. Features are all runs of one and
two consecutive words, joined by a space and counted with repeats. A feature's bucket is the CRC-32 of its bytes modulo `buckets`. The
gain of a bucket is the smoothed log ratio of its share in the target and in the documents, in thousandths; a document's weight is the
floored mean of the gains of its features, and Gumbel noise from a hash of its id turns the highest scores into a draw by weight.

CRCs. Different words of a slice are numbered by their bytes, eight at a time, different pairs by the two numbers. All features of one length
form a matrix of bytes, one column for each feature; a step looks up the next byte of all of them at once. Buckets are then scattered back to
the places of the features. Only features longer than `LONG` bytes are hashed one by one.

Two passes over the texts, none of which shuffles them: counts per bucket (at most `buckets` numbers a task), then weights, with the gains
sent to all tasks. The ranks of the draw come from a range sort of ids and scores; only one count per partition reaches the driver.

A null text has no words, no features and weight 0. A null id is hashed as an empty one and comes last among equal scores. Equal rows
are separate rows and take neighbouring ranks. Without documents, or without a target, counts are zero and nothing fails. Long texts are
taken in slices of `SLICE` words. Columns other than id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C
from staylens.session import materialise

SLICE, LONG, POLYNOMIAL = 1 << 18, 256, 0xEDB88320
U8, U32, U64 = np.uint8, np.uint32, np.uint64
INSIDE = np.ones(256, bool)
INSIDE[:0x30] = INSIDE[0x3A:0x41] = INSIDE[0x5B:0x61] = INSIDE[0x7B:0x80] = False
LOWER = np.arange(256, dtype=U8)
LOWER[0x41:0x5B] += 32


def table(polynomial: int = POLYNOMIAL) -> np.ndarray:
    """What one byte does to a CRC: eight shifts of all 256 bytes."""
    out = np.arange(256, dtype=U32)
    for _ in range(8):
        out = np.where(out & U32(1), (out >> U32(1)) ^ U32(polynomial), out >> U32(1))
    return out


TABLE = table()


def updated(crc: np.ndarray, column: np.ndarray) -> np.ndarray:
    return TABLE[(crc ^ column) & U32(255)] ^ (crc >> U32(8))


def matrix_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of features. A row of `start` and `length` lists the byte ranges that a feature is joined from."""
    total = length.sum(axis=1)
    out = np.zeros(len(total), U32)
    order = np.argsort(total, kind="stable")
    order = order[: np.searchsorted(total[order], LONG, side="right")]  # by length, so that features of one length are neighbours
    extent = length[order].ravel().astype(np.int32)  # a slice joins far less than 2**31 bytes
    behind = np.cumsum(extent, dtype=np.int32)
    joined = data[np.arange(behind[-1] if len(behind) else 0, dtype=np.int32) + np.repeat(start[order].ravel().astype(np.int32) - (behind - extent), extent)]
    cut = np.append(np.flatnonzero(C.first_of_run(total[order])), len(order))
    at = 0
    for a, b in zip(cut[:-1], cut[1:]):
        size = int(total[order[a]])
        matrix = np.ascontiguousarray(joined[at : at + size * (b - a)].reshape(b - a, size).T)  # row i holds byte i of every feature
        at += size * (b - a)
        crc = np.full(b - a, 0xFFFFFFFF, U32)
        for column in matrix:
            crc = updated(crc, column)
        out[order[a:b]] = ~crc
    for i in np.flatnonzero(total > LONG):
        out[i] = zlib.crc32(b"".join(data[s : s + n].tobytes() for s, n in zip(start[i], length[i])))
    return out


def numbered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of byte ranges without zero bytes, equal for equal ranges only, and one place of each number. `data` has eight more bytes."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # eight bytes from every place
    number, first = np.zeros(len(start), np.int64), [np.zeros(0, np.int64)]
    made, open_, known = 0, np.flatnonzero(length <= LONG), None
    at = 0
    while len(open_):
        left = np.minimum(length[open_] - at, 8).astype(U64)
        key = eight[start[open_] + at] & (U64(2**64 - 1) >> (U64(64) - U64(8) * left))
        if known is not None:
            key = np.unique(key, return_inverse=True)[1] + known * len(open_)
        _, sample, known = np.unique(key, return_index=True, return_inverse=True)
        over = length[open_] <= at + 8
        ends = C.distinct(known[over])  # ranges that end here have a zero byte behind them, so none that goes on shares their number
        ending = np.zeros(len(sample), bool)
        ending[ends] = True
        fresh = np.cumsum(ending) - 1
        number[open_[over]] = made + fresh[known[over]]
        place = np.full(len(ends), -1)
        place[fresh[known[over]]] = open_[over]
        first.append(place)
        made += len(ends)
        open_, known = open_[~over], known[~over]
        at += 8
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(length > LONG):
        word = data[start[i] : start[i] + length[i]].tobytes()
        if word not in seen:
            seen[word] = made + len(seen)
            first.append(np.array([i]))
        number[i] = seen[word]
    return number, np.concatenate(first)


def buckets_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of words in order, and the texts that own them: first all words, then all pairs within a text."""
    number, first = numbered(data, start, end - start)
    begin, size = start[first], (end - start)[first]
    single = matrix_crcs(data, begin[:, None], size[:, None])[number]
    left = np.flatnonzero(owner[1:] == owner[:-1])
    pair, which = np.unique(number[left] * len(first) + number[left + 1], return_inverse=True)
    a, b = np.divmod(pair, max(1, len(first)))
    blank = np.full(len(pair), len(data) - 1)  # the last byte of the buffer is a space
    double = matrix_crcs(data, np.stack([begin[a], blank, begin[b]], 1), np.stack([size[a], np.ones_like(a), size[b]], 1))[which]
    return (np.concatenate([single, double]) % U32(buckets)).astype(np.int64), np.concatenate([owner, owner[left]])


def features(column, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a column of texts: words per text, buckets and owners of their features."""
    data, offsets = C.flat(column, pad=9)
    data[:] = LOWER[data]
    data[-1] = 0x20
    start, end, first = C.tokens(INSIDE[data[: offsets[-1]]], offsets)
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    for a in range(0, len(start), SLICE):
        b = min(a + SLICE, len(start))
        more = min(b + 1, len(start))  # the next word, for the pair that begins with the last
        bucket, of = buckets_of(data, start[a:more], end[a:more], owner[a:more], buckets)
        if more > b:  # its own feature belongs to the next slice
            keep = np.ones(len(of), bool)
            keep[b - a] = False
            bucket, of = bucket[keep], of[keep]
        yield np.bincount(owner[a:b], minlength=texts), bucket, of


def bucket_counts(docs: DataFrame, buckets: int = 10000, text: str = "text") -> DataFrame:
    """Frame (bucket, n) of all features of a table; buckets without features are left out."""
    C.prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
            C.trim()
        has = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(has, pa.int64()), "n": pa.array(total[has], pa.int64())})

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10000, text: str = "text", target_text: str = "text") -> np.ndarray:
    """Gain of each bucket in thousandths: `buckets` numbers, whatever the size of the tables."""
    both = []
    for df, column in ((docs, text), (target, target_text)):
        n = [0] * buckets
        for r in bucket_counts(df, buckets, column).collect():
            n[r["bucket"]] = r["n"]
        both.append((n, sum(n)))
    (s, all_s), (t, all_t) = both
    return np.array([math.floor(1000 * math.log((t[i] + 1) * (all_s + buckets) / ((s[i] + 1) * (all_t + buckets)))) for i in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Frame (id, n_words, n_features, weight)."""
    C.prepare(docs)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for counted, bucket, owner in features(batch.column(1), len(gain)):
                n_words += counted
                n_features += np.bincount(owner, minlength=batch.num_rows)
                total += np.bincount(owner, gain[bucket], minlength=batch.num_rows).astype(np.int64)  # whole numbers, exact in doubles
            weight = total // np.maximum(n_features, 1)
            yield pa.record_batch([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["id", "n_words", "n_features", "weight"])
            C.trim()

    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint")


def scored(weights: DataFrame, seed: int = 7) -> DataFrame:
    """Adds `score`: the weight and Gumbel noise from the first 32 bits of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", (F.col("weight") + noise).cast("bigint"))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds `rank`, gapless from 1, by score descending, then id. A range sort numbers the rows of each partition, the counts of the partitions
    before it are added; equal rows are told apart by their place in the stored table, so no key is too large for a task."""
    rows = materialise(rows).withColumn("__place", F.monotonically_increasing_id())
    by = [F.desc("score"), F.asc_nulls_last("id"), F.asc("__place")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__place").withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(placed).withColumn("__part", F.shiftright("__at", 33))
    before, offsets = 0, []
    for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():
        offsets.append((r["__part"], before))
        before += r["n"]
    known = rows.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(known), "__part").withColumn("rank", number).drop("__part", "__at", "__before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10000, seed: int = 7, id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Frame (id, n_words, n_features, weight, score, rank) of every document. Of those with `least_words` words or more, `percent` of a hundred
    are drawn, rounded down; the others have no rank."""
    gain = gains(docs, target, buckets, text, target_text)
    found = materialise(scored(weighed(docs, gain, id, text), seed))
    fit = F.col("n_words") >= least_words
    drawn = percent * found.where(fit).count() // 100
    order = ranked(found.where(fit)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.unionByName(found.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))).withColumnRenamed("id", id)
