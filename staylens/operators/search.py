"""Document index and vector search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, IDF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens.functions import text as S
from staylens.session import materialise

QUERY_BLOCK, DOCUMENT_BLOCK, SLICE_BYTES = 256, 2048, 16 << 20


def rendered_documents(hotels: DataFrame, events: DataFrame) -> DataFrame:
    """ML-24, rendering: one row per hotel and event with id, text and metadata."""
    meta = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    blank = F.lit("")
    h = hotels.select(
        F.concat(F.lit("hotel_"), "id").alias("id"), S.hotel_text().alias("text"),
        meta(source=F.lit("hotels"), type=F.lit("hotel"), hotel_id=F.col("id"), city=F.coalesce("city", blank), district=F.coalesce("district", blank)).alias("metadata"))
    day = F.datediff("date_start", F.lit("1970-01-01").cast("date"))
    e = events.select(
        F.concat(F.lit("event_"), "event_id").alias("id"), S.event_text().alias("text"),
        meta(source=F.lit("events"), type=F.lit("event"), event_id=F.col("event_id"), date_epoch_days=day.cast("string"),
             date_start=F.col("date_start").cast("string"), event_type=S.event_type_label("event_type")).alias("metadata"))
    return h.unionByName(e)


def embed(documents: DataFrame, dimensions: int = 256) -> DataFrame:
    """ML-24, embedding: hashed term frequencies weighted by rarity, unit length. Stands where a remote embedding model
    stood; the hashing needs no vocabulary and the rarity weights are one pass of sums per dimension."""
    words = Tokenizer(inputCol="text", outputCol="_w").transform(documents)
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dimensions).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_v").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_v", outputCol="_u").transform(weighted)
    return unit.select(*documents.columns, vector_to_array("_u", "float32").alias("embedding"))


def stored_index(documents: DataFrame, path: str, dimensions: int = 256) -> DataFrame:
    """ML-24, index: the documents with metadata and vectors as a table at `path`, built anew: what was there is cleared first, so documents that
    are gone do not stay. `documents` must not be read from that table."""
    embed(documents, dimensions).write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.parquet(path)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, NULL for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def matching(documents: DataFrame, where: Column) -> DataFrame:
    """ML-25, filter: rows that satisfy the metadata predicate, or all rows when none does."""
    flagged = documents.withColumn("_ok", F.coalesce(where, F.lit(False)))
    any_hit = flagged.agg(F.coalesce(F.max(F.col("_ok").cast("int")), F.lit(0))).scalar()
    return flagged.filter(F.col("_ok") | (any_hit == 0)).drop("_ok")


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=-1, keepdims=True), 1e-300)


def vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_of(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row and the ids that have them, ties by id. Ids ascend."""
    order = np.argsort(distance, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(distance, order, axis=1), ids[order]


def top_k(documents: DataFrame, queries: DataFrame, k: int, id_col: str = "id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """ML-25: the k nearest documents of each query by cosine distance, ties by id. Exact, for any number of queries.

    Queries go to the documents, in slices of at most about `slice_bytes`, which is what a task holds of them; the documents are read in place and
    never shuffled. A task keeps the best k of each query over all its batches, so k rows per query and task are shuffled, whatever the number of documents."""
    asked = materialise(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull()))
    stored = documents.select(id_col, F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull())
    total = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    part = F.pmod(F.xxhash64("query_id", "embedding"), F.lit(slices))
    scored = [_slice_scores(stored, asked.filter(part == i), k, id_col) for i in range(slices)]
    return ranked(reduce(DataFrame.unionByName, scored), k, id_col)


def ranked(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("distance", id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _slice_scores(stored: DataFrame, asked: DataFrame, k: int, id_col: str) -> DataFrame:
    rows = asked.toArrow()
    ids = rows.column("query_id").to_pylist()
    shared = stored.sparkSession.sparkContext.broadcast(unit(vectors(rows.column("embedding").combine_chunks())))
    types = f"at int, {id_col} {stored.schema[id_col].dataType.simpleString()}, distance double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best = shared.value, None
        for batch in batches:
            for lo in range(0, batch.num_rows if len(wanted) else 0, DOCUMENT_BLOCK):
                part = batch.slice(lo, DOCUMENT_BLOCK)
                part = part.take(pc.sort_indices(part.column(0)))
                found = best_of(1.0 - wanted @ unit(vectors(part.column(1))).T, part.column(0).to_numpy(zero_copy_only=False), k)
                if best is not None:  # merge, ties by id
                    distance, named = np.concatenate([best[0], found[0]], axis=1), np.concatenate([best[1], found[1]], axis=1)
                    order = np.lexsort((named, distance), axis=1)[:, :k]
                    found = np.take_along_axis(distance, order, axis=1), np.take_along_axis(named, order, axis=1)
                best = found
        if best is not None:
            for lo in range(0, len(wanted), QUERY_BLOCK):
                distance, named = (x[lo : lo + QUERY_BLOCK] for x in best)
                at = np.repeat(np.arange(lo, lo + len(distance), dtype=np.int32), distance.shape[1])
                yield pa.record_batch({"at": pa.array(at), id_col: pa.array(named.ravel().tolist()), "distance": pa.array(distance.ravel())})

    names = stored.sparkSession.createDataFrame(list(enumerate(ids)), f"at int, query_id {asked.schema['query_id'].dataType.simpleString()}")
    return stored.mapInArrow(score, types).join(F.broadcast(names), "at").select("query_id", id_col, "distance")  # names: one slice


# --- hashed index ----------------------------------------------------------------------------------------------------
def planes(bits: int, dimensions: int, seed: int = 7) -> np.ndarray:
    """Random hyperplanes through the origin, orthogonal as far as the dimensions allow."""
    rng = np.random.default_rng(seed)
    made = [np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0].T for _ in range(-(-bits // dimensions))]
    return np.concatenate(made)[:bits]


def hashed_index(documents: DataFrame, bits: int, id_col: str = "id", seed: int = 7) -> DataFrame:
    """Every document with the bucket of its vector: one bit for the side of each of `bits` hyperplanes (at most 16). Zero vectors have a bucket too."""
    if not 1 <= bits <= 16:
        raise ValueError("the index takes 1 to 16 bits, so that its bucket counts stay small enough to broadcast")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = vectors(batch.column(1))
            side = matrix @ planes(bits, matrix.shape[1], seed).T > 0 if len(matrix) else np.zeros((0, bits), bool)
            yield pa.record_batch([pa.array(side @ (1 << np.arange(bits)), pa.int32()), *batch.columns], names=["bucket", id_col, "embedding"])

    rows = documents.select(id_col, F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull())
    return rows.mapInArrow(bucket, f"bucket int, {id_col} {rows.schema[id_col].dataType.simpleString()}, embedding array<double>")


def _probed(queries: DataFrame, bits: int, probes: int, seed: int) -> DataFrame:
    """Each query with the `probes` buckets that are nearest to its vector: by the sum of squared distances to the planes between."""
    flips = ((np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1).astype(np.float64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                matrix = unit(vectors(part.column(1)))
                offset = matrix @ planes(bits, matrix.shape[1], seed).T
                order = np.argsort((offset**2) @ flips.T, axis=1, kind="stable")[:, :probes]
                bucket = ((offset > 0) @ (1 << np.arange(bits)))[:, None] ^ order
                at = np.repeat(np.arange(part.num_rows), order.shape[1])
                yield pa.record_batch([pa.array(bucket.ravel(), pa.int32()), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], names=["bucket", "query_id", "embedding"])

    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull())
    return rows.mapInArrow(probe, f"bucket int, query_id {rows.schema['query_id'].dataType.simpleString()}, embedding array<double>")


def hashed_top_k(index: DataFrame, queries: DataFrame, k: int, bits: int, probes: int, id_col: str = "id", seed: int = 7) -> DataFrame:
    """ML-25 behind a hashed index: the documents of the `probes` buckets nearest to a query are compared exactly. All buckets give the
    result of `top_k`; fewer give most of it (recall is measured in the tests).

    A bucket is cut into parts of about `DOCUMENT_BLOCK` documents, and the queries that probe it go to each of its parts, so a bucket that
    holds most documents is spread over many tasks. Documents are shuffled once, however many queries there are."""
    id_type, q_type = index.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    parts = index.groupBy("bucket").agg(F.ceil(F.count("*") / DOCUMENT_BLOCK).cast("int").alias("parts"))  # at most 2 ** bits rows
    dealt = index.join(F.broadcast(parts), "bucket").select("bucket", F.pmod(F.xxhash64(id_col, "embedding"), "parts").cast("int").alias("part"), F.struct(F.col(id_col).alias("id"), "embedding").alias("r"))
    held = dealt.groupBy("bucket", "part").agg(F.collect_list("r").alias("docs"))
    probed = _probed(queries, bits, probes, seed).withColumn("block", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))))
    asked = probed.groupBy("bucket", "block").agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "embedding")).alias("asked"))
    sent = asked.join(F.broadcast(parts), "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, wanted = (batch.column(c)[i].values for c in (0, 1))
                rows = rows.take(pc.sort_indices(rows.field("id")))
                distance, named = best_of(1.0 - unit(vectors(wanted.field("embedding"))) @ unit(vectors(rows.field("embedding"))).T, np.arange(len(rows)), k)
                at = np.repeat(np.arange(len(wanted)), distance.shape[1])
                yield pa.record_batch({"query_id": wanted.field("id").take(pa.array(at)), id_col: rows.field("id").take(pa.array(named.ravel())), "distance": pa.array(distance.ravel())})

    scored = held.join(sent, ["bucket", "part"]).select("docs", "asked").mapInArrow(score, f"query_id {q_type}, {id_col} {id_type}, distance double")
    return ranked(scored, k, id_col)


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Mean vector per label, element by element."""
    parts = vectors.select(label, F.posexplode("embedding").alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"])
    return parts.groupBy(F.col(label).alias("query_id")).agg(packed.alias("embedding"))


def list_documents(documents: DataFrame, source: str | None = None) -> DataFrame:
    """ML-26."""
    return documents if source is None else documents.filter(F.col("metadata")["source"] == source)


def delete_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """ML-26."""
    return documents.join(ids.select("id").distinct(), "id", "left_anti")
