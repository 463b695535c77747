"""SimHash fingerprints of word shingles and their components, compared in bit slices.

Fingerprints. Texts are lower-cased (A-Z), split at white space and hashed by shingles of `shingle` words, repeats included (XXH64,
UTF-8, seed 42); a bit is set if it is set in more than half of the hashes. A text of fewer words is one shingle, a text of none
has fingerprint zero and links like any other. Nulls are texts without words.

Links. Fingerprints within `radius` differing bits agree on `BLOCKS - radius` of `BLOCKS` bit blocks, so each different
fingerprint is dealt to one bucket for every such choice of blocks. A bucket of more than `hot` fingerprints is dealt again by
parts of its other bits, of which one must agree as well. A task stores the bits of its buckets as vertical planes. For one lag, the
distances of all pairs that far apart are counted together: each plane is combined with itself shifted, and a tree of
carry-save adders adds the differences into two counter planes and an overflow plane. Words of 64 pairs are
abandoned once all overflow, buckets once they hang together. Only a spanning forest leaves a bucket, so no pairs within a group
are written; copies share one fingerprint.

Components are found over fingerprints in stored frames. A document without an id takes part; a component whose documents
all lack an id has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import common as C
from staylens.session import materialise

BLOCKS, HOT = 5, 4096


def fingerprint_batch(texts: list[str | None], shingle: int) -> np.ndarray:
    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for t in texts:
        words = (t or "").encode().lower().split()
        if len(words) <= shingle:
            hashes.append([digest(b" ".join(words), 42)] if words else [])
        else:
            joined = b" ".join(words)
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            start = np.append(0, end[: -shingle]).tolist()
            hashes.append([digest(joined[a:b], 42) for a, b in zip(start, (end[shingle - 1 :] - 1).tolist())])
        counts.append(len(hashes[-1]))
    out = np.zeros(len(texts), np.uint64)
    count = np.array(counts, np.int64)
    has = np.flatnonzero(count)
    if len(has):
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(count.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.append(0, np.cumsum(count[has])[:-1]), axis=0, dtype=np.int64)
        out[has] = np.packbits(2 * ones > count[has, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """The columns of `docs` except the text, and `fingerprint` (its 64 bits as a signed integer)."""
    C.prepare(docs)
    names = docs.drop(text, "fingerprint").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprint_batch(batch.column(text).to_pylist(), shingle).view(np.int64)
            table = pa.Table.from_batches([batch]).select(names)
            yield from table.append_column("fingerprint", pa.array(found)).to_batches()

    return docs.drop("fingerprint").mapInArrow(run, C.schema_with(docs.select(*names), fingerprint="bigint"))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values a word, with one more word of zeros."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.stack([packed(column) for column in bits.T])


def packed(mask: np.ndarray) -> np.ndarray:
    """Bits of a mask in words, with one more word of zeros."""
    size = -(-len(mask) // 64) * 8 + 8
    out = np.zeros(size, np.uint8)
    short = np.packbits(mask, bitorder="little")
    out[: len(short)] = short
    return out.view(np.uint64)


def shifted(plane: np.ndarray, lag: int) -> np.ndarray:
    """Planes whose bit i is bit i + lag."""
    word, bit = divmod(lag, 64)
    moved = np.zeros_like(plane)
    size = plane.shape[-1] - word
    if size > 0:
        moved[..., :size] = plane[..., word:] >> np.uint64(bit) if bit else plane[..., word:]
        if bit and size > 1:
            moved[..., : size - 1] |= plane[..., word + 1 :] << np.uint64(64 - bit)
    return moved


def add(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save tree: planes of one weight to one plane of that weight and the carries of double weight."""
    carries = []
    while len(column) > 2:
        k = len(column) // 3
        a, b, c, rest = column[:k], column[k : 2 * k], column[2 * k : 3 * k], column[3 * k :]
        half = a ^ b
        carries.append((a & b) | (c & half))
        column = np.concatenate([half ^ c, rest])
    if len(column) == 2:
        carries.append((column[0] & column[1])[None])
        column = (column[0] ^ column[1])[None]
    return column, np.concatenate(carries) if carries else column[:0]


def within(plane: np.ndarray, lag: int, mask: np.ndarray, radius: int, step: int = 16) -> np.ndarray:
    """Words whose bit i tells that values i and i + lag, if in the mask, differ in at most `radius` bits (3 or fewer)."""
    live = np.flatnonzero(mask)
    word = lag // 64
    over = ~mask[live]
    ones = np.zeros((1, len(live)), np.uint64)
    twos = np.zeros((1, len(live)), np.uint64)
    for at in range(0, 64, step):
        part = plane[at : at + step]
        bit = np.uint64(lag % 64)
        right = part[:, np.minimum(live + word, part.shape[1] - 1)] >> bit
        if lag % 64:
            right |= part[:, np.minimum(live + word + 1, part.shape[1] - 1)] << np.uint64(64 - lag % 64)
        ones, carry = add(np.concatenate([ones, part[:, live] ^ right]))
        twos, carry = add(np.concatenate([twos, carry]))
        over |= np.bitwise_or.reduce(carry, axis=0)
        keep = ~over != 0
        if not keep.all():
            live, over, ones, twos = live[keep], over[keep], ones[:, keep], twos[:, keep]
            if not len(live):
                break
    if radius < 3:
        over |= twos[0] if radius < 2 else twos[0] & ones[0]
        over |= ones[0] if radius < 1 else np.uint64(0)
    out = np.zeros_like(mask)
    out[live] = ~over
    return out


def forest(bucket: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value) that connect, within each bucket, all that hangs together. `bucket` is sorted."""
    parent = np.arange(len(values))
    origin = np.arange(len(values))
    size = np.bincount(bucket)[bucket]
    keep = size > 1
    bucket, values, origin, size = bucket[keep], values[keep], origin[keep], size[keep]
    lag = 0
    while len(values):
        plane = planes(values)
        same_until = len(values)
        # the planes serve several lags until many buckets are done
        while lag < same_until:
            lag += 1
            if lag >= len(values):
                break
            mask = np.zeros(len(values), bool)
            mask[:-lag] = bucket[:-lag] == bucket[lag:]
            if not mask.any():
                break
            found = within(plane, lag, packed(mask), radius)
            i = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(values)])
            a, b = parent[origin[i]], parent[origin[i + lag]]
            fresh = a != b
            if fresh.any():
                parent = C.union_find(len(parent), np.append(a[fresh], np.arange(len(parent))), np.append(b[fresh], parent))
            if lag & (lag - 1) == 0:
                break
        root = parent[origin]
        first = np.flatnonzero(C.first_of_run(bucket)) if len(bucket) else np.zeros(0, np.int64)
        number = np.cumsum(C.first_of_run(bucket)) - 1
        apart = np.maximum.reduceat(root, first) != np.minimum.reduceat(root, first)
        keep = apart[number] & (size > lag + 1)
        if not keep.all():
            bucket, values, origin, size = bucket[keep], values[keep], origin[keep], size[keep]
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return linked, parent[linked]


def keys(fp: F.Column, radius: int) -> F.Column:
    """Array of (table, key): one for each choice of blocks that must agree."""
    edge = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = lambda i: F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1))
    out = []
    for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        key = F.lit(0).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, edge[i + 1] - edge[i]).bitwiseOR(block(i))
        out.append(F.struct(F.lit(n).alias("table"), key.alias("key")))
    return F.array(*out)


def finer(fp: F.Column, table: F.Column, radius: int) -> F.Column:
    """Parts of the bits outside the agreeing blocks, `radius` + 1 for each table; one of them agrees as well."""
    edge = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    cases = F.lit(None).cast("array<bigint>")
    for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        rest = [b for i in range(BLOCKS) if i not in chosen for b in range(edge[i], edge[i + 1])]
        part = []
        for k in range(radius + 1):
            bits = rest[k * len(rest) // (radius + 1) : (k + 1) * len(rest) // (radius + 1)]
            part.append(fp.bitwiseAND(F.lit(sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0))))
        cases = F.when(table == n, F.array(*part)).otherwise(cases)
    return cases


def links(prints: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Links (a, b) between different fingerprints (column `fingerprint`, no repeats) that connect each component."""
    C.prepare(prints)
    dealt = prints.select("fingerprint", F.explode(keys(F.col("fingerprint"), radius)).alias("k")).select("fingerprint", "k.table", "k.key")
    count = dealt.groupBy("table", "key").count().where("count > 1")
    dealt = dealt.join(count, ["table", "key"])
    plain = dealt.where(F.col("count") <= hot).select("table", "key", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("bits"), "fingerprint")
    large = dealt.where(F.col("count") > hot).select("table", "key", F.posexplode(finer(F.col("fingerprint"), F.col("table"), radius)).alias("part", "bits"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(batch.column(c).to_numpy() for c in ("table", "key", "part", "bits", "fingerprint")) for batch in batches]
        if not got:
            return
        table, key, part, bits, fp = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((fp, bits, part, key, table))
        table, key, part, bits, fp = (x[order] for x in (table, key, part, bits, fp))
        new = C.first_of_run(table) | C.first_of_run(key) | C.first_of_run(part) | C.first_of_run(bits)
        a, b = forest(np.cumsum(new) - 1, fp.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    buckets = plain.unionByName(large).repartition("table", "key", "part", "bits")
    return buckets.mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The columns of `docs` except the text, `fingerprint`, `group` (a fingerprint that names the component) and `component`: the
    smallest id that is reachable by links."""
    found = materialise(fingerprints(docs.drop("component", "group"), text, shingle))
    prints = materialise(found.groupBy("fingerprint").agg(F.min(id).alias("least")))
    part = C.components(links(prints.select("fingerprint"), radius))
    member = prints.join(part.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("group", F.coalesce("component", "fingerprint")).drop("component")
    least = member.groupBy("group").agg(F.min("least").alias("component"))
    return found.join(member.select("fingerprint", "group").join(least, "group"), "fingerprint")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row with the smallest id (then hash of the text; rows
    without an id last) stays, and once only if it is repeated."""
    keyed = docs.withColumn("__id", F.coalesce(F.col(id).cast("bigint"), F.lit(2**63 - 1))).withColumn("__text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    found = classes(keyed.select(F.col("__id").alias("i"), F.col("__text").alias("h"), F.col(text).alias("text")), "i", "text", shingle, radius)
    kept = found.groupBy("group").agg(F.min(F.struct("i", "h")).alias("k")).select(F.col("k.i").alias("__id"), F.col("k.h").alias("__text"))
    again = Window.partitionBy("__id", "__text").orderBy(F.lit(0))
    return keyed.join(kept, ["__id", "__text"]).withColumn("__n", F.row_number().over(again)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
