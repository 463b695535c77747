"""Shared helpers of the training-data operators: flat text buffers, bundles of documents, packed exchanges, components.

Bundles. Several operators look at every text two or three times, with a corpus-wide exchange of hashes in between. The
rows are dealt to bundles of a few megabytes by a hash of id and text, so a bundle has the same rows in the same order
(`ordered`) in every pass and a message can name a row by its ordinal. All passes group the same frame by the same key,
which lets Spark shuffle the texts once and reuse that exchange.

Packed exchange. Messages are rows (block, bundle, blob): one row holds all entries of a bundle for one range of hash
values, as numpy arrays laid out one after the other. A bundle sends one entry for each different key it holds, so a key
of a third of all rows costs its block one entry per bundle.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.session import ship_package, stored

BUNDLE, ROW = "__bundle", "__row"
MESSAGE = "block int, bundle int, blob binary"
U64 = np.uint64


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = 500


def trim() -> None:
    """Give freed memory back to the system between the groups of a task, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def prepare(df: DataFrame) -> DataFrame:
    """Send the package to the executors, and bound the texts that a task holds as one Arrow batch."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get(ARROW_ROWS, "10000")) > TEXTS_PER_BATCH:
        spark.conf.set(ARROW_ROWS, str(TEXTS_PER_BATCH))
    return df


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Bytes of text and rows: one aggregate that sizes the bundles, so their memory does not grow with the input."""
    got = docs.agg(F.sum(F.octet_length(F.col(text))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    return int(got["bytes"] or 0), int(got["rows"])


def bundled(docs: DataFrame, target_bytes: int, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Frame (bundle, row struct of all columns) of bundles of about `target_bytes`, and their number."""
    prepare(docs)
    total, rows = sizes(docs, text)
    n = max(1, -(-(total + 64 * rows) // target_bytes))
    key = F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(n)).cast("int")
    return docs.select(key.alias(BUNDLE), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)), n


def fields(table: pa.Table) -> pa.Table:
    """The row struct of a bundle as a table."""
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in table.column(ROW).chunks]).combine_chunks()


def ordered(table: pa.Table, id: str = "doc_id", text: str = "text") -> pa.Table:
    """Rows of a bundle by id, then text; equal rows are interchangeable. Nulls come last."""
    rows = fields(table)
    if rows.num_rows < 2:
        return rows
    ids = rows.column(id)
    if ids.null_count == 0 and len(np.unique(ids.to_numpy())) == len(ids):
        return rows.take(pa.array(np.argsort(ids.to_numpy(), kind="stable")))
    key = [(v is None, v or 0, t is None, t or "") for v, t in zip(ids.to_pylist(), rows.column(text).to_pylist())]
    return rows.take(pa.array(sorted(range(len(key)), key=key.__getitem__)))


def flat(column: pa.ChunkedArray | pa.Array, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the offsets of its values; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(pad, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    out = np.zeros(size + pad, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts laid end to end: starts, ends, and for each text the index of its first word
    (one more entry at the end)."""
    return tokens(~WHITE[data], offsets)


def tokens(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        start[cut] = inside[cut]
        end[:-1] &= ~inside[1:]
        end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = x ^ U64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of a symbol array, from one prefix sum."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        up, down = self._of(base, n + 1)
        with np.errstate(over="ignore"):
            self.sum = np.zeros(n + 1, U64)
            np.cumsum((symbols.astype(U64) + U64(1)) * up[:n], out=self.sum[1:])
        self.down = down

    @classmethod
    def _of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                made = []
                for b in (base, pow(base, -1, 2**64)):
                    p = np.full(size, U64(b), U64)
                    p[0] = 1
                    made.append(np.cumprod(p))
            have = cls._powers[base] = tuple(made)
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[end] - self.sum[start]) * self.down[start]


class Prime:
    """Polynomial hashes modulo the prime 2**31 - 1, as a second opinion: sequences that share a polynomial modulo 2**64 whatever its base (of
    Thue and Morse, say) differ here."""

    P = U64(2**31 - 1)
    _powers: dict[int, np.ndarray] = {}

    def __init__(self, symbols: np.ndarray, base: int = 1220703125):
        n = len(symbols)
        up, self.down = (self._of(b, n + 1) for b in (base, pow(base, -1, int(self.P))))
        self.sum = np.zeros(n + 1, U64)
        np.cumsum((mix(symbols, 11) >> U64(34)) * up[:n] % self.P, out=self.sum[1:])

    @classmethod
    def _of(cls, base: int, n: int) -> np.ndarray:
        out = cls._powers.get(base)
        if out is None or len(out) < n:
            out, step = np.ones(1, U64), U64(base)
            while len(out) < max(n, 1 << 16):  # twice as many with each round
                out = np.append(out, out * step % cls.P)
                step = step * step % cls.P
            cls._powers[base] = out
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[start]) % self.P * self.down[start] % self.P


LONG_WORD = 4096


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from its length and bytes, eight at a time, each step mixed before the next."""
    length = end - start
    value = length.astype(U64) * U64(0xD6E8FEB86659FD93)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # eight bytes from every place
    at, live = 0, np.flatnonzero((length > 0) & (length <= LONG_WORD))
    while len(live):
        left = np.minimum(length[live] - at, 8).astype(U64)
        value[live] = mix(value[live] ^ (eight[start[live] + at] & (U64(2**64 - 1) >> (U64(64) - U64(8) * left))), 5)
        at += 8
        live = live[length[live] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        value[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), U64)[0]
    return mix(value, 9)


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Boolean array: lies in any of the ranges."""
    edge = np.bincount(start, minlength=length + 1) - np.bincount(end, minlength=length + 1)
    return np.cumsum(edge[:length]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, each stored by byte planes so that leading zero bytes compress."""
    n = len(arrays[0])
    out = [np.uint32(n).tobytes()]
    for a in arrays:
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(n, a.dtype.itemsize).T).tobytes() if n else b"")
    return b"".join(out)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.uint32, 1)[0]), 4, []
    for t in map(np.dtype, types):
        plane = np.frombuffer(blob, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def by_block(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted 64-bit keys: the blocks present (equal ranges of the key space) and the cuts between them."""
    block = block_of(keys, blocks)
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
    return block[cut], cut, np.append(cut[1:], len(block)) if len(cut) else cut


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int32)


def messages(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    trim()
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "bundle": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def entries(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """Messages in a fixed order."""
    rows = zip(table.column("block").to_pylist(), table.column("bundle").to_pylist(), table.column("blob").to_pylist())
    return iter(sorted(rows, key=lambda r: (r[0], r[1])))


def replace_columns(table: pa.Table, **columns) -> pa.Table:
    for name, value in columns.items():
        i = table.schema.get_field_index(name)
        table = table.set_column(i, name, value) if i >= 0 else table.append_column(name, value)
    return table


def schema_with(docs: DataFrame, **added: str) -> str:
    """DDL of the columns of `docs`, where an added column replaces one of its name."""
    own = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | added
    return ", ".join(f"`{n}` {t}" for n, t in own.items())


def first_of_run(values: np.ndarray) -> np.ndarray:
    """Mask of the first element of each run of equal values."""
    if not len(values):
        return np.zeros(0, bool)
    return np.concatenate(([True], values[1:] != values[:-1]))


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values, ascending: sorting integers is faster than hashing them."""
    values = np.sort(values)
    return values[first_of_run(values)]


def grouped(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by (key, check), stable, and the mask of the first of each group. One sort of the leading bits with the
    index behind them; if these bits join different keys, a full sort."""
    bits = max(1, len(key).bit_length())
    packed = np.sort((key >> U64(bits) << U64(bits)) | np.arange(len(key), dtype=U64))
    order = (packed & U64((1 << bits) - 1)).astype(np.int64)
    head = first_of_run(key[order]) | first_of_run(check[order])
    if (head & ~first_of_run(packed >> U64(bits))).any():
        order = np.lexsort((check, key))
        head = first_of_run(key[order]) | first_of_run(check[order])
    return order, head


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each element's component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


EDGES, AT_ONCE = "u bigint, v bigint, open boolean", 1 << 20


def star(u: np.ndarray, v: np.ndarray, open: np.ndarray) -> pa.RecordBatch:
    """Every node but the smallest of what hangs together by the edges u > v, with the smallest. Open tells of edges that were open before, or of
    a node that had no smaller neighbour before."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = union_find(len(node), at[: len(u)], at[len(u) :])
    below = low < np.arange(len(node))
    had = np.zeros(len(node), bool)
    had[at[: len(u)]] = True
    still = open.any() or (below & ~had).any()
    return pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(node[low[below]]), pa.array(np.full(np.count_nonzero(below), still))], names=["u", "v", "open"])


def stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v, open), u > v, joined up within each task: in pieces of about AT_ONCE edges, dealt by u so that a repeated task finds the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "open")] for batch in batches if batch.num_rows]
        if got:
            u, v, open = map(np.concatenate, zip(*got))
            pieces = -(-len(u) // AT_ONCE)
            piece = mix(u.view(U64), 13) % U64(pieces)
            for i in range(pieces):
                own = piece == i
                if own.any():
                    yield star(u[own], v[own], open[own])

    return edges.select("u", "v", "open").mapInArrow(run, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """Frame (node, component) of the linked nodes. In each round a node's smallest neighbour gives way to the smallest neighbour of that one,
    tasks join up what they hold, and all smaller neighbours of a node meet in one task; until each node has one and that one none.

    A piece of a task sends a node once, so no node meets more neighbours than there are pieces, and a crowd's smallest node is a key in the
    join only, where its rows can be split. A round is three shuffles and one stored table, since a shuffle costs files for each of its tasks
    however few the edges; the driver sees one flag per round."""
    prepare(edges)
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v"), F.lit(True).alias("open"))
    while True:
        e = stored(stars(stars(e).repartition("u")))
        if not e.agg(F.max("open")).first()[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        low = e.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
        e = e.join(low, F.col("v") == F.col("of"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("open"))
