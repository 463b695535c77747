"""Byte-level BPE: encoding by overlapping chunks, decoding by concatenation.

A text of at most `chunk` characters is pre-tokenised and encoded in the task that reads it. A longer one is cut into chunks
that overlap by `overlap` characters; the chunks are dealt to all tasks and pre-tokenised there, each from its own first
character. The pattern looks forward only, so from the first boundary that two neighbouring chunks share, both cut alike: the
stitch takes the pieces of a chunk up to that boundary and those of the next one from there. Where neighbours share no
boundary within the overlap (one pre-token runs through it), the text of both is cut again from the last certain boundary.
Each piece is encoded on its own by the ranks. Decoding looks up the bytes of each id and joins them.

A null text is empty and has no ids; an id outside the vocabulary decodes to no bytes. Equal rows are encoded alike.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C

CHUNK, OVERLAP, REMEMBERED = 1 << 15, 1 << 9, 100_000


class Coder:
    """Ranks of a vocabulary and the pattern that cuts a text into pieces; remembers the ids of frequent pieces."""

    _made: dict[tuple[bytes, str], Coder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = {i: b for b, i in ranks.items()}
        pairs = [x + bytes([b]) for x in (b"a", b"1", b"!") for b in range(0xC2, 0xF5)]
        probe = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + pairs)}
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=probe, special_tokens={})
        self.stand_in: dict[int, str] = {}
        self.settled: set[str] = set(map(chr, range(128)))
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, shared) -> Coder:
        """The coder of a broadcast (file content, pattern), built once per worker."""
        made = cls._made.get(shared.value)
        if made is None:
            content, pattern = shared.value
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
            made = cls._made[shared.value] = cls(ranks, pattern)
        return made

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text)
        # Unicode versions differ on code points assigned of late: let the encoder's own version say what they are
        there = set(text)
        for c in there.difference(self.settled):
            if unicodedata.category(c) != "Cn":
                self.settled.add(c)
            elif ord(c) not in self.stand_in:
                self.stand_in[ord(c)] = next((x for x in "a1" if max(self.probe.encode_ordinary(x + c)) > 255), "!")
        if there.issubset(self.settled):
            return self.pattern.findall(text)
        edge = starts(self.pattern.findall(text.translate(self.stand_in)), 0).tolist()
        return [text[i:j] for i, j in zip(edge, edge[1:])]

    def ids_of(self, piece: str) -> bytes:
        found = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = found
        return found

    def encode(self, pieces: list[str]) -> bytes:
        known, missing = self.known.get, self.ids_of
        return b"".join([known(p) or missing(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        get = self.vocabulary.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()])


def starts(pieces: list[str], at: int) -> np.ndarray:
    """Offsets of the pieces of a text that begins at `at`, and of its end."""
    return at + np.append(0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(len(text), 1), chunk)]


def stitch(coder: Coder, parts: list[tuple[int, list[str]]], length: int) -> list[str]:
    """Pieces of a whole text from the pieces of its chunks, each with the offset of its chunk."""
    at, pieces = parts[0]
    bounds = starts(pieces, at)
    done: list[str] = []
    for following, new in parts[1:]:
        end = int(bounds[-1])
        if end >= length:  # the last chunks lie inside what is already cut
            break
        fresh = starts(new, following)
        shared = np.intersect1d(bounds[(bounds >= following) & (bounds < end)], fresh, assume_unique=True)
        if len(shared):
            i, j = np.searchsorted(bounds, shared[0]), np.searchsorted(fresh, shared[0])
            done += pieces[:i]
            pieces, bounds = new[j:], fresh[j:]
        else:  # cut again from the start of the last piece that ends before the chunk does
            i = max(0, len(pieces) - 1)
            rest = "".join(pieces[i:])
            rest += "".join(new)[end - following :]
            done += pieces[:i]
            pieces = coder.pieces(rest)
            bounds = starts(pieces, int(bounds[i]))
    return done + pieces


def shared_ranks(df: DataFrame, path: str, pattern: str):
    """The vocabulary file, whose size is fixed, for all tasks."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of `docs` and `n_tokens`, `ids` (little-endian unsigned 32-bit integers)."""
    C.prepare(docs)
    shared = shared_ranks(docs, path, pattern)
    schema = C.schema_with(docs, n_tokens="bigint", ids="binary")

    def out(rows: pa.Table | pa.RecordBatch, ids: list[bytes]):
        rows = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
        return C.replace_columns(rows, n_tokens=pa.array([len(b) // 4 for b in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(shared)
        for batch in batches:
            ids = [coder.encode(coder.pieces(t)) if t else b"" for t in batch.column(text).to_pylist()]
            yield from out(batch, ids).to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                made = chunks(t, chunk, overlap)
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(made), pa.int64()), "at": pa.array([a for a, _ in made], pa.int64()), "part": [p for _, p in made], "length": pa.array([len(t)] * len(made), pa.int64())})

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(shared)
        for batch in batches:
            sizes = [np.fromiter(map(len, coder.pieces(t)), np.int32).tobytes() for t in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.binary())], names=["key", "at", "part", "length", "sizes"])

    def join(table: pa.Table) -> pa.Table:
        coder = Coder.of(shared)
        table = table.sort_by("at")
        parts = []
        for at, part, sizes in zip(table.column("at").to_pylist(), table.column("part").to_pylist(), table.column("sizes").to_pylist()):
            edge = np.append(0, np.cumsum(np.frombuffer(sizes, np.int32))).tolist()
            parts.append((at, [part[i:j] for i, j in zip(edge, edge[1:])]))
        ids = coder.encode(stitch(coder, parts, table.column("length")[0].as_py()))
        return pa.table({"key": table.column("key").slice(0, 1), "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    length = F.coalesce(F.length(F.col(text)), F.lit(0))
    short = docs.where(length <= chunk).mapInArrow(whole, schema)
    # a long text goes to the tasks in chunks, and its row meets the ids again under a number of its own
    long = docs.where(length > chunk).select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(C.ROW))
    parts = long.select("key", F.col(f"{C.ROW}.`{text}`").alias("text")).mapInArrow(cut, "key bigint, at bigint, part string, length bigint")
    parts = parts.repartition("key", "at").mapInArrow(pretokenise, "key bigint, at bigint, part string, length bigint, sizes binary")
    ids = parts.groupBy("key").applyInArrow(join, "key bigint, n_tokens bigint, ids binary")
    kept = [F.col(f"{C.ROW}.`{c}`").alias(c) for c in docs.columns if c not in ("n_tokens", "ids")]
    stitched = long.join(ids, "key").select(*kept, "n_tokens", "ids")
    return short.unionByName(stitched)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The columns of `encoded` and `decoded` (binary): the bytes of the ids, joined."""
    C.prepare(encoded)
    shared = shared_ranks(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(shared)
        for batch in batches:
            found = [coder.decode(i) if i else b"" for i in batch.column(ids).to_pylist()]
            yield from C.replace_columns(pa.Table.from_batches([batch]), decoded=pa.array(found, pa.binary())).to_batches()

    return encoded.mapInArrow(run, C.schema_with(encoded, decoded="binary"))
