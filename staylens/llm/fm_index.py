"""Benchmark decontamination by an FM-index per shard of training texts.

Words are runs of letters and digits (other than ASCII everything counts as a letter), A-Z lower-cased. A window is `width`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A shard is a few megabytes of
consecutive rows of a task. Its words become symbols: words of the benchmark have one each, all others share hashed
symbols that no window holds; texts are kept apart by separators, so a match stays in its text. The suffix array of the symbols gives the
Burrows-Wheeler transform, held in a wavelet matrix with rank counts. All windows are searched backward together; rows
found are walked to a sampled suffix position; their words are compared with the window's, so an equal hash alone is no hit.
Overlapping occurrences merge into removal spans.

The benchmark goes to the tasks in slices of at most `slice_bytes`: a larger one is searched slice by slice, and the spans add up.
A null or empty text has no words; an item without id marks words but is not listed; equal rows get equal results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C
from staylens.llm.suffix_dedup import refine

SHARD_BYTES, SLICE_BYTES, SAMPLE = 4 << 20, 16 << 20, 32
LETTER = np.ones(256, bool)
LETTER[:0x30] = LETTER[0x3A:0x41] = LETTER[0x5B:0x61] = LETTER[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends and hashes of the words; index of the first word of each text."""
    data = LOWER[data]
    start, end, first = C.tokens(LETTER[data], offsets)
    return data, start, end, first, C.word_hashes(data, start, end)


def suffix_array(symbols: np.ndarray, wide: int) -> np.ndarray:
    """Order of all suffixes by Larsson-Sadakane refinement; the last symbol is the only 0."""
    n = len(symbols)
    bits = n.bit_length()
    first = max(1, (64 - bits) // wide)
    wide_symbols = np.concatenate([symbols.astype(np.uint64), np.zeros(first, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(first):
        key = (key << np.uint64(wide)) | wide_symbols[i : i + n]
    key = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    member = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    key >>= np.uint64(bits)
    new = C.first_of_run(key)
    where = np.arange(n, dtype=np.uint32)
    rank = np.zeros(n + 1, np.uint32)
    rank[member] = np.maximum.accumulate(np.where(new, where, np.uint32(0)))
    reached = first
    while True:
        tied = ~(new & np.append(new[1:], True))
        member, where = member[tied], where[tied]
        if not len(member):
            break
        member, new = refine(rank, member, where, reached, bits)
        reached *= 2
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return order


class Ranks:
    """Bits in words of 64 with counts before each word."""

    def __init__(self, bits: np.ndarray):
        out = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        short = np.packbits(bits, bitorder="little")
        out[: len(short)] = short
        self.word = out.view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.word), dtype=np.int64))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.word[w] & below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Index:
    """Burrows-Wheeler transform in a wavelet matrix, and every `sample`-th position of the text."""

    def __init__(self, symbols: np.ndarray, wide: int, sample: int = SAMPLE):
        order = suffix_array(symbols, wide)
        self.wide = wide
        self.first = np.append(0, np.cumsum(np.bincount(symbols, minlength=1 << wide)))
        kept = order % sample == 0
        self.sampled, self.positions = Ranks(kept), order[kept]
        rest = symbols.astype(np.uint16 if wide <= 16 else np.uint32)[order - 1]
        self.levels, self.zeros = [], []
        for level in range(wide - 1, -1, -1):
            bit = (rest >> level) & 1 != 0
            self.levels.append(Ranks(bit))
            rest = np.concatenate([rest[~bit], rest[bit]])
            self.zeros.append(len(bit) - int(self.levels[-1].before[-1]))

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i of the transform."""
        begin = np.zeros_like(i)
        for level, ranks, zeros in zip(range(self.wide - 1, -1, -1), self.levels, self.zeros):
            up = (symbol >> level) & 1 != 0
            b, e = ranks.ones(begin), ranks.ones(i)
            begin, i = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, i - e)
        return i - begin

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ranks, zeros in zip(self.levels, self.zeros):
            up, ones = ranks.at(i), ranks.ones(i)
            out = (out << 1) | up
            i = np.where(up, zeros + ones, i - ones)
        return out

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and text position of all occurrences. A row of `phrases` holds a phrase at its right end."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        done = [(live[:0], low[:0], high[:0])]
        for step in range(phrases.shape[1]):
            over = sizes[live] == step
            done.append((live[over], low[over], high[over]))
            live, low, high = live[~over], low[~over], high[~over]
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            both = self.first[np.append(symbol, symbol)] + self.occurrences(np.append(symbol, symbol), np.append(low, high))
            low, high = both[: len(live)], both[len(live) :]
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        done.append((live, low, high))
        which, low, high = (np.concatenate(x) for x in zip(*done))
        count = high - low
        row = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return np.repeat(which, count), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, steps = np.zeros_like(row), np.zeros_like(row)
        open_ = np.arange(len(row))
        while len(open_):
            found = self.sampled.at(row)
            hit = open_[found]
            out[hit] = self.positions[self.sampled.ones(row[found])] + steps[hit]
            open_, row = open_[~found], row[~found]
            symbol = self.symbol(row)
            row = self.first[symbol] + self.occurrences(symbol, row)
            steps[open_] += 1
        return out


class Phrases:
    """Distinct windows of benchmark items, as symbols."""

    def __init__(self, items: list[tuple], width: int):
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        for id, text in items:
            data = bytes(LOWER[np.frombuffer((text or "").encode(), np.uint8)])
            start, end, _ = C.tokens(LETTER[np.frombuffer(data, np.uint8)], np.array([0, len(data)]))
            words = [data[a:b] for a, b in zip(start, end)]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                self.items[tuple(words[i : i + width])].add(id)
        self.windows = sorted(self.items)
        vocabulary = sorted({w for x in self.windows for w in x})
        data, offsets = C.flat(pa.array(vocabulary, pa.binary()))
        self.hashes = C.word_hashes(data, offsets[:-1], offsets[1:])
        self.seen = np.zeros(1 << 18, bool)  # by the first bits of the hash
        self.seen[self.hashes >> np.uint64(46)] = True
        order = np.argsort(self.hashes)
        self.hashes, number = self.hashes[order], {vocabulary[j]: i + 2 for i, j in enumerate(order)}
        self.wide = max(14, (len(vocabulary) + 4096).bit_length())
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.symbols = np.zeros((len(self.windows), max(self.sizes, default=1)), np.int64)
        for i, window in enumerate(self.windows):
            self.symbols[i, self.symbols.shape[1] - len(window) :] = [number[w] for w in window]
        self.joined = [b" ".join(w) for w in self.windows]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words: 2 and up for the benchmark's, behind them hashed ones."""
        n = len(self.hashes)
        others = np.uint64((1 << self.wide) - 2 - n)
        out = ((hashes >> np.uint64(32)) * others >> np.uint64(32)).astype(np.int64) + 2 + n
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(46)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), n - 1)
            known = self.hashes[at] == hashes[maybe]
            out[maybe[known]] = at[known] + 2
        return out

    def occurrences(self, column) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Windows and first words of their occurrences in the texts of a shard."""
        source, offsets = C.flat(column)
        data, start, end, first, hashes = spelled(source, offsets)
        texts = len(offsets) - 1
        symbols = np.ones(len(start) + texts + 1, np.int64)  # 1 behind each text, 0 at the end
        symbols[-1] = 0
        place = np.arange(len(start)) + np.repeat(np.arange(texts), np.diff(first))
        symbols[place] = self.of(hashes)
        which, at = Index(symbols, self.wide).search(self.symbols, self.sizes)
        word = np.searchsorted(place, at)
        raw = data.tobytes()
        same = np.fromiter((b" ".join([raw[start[j] : end[j]] for j in range(w, w + self.sizes[k])]) == self.joined[k] for k, w in zip(which, word)), bool, len(which))
        return which[same], word[same], (source, offsets, start, end, first)


COLUMNS = {"n_words": "bigint", "n_hit": "bigint", "items": "array<bigint>", "spans": "array<struct<start:bigint,end:bigint>>"}


def scan(docs: DataFrame, items: list[tuple], width: int, text: str, shard_bytes: int) -> DataFrame:
    """One slice of the benchmark; adds to the items and spans (byte ranges) that earlier slices found."""
    shared = docs.sparkSession.sparkContext.broadcast((items, width))

    def finish(phrases: Phrases, rows: pa.Table) -> pa.Table:
        which, word, (source, offsets, start, end, first) = phrases.occurrences(rows.column(text))
        hit = C.covered(len(start), word, word + phrases.sizes[which])
        earlier = rows.column("spans").to_pylist() if "spans" in rows.column_names else [()] * rows.num_rows
        found = [set(x or ()) for x in rows.column("items").to_pylist()] if "items" in rows.column_names else [set() for _ in range(rows.num_rows)]
        owner = np.searchsorted(first, word, side="right") - 1
        for k, d in set(zip(which.tolist(), owner.tolist())):
            found[d] |= phrases.items[phrases.windows[k]]
        spans, n_hit = [], []
        for d in range(rows.num_rows):
            lo, hi = first[d], first[d + 1]
            own = hit[lo:hi]
            for s in earlier[d] or ():
                own[np.searchsorted(start[lo:hi], offsets[d] + s["start"]) : np.searchsorted(start[lo:hi], offsets[d] + s["end"])] = True
            a, b = C.runs(own)
            spans.append([{"start": int(start[lo + i] - offsets[d]), "end": int(end[lo + j - 1] - offsets[d])} for i, j in zip(a, b)])
            n_hit.append(int(own.sum()))
        C.trim()
        return C.replace_columns(
            rows,
            n_words=pa.array(np.diff(first), pa.int64()),
            n_hit=pa.array(n_hit, pa.int64()),
            items=pa.array([sorted(x - {None}) for x in found], pa.list_(pa.int64())),
            spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, held, size = Phrases(*shared.value), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if size >= shard_bytes:
                yield from finish(phrases, pa.Table.from_batches(held)).to_batches()
                held, size = [], 0
        if held:
            yield from finish(phrases, pa.Table.from_batches(held)).to_batches()

    return docs.mapInArrow(run, C.schema_with(docs, **COLUMNS))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The columns of `docs` and `n_words`, `n_hit` (words inside occurrences), `items` (ids, ascending), `spans` (byte ranges,
    from the first to the last word of a run of hit words). Input columns of these names are replaced."""
    C.prepare(docs)
    docs = docs.drop(*COLUMNS)
    total, rows = C.sizes(benchmark, item_text)
    slices = max(1, -(-(total + 64 * rows) // slice_bytes))
    pick = F.pmod(F.xxhash64(F.col(item), F.col(item_text)), F.lit(slices))
    for n in range(slices):
        items = benchmark.where(pick == n).select(F.col(item).cast("bigint"), F.col(item_text)).collect()  # at most about slice_bytes
        docs = scan(docs, [tuple(r) for r in items], width, text, shard_bytes)
    return docs


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def cut(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the spans taken out of their texts; texts without spans, nulls too, stay as they are."""
    C.prepare(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [without_spans(t.encode(), s).decode() if t and s else t for t, s in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist())]
            yield from C.replace_columns(pa.Table.from_batches([batch]), **{text: pa.array(kept, pa.string())}).to_batches()

    return found.mapInArrow(run, found.schema)
