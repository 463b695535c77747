"""Removal of repeated word windows behind a count-min sketch.

A word goes if it lies in a window of `width` words whose words also start in a document with a smaller id. Documents are dealt to
bundles.

1. Each bundle sketches its windows: per range of hash values two rows of counters, whose width follows the number of
   windows, with the number of documents that hold each window. The ranges of all bundles are added up counter by counter, and
   each bundle gets back which of its counters reach two. The least of both rows never falls below the true number of
   documents, so a window estimated below two is in one document only, and none is lost. The sketch is spread
   over the tasks by range and never sent as a whole.
2. Only windows estimated repeated are grouped exactly, by 96 bits of hash: each bundle sends one entry for each with its smallest
   id, and hears which also start in a smaller document of another bundle. A hot window costs one entry per bundle.
3. Each bundle removes words: windows seen in a smaller document of its own or of another bundle.

Nulls have no words; texts shorter than `width` words keep all; rows that share an id are one place in the order and do not
repeat each other; a null id comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C

BUNDLE_BYTES = 1 << 20
CELLS = 4  # counters per expected window, in each of two rows
BYTES_PER_WINDOW = 6


class Windows:
    """Windows of a bundle: recomputed alike in each pass."""

    def __init__(self, table: pa.Table, width: int, id: str, text: str):
        self.rows = C.ordered(table, id, text)
        self.data, self.offsets = C.flat(self.rows.column(text))
        self.start, self.end, self.first = C.words(self.data, self.offsets)
        self.ids = np.array([np.iinfo(np.int64).max if v is None else v for v in self.rows.column(id).to_pylist()], np.int64)
        hashes = C.word_hashes(self.data, self.start, self.end)
        count = np.maximum(np.diff(self.first) - width + 1, 0)
        self.at = np.repeat(self.first[:-1] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        self.doc = np.repeat(self.ids, count)  # ascending
        self.key = C.mix(C.Rolling(hashes, 0x5851F42D4C957F2D).of(self.at, self.at + width))
        self.check = C.Prime(hashes).of(self.at, self.at + width).astype(np.uint32)
        self.width = width

    def distinct(self) -> np.ndarray:
        """The first window of each key, in order of keys; ids ascend, so it has the smallest one."""
        order, head = C.grouped(self.key, self.check)
        return order[head]


def cells(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of keys in the two rows of their range's sketch."""
    mask = np.uint64(width - 1)
    return (key & mask).astype(np.uint32), (C.mix(key, 2) & mask).astype(np.uint32)


def counted(cell: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters touched, ascending, with their sums up to two. `times` are 1 or 2."""
    packed = np.sort((cell.astype(np.uint64) << np.uint64(2)) | times.astype(np.uint64))
    cell, times = packed >> np.uint64(2), (packed & np.uint64(3)).astype(np.int64)
    head = np.flatnonzero(C.first_of_run(cell))
    return cell[head], np.minimum(np.add.reduceat(times, head), 2) if len(head) else times


def removal(docs: DataFrame, width: int = 13, id: str = "doc_id", text: str = "text", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The columns of `docs` and `n_words`, `n_removed`, `kept` (kept words joined by one space)."""
    dealt, bundles = C.bundled(docs, bundle_bytes, id, text)
    blocks = max(min(bundles, 32), bundles // 8)
    row = 1 << max(10, (CELLS * bundles * bundle_bytes // (BYTES_PER_WINDOW * blocks)).bit_length() - 1)

    def places(key: np.ndarray) -> list[np.ndarray]:
        """Counters of keys in both rows, with the range of the key in front."""
        block = C.block_of(key, blocks).astype(np.uint64) << np.uint64(32)
        return [block | c.astype(np.uint64) for c in cells(key, row)]

    def sketch_of(w: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
        """Touched counters and their sums, in both rows."""
        order, new_key = C.grouped(w.key, w.check)
        fresh = new_key | C.first_of_run(w.doc[order])  # each window once per document
        head = np.flatnonzero(new_key[fresh])
        order = order[fresh]
        times = np.minimum(np.diff(np.append(head, len(order))), 2)
        return [counted(at, times) for at in places(w.key[order[head]])]

    def cuts(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = (cell >> np.uint64(32)).astype(np.int64)
        lo = np.flatnonzero(C.first_of_run(block))
        return block[lo], lo, np.append(lo[1:], len(cell)) if len(lo) else lo

    def sketch(table: pa.Table) -> pa.Table:
        bundle, parts_of = table.column(C.BUNDLE)[0].as_py(), {}
        for cell, times in sketch_of(Windows(table, width, id, text)):
            for block, lo, hi in zip(*cuts(cell)):
                parts_of.setdefault(int(block), []).append(C.pack(np.diff(cell[lo:hi].astype(np.uint32), prepend=np.uint32(0)), times[lo:hi].astype(np.uint8)))
        return C.messages((block, bundle, b"".join(p)) for block, p in parts_of.items())

    def parts(blob: bytes):
        first = C.unpack(blob, np.uint32, np.uint8)
        second = C.unpack(blob[4 + 5 * len(first[0]) :], np.uint32, np.uint8)
        return [(np.cumsum(cell, dtype=np.uint32), times) for cell, times in (first, second)]

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros((2, row), np.uint8)
        for _, _, blob in C.entries(table):
            for r, (cell, times) in enumerate(parts(blob)):
                total[r, cell] = np.minimum(total[r, cell] + times, 2)
        out = []
        for block, bundle, blob in C.entries(table):
            flags = [total[r, cell] > 1 for r, (cell, _) in enumerate(parts(blob))]
            if all(f.any() for f in flags):
                out.append((block, bundle, np.packbits(np.concatenate(flags)).tobytes()))
        return C.messages(out)

    def ask(key, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        """One entry for each window estimated repeated."""
        if not docs_table.num_rows or not replies.num_rows:
            return C.messages([])
        w = Windows(docs_table, width, id, text)
        replied = {block: np.unpackbits(np.frombuffer(blob, np.uint8)) == 1 for block, _, blob in C.entries(replies)}
        distinct, skip = w.distinct(), dict.fromkeys(replied, 0)
        chosen = np.ones(len(distinct), bool)
        for (cell, _), at in zip(sketch_of(w), places(w.key[distinct])):
            repeated = np.zeros(len(cell), bool)
            for block, lo, hi in zip(*(x.tolist() for x in cuts(cell))):
                if block in replied:
                    repeated[lo:hi] = replied[block][skip[block] : skip[block] + hi - lo]
                    skip[block] += hi - lo
            chosen &= repeated[np.searchsorted(cell, at)]
        distinct = distinct[chosen]
        out, bundle = [], docs_table.column(C.BUNDLE)[0].as_py()
        for block, lo, hi in zip(*C.by_block(w.key[distinct], blocks)):
            x = distinct[lo:hi]
            out.append((int(block), bundle, C.pack(w.key[x], w.check[x], w.doc[x], w.at[x].astype(np.int32))))
        return C.messages(out)

    def exact(table: pa.Table) -> pa.Table:
        """For each bundle, its windows that start in a smaller document elsewhere."""
        got, bundles_ = [], []
        for _, bundle, blob in C.entries(table):
            got.append(C.unpack(blob, np.uint64, np.uint32, np.int64, np.int32))
            bundles_.append(np.full(len(got[-1][0]), bundle))
        key, check, doc, at = (np.concatenate([g[i] for g in got]) for i in range(4))
        bundle = np.concatenate(bundles_)
        order = np.lexsort((check, key))
        head = np.flatnonzero(C.first_of_run(key[order]) | C.first_of_run(check[order]))
        least = np.minimum.reduceat(doc[order], head)
        later = np.sort(order[doc[order] > np.repeat(least, np.diff(np.append(head, len(order))))])
        cut = np.flatnonzero(C.first_of_run(bundle[later]))
        return C.messages([(0, int(bundle[later[lo]]), C.pack(at[later[lo:hi]])) for lo, hi in zip(cut, np.append(cut[1:], len(later)))])

    def finish(key, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        w = Windows(docs_table, width, id, text)
        elsewhere = np.zeros(len(w.start), bool)
        for _, _, blob in C.entries(replies):
            elsewhere[C.unpack(blob, np.int32)[0]] = True
        order, new = C.grouped(w.key, w.check)
        head = np.flatnonzero(new)
        first = np.repeat(order[head], np.diff(np.append(head, len(order))))
        gone = order[elsewhere[w.at[first]] | (w.doc[order] > w.doc[first])]
        drop = C.covered(len(w.start), w.at[gone], w.at[gone] + width)
        kept = []
        for t, lo, hi in zip(w.rows.column(text).to_pylist(), w.first, w.first[1:]):
            words = (t or "").encode().split()
            own = drop[lo:hi]
            kept.append(b" ".join([x for x, d in zip(words, own.tolist()) if not d] if own.any() else words))
        C.trim()
        removed = np.append(0, np.cumsum(drop))
        return C.replace_columns(
            w.rows,
            n_words=pa.array(np.diff(w.first), pa.int64()),
            n_removed=pa.array(removed[w.first[1:]] - removed[w.first[:-1]], pa.int64()),
            kept=pa.array(kept, pa.binary()).cast(pa.string()),
        )

    by_bundle = dealt.groupBy(F.col(C.BUNDLE).alias("bundle"))
    repeated = by_bundle.applyInArrow(sketch, C.MESSAGE).groupBy("block").applyInArrow(merge, C.MESSAGE)
    asked = by_bundle.cogroup(repeated.groupBy("bundle")).applyInArrow(ask, C.MESSAGE)
    found = asked.groupBy("block").applyInArrow(exact, C.MESSAGE)
    return by_bundle.cogroup(found.groupBy("bundle")).applyInArrow(finish, C.schema_with(docs, n_words="bigint", n_removed="bigint", kept="string"))
