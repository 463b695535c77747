"""Exact substring removal by suffix arrays.

Every byte covered by a string of `width` bytes that also starts earlier (smaller id, or same id and earlier start) goes.
Documents are dealt to shards of about half a megabyte.

1. Per shard: a suffix array over all bytes by Larsson-Sadakane refinement (only groups that are still tied are sorted
   again, with doubled depth), Kasai's common prefixes between neighbours, and from them the strings that repeat inside
   the shard.
2. Across shards: each shard cuts out content-defined anchors, k-grams that are the least of some string of `width` bytes
   by a hash, so equal strings carry an equal anchor at the same place. It sends one entry for each anchor and context,
   sorted by hash. A merge task takes one range of hashes and merges the sorted runs of all shards by binary search.
   Anchors that only one shard holds are done. Equal contexts (anchor and all strings of `width` bytes around it) repeat as
   a whole.
3. Where an anchor has several contexts, the first text of each goes to a merge task, which sorts these texts by a suffix
   array as in 1 and compares the common prefixes with `width`. An anchor with very many contexts sends the single
   strings instead, dealt by their own hash, so no anchor fills a task.

Nulls are empty texts; texts shorter than `width` keep all bytes; rows with one id count as one place in the order (a
string at the same start of both is not earlier), a null id comes last; equal rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C

SHARD_BYTES = 1 << 19
HOT_CONTEXTS = 2048
RUNS = (np.int32, np.int64, np.int64)


def suffix_order(text: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Larsson-Sadakane: the `n` suffixes by at least `depth` symbols of `text`, which has that many zero bytes behind.
    Returns the suffixes that shared at least half of the depth with a neighbour, in order, and a mask of those that share
    it with the one before; all others have no equal."""
    bits = max(1, n.bit_length())
    used = np.flatnonzero(np.bincount(text[:n], minlength=256) > 0)
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    wide = int(len(used)).bit_length()
    first = max(1, (64 - bits) // wide)
    symbol = code[text[: n + first]]
    key, at = symbol[:n], 1
    while at < first:  # the key of twice the symbols from two shorter keys
        step = min(at, first - at)
        tail = key if step == at else symbol[:n]
        if step != at:
            for i in range(1, step):
                tail = (tail << np.uint64(wide)) | symbol[i : i + n]
        moved = np.zeros(n, np.uint64)
        moved[: n - at] = tail[at:]
        key = (key << np.uint64(wide * step)) | moved
        at += step
    key = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    member = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    key >>= np.uint64(bits)
    new = C.first_of_run(key)
    where = np.arange(n, dtype=np.uint32)
    rank = np.zeros(n + depth + 8, np.uint32)
    rank[member] = np.maximum.accumulate(np.where(new, where, np.uint32(0)))
    reached = first
    while True:
        tied = ~(new & np.append(new[1:], True))
        member, where, new = member[tied], where[tied], new[tied]
        if 2 * reached >= depth or not len(member):
            break
        member, new = refine(rank, member, where, reached, bits)
        reached *= 2
    if not len(member):
        return member, np.zeros(0, bool), rank
    joined = ~new
    member, _ = refine(rank, member, where, reached, bits)
    return member, joined, rank


def refine(rank: np.ndarray, member: np.ndarray, where: np.ndarray, reached: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the tied suffixes again by the rank `reached` symbols further on. `where`: their places in the array."""
    a, b = rank[member].astype(np.uint64), rank[member + reached].astype(np.uint64)
    if 3 * bits <= 64:
        key = np.sort((((a << np.uint64(bits)) | b) << np.uint64(bits)) | member.astype(np.uint64))
        member = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        key >>= np.uint64(bits)
    else:
        order = np.lexsort((b, a))
        member = member[order]
        key = (a[order] << np.uint64(32)) | b[order]
    new = C.first_of_run(key)
    rank[member] = np.maximum.accumulate(np.where(new, where, np.uint32(0)))
    return member, new


LANE = 128


def kasai(text: np.ndarray, position: np.ndarray, before: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to `cap`, of the suffixes at `position` (ascending) and their neighbours `before` in the suffix
    array. Kasai's step, a prefix shrinks by at most one from a position to the next, runs in lanes of consecutive
    positions that advance together."""
    n = len(position)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    head = np.concatenate(([True], np.diff(position) != 1))
    lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    head |= (np.arange(n) - lead) % LANE == 0
    at = np.flatnonzero(head)
    stop = np.append(at[1:], n)
    length = np.zeros(len(at), np.int64)
    end = len(text)
    wide = np.lib.stride_tricks.sliding_window_view(text, 8)
    while len(at):
        p, q = position[at] + length, before[at] + length
        ok = np.maximum(p, q) < end
        same = ok & (text[np.minimum(p, end - 1)] == text[np.minimum(q, end - 1)]) & (length < cap)
        jump = same & (length + 8 <= cap) & (np.maximum(p, q) + 8 <= end)
        if jump.any():
            i = np.flatnonzero(jump)
            whole = (wide[p[i]] == wide[q[i]]).all(axis=1)
            length[i[whole]] += 7
        length += same
        done = ~same
        out[at[done]] = length[done]
        at = at + done
        length = np.where(done, np.maximum(length - 1, 0), length)
        live = at < stop
        if not live.all():
            at, stop, length = at[live], stop[live], length[live]
    return out


def repeats(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    """Positions of the strings of `width` bytes, within one text each, that also start earlier. `data` has padding of
    2 * width bytes; a text's strings start at (rank, shift + offset in the text)."""
    n = int(offsets[-1])
    if n < width:
        return np.zeros(0, np.int64)
    sa, joined, _ = suffix_order(data, n, width)
    if len(sa) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(joined)
    later, before = sa[at], np.zeros(n, np.int64)
    before[later] = sa[at - 1]
    ascending = np.zeros(n, bool)
    ascending[later] = True
    ascending = np.flatnonzero(ascending)
    prefix = np.zeros(n, np.int32)
    prefix[ascending] = kasai(data[: n + width], ascending, before[ascending], width)
    joined[at] = prefix[later] >= width
    member = joined | np.append(joined[1:], False)
    sa, joined = sa[member], joined[member]
    if not len(sa):
        return sa
    text = np.searchsorted(offsets, sa, side="right") - 1
    key = np.where(sa + width <= offsets[text + 1], (rank[text] << np.int64(40)) + shift[text] + sa - offsets[text], np.int64(-1))
    head = np.flatnonzero(~joined)
    least = np.minimum.reduceat(np.where(key < 0, np.iinfo(np.int64).max, key), head)
    return sa[key > np.repeat(least, np.diff(np.append(head, len(sa))))]


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of the k-grams that are the leftmost least of some string of
    `width` bytes within one text."""
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64)
    bits = n.bit_length()
    rolling = C.Rolling(data[:n], 0x5851F42D4C957F2D)
    at = np.arange(n - gram + 1)
    value = C.mix(rolling.of(at, at + gram))
    low = (value >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    span, least = 1, low
    count = width - gram + 1
    while 2 * span <= count:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = count - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    last = np.repeat(offsets[1:], np.diff(offsets)) - width
    whole = np.flatnonzero(np.arange(n - width + 1) <= last[: n - width + 1])
    chosen = least[whole]
    chosen = (chosen[C.first_of_run(chosen)] & np.uint64((1 << bits) - 1)).astype(np.int64)
    chosen = chosen[C.first_of_run(chosen)]
    # chosen hashes are small; mixed again they spread over all ranges
    return np.searchsorted(offsets, chosen, side="right") - 1, chosen, C.mix(value[chosen], 7)


def gram_of(width: int) -> int:
    """Length of anchors: long enough to be rare, short enough that few are needed."""
    return max(1, 2 * width // 5)


class Shard:
    """A bundle's texts and what it sends: recomputed alike in each pass."""

    def __init__(self, table: pa.Table, width: int, id: str, text: str):
        self.rows = C.ordered(table, id, text)
        self.data, self.offsets = C.flat(self.rows.column(text), 2 * width)
        ids = self.rows.column(id)
        self.ids = np.array([np.iinfo(np.int64).max if v is None else v for v in ids.to_pylist()], np.int64)
        self.width, self.gram = width, gram_of(width)

    def entries(self):
        """Anchors of the shard by hash and context, one (the earliest) for each."""
        text, at, value = anchors(self.data, self.offsets, self.width, self.gram)
        start, end = self.context(text, at)
        context = C.Rolling(self.data[: self.offsets[-1]], 0x2545F4914F6CDD1D)
        with np.errstate(over="ignore"):
            around = C.mix(context.of(start, end) + (at - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - at).astype(np.uint64))
        order = np.lexsort((at - self.offsets[text], self.ids[text], around, value))
        order = order[C.first_of_run(value[order]) | C.first_of_run(around[order])]
        return tuple(x[order] for x in (text, at, value, around))

    def context(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of all strings of `width` bytes that hold the anchor, inside its text."""
        return np.maximum(self.offsets[text], at + self.gram - self.width), np.minimum(self.offsets[text + 1], at + self.width)

    def marked(self, blobs: list[bytes]) -> np.ndarray:
        """Bytes inside any of the runs."""
        found = [C.unpack(blob, *RUNS) for blob in blobs]
        t, lo, hi = (np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate(RUNS))
        return C.covered(int(self.offsets[-1]), self.offsets[t] + lo, self.offsets[t] + hi)

    def split(self, mask: np.ndarray) -> bytes:
        """Runs of removed bytes as (ordinal, start, end); a run ends with its text."""
        text_start = np.zeros(len(mask), bool)
        inner = self.offsets[1:-1]
        text_start[inner[inner < len(mask)]] = True
        start, end = C.runs(mask)
        cut = np.flatnonzero(mask & text_start)  # texts that touch: cut the run there
        start, end = np.union1d(start, cut), np.union1d(end, cut[mask[cut - 1]] if len(cut) else cut)
        text = np.searchsorted(self.offsets, start, side="right") - 1
        return C.pack(text.astype(np.int32), (start - self.offsets[text]).astype(np.int64), (end - self.offsets[text]).astype(np.int64))


def merge_sorted(runs: list[np.ndarray]) -> np.ndarray:
    """Order that merges sorted runs laid end to end: pairs of runs are merged by binary search, level by level."""
    base = np.cumsum([0] + [len(r) for r in runs])
    level = [(r, np.arange(b, b + len(r))) for r, b in zip(runs, base)]
    while len(level) > 1:
        level.sort(key=lambda x: len(x[0]))
        merged = []
        for i in range(0, len(level) - 1, 2):
            (x, ix), (y, iy) = level[i], level[i + 1]
            at = np.searchsorted(y, x, side="left") + np.arange(len(x))
            value, index = np.empty(len(x) + len(y), x.dtype), np.empty(len(x) + len(y), np.int64)
            rest = np.ones(len(value), bool)
            rest[at] = False
            value[at], index[at], value[rest], index[rest] = x, ix, y, iy
            merged.append((value, index))
        level = merged + ([level[-1]] if len(level) % 2 else [])
    return level[0][1] if level else np.zeros(0, np.int64)


def removal(docs: DataFrame, width: int = 100, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """The columns of `docs` and `n_bytes`, `n_removed`, `n_spans`, `spans` (byte ranges), `kept` (binary)."""
    dealt, shards = C.bundled(docs, shard_bytes, id, text)
    blocks = max(min(shards, 32), shards // 16)

    def local(table: pa.Table) -> pa.Table:
        bundle = table.column(C.BUNDLE)[0].as_py()
        shard = Shard(table, width, id, text)
        rank = np.unique(shard.ids, return_inverse=True)[1].astype(np.int64)
        start = repeats(shard.data, shard.offsets, rank, np.zeros(len(rank), np.int64), width)
        out = []
        if len(start):
            out.append((bundle % blocks, -1 - bundle, shard.split(C.covered(int(shard.offsets[-1]), start, start + width))))
        text_of, at, value, around = shard.entries()
        for block, lo, hi in zip(*C.by_block(value, blocks)):
            who = text_of[lo:hi]
            out.append((int(block), bundle, C.pack(value[lo:hi], around[lo:hi], shard.ids[who], (at[lo:hi] - shard.offsets[who]).astype(np.int64), who.astype(np.int32))))
        return C.messages(out)

    def merge(table: pa.Table) -> pa.Table:
        """Status of each entry: 1 the context occurs earlier, 2 one of several contexts, 3 the same with very many."""
        out, runs, owner = [], [], []
        for block, bundle, blob in C.entries(table):
            if bundle < 0:
                out.append((-1, -1 - bundle, blob))
            else:
                runs.append(C.unpack(blob, np.uint64, np.uint64, np.int64, np.int64, np.int32))
                owner.append((block, bundle))
        if runs:
            order = merge_sorted([r[0] for r in runs])
            value, around, doc, at, ordinal = (np.concatenate([r[i] for r in runs]) for i in range(5))
            sizes = np.array([len(r[0]) for r in runs])
            source = np.repeat(np.arange(len(runs)), sizes)
            status = np.zeros(len(value), np.uint8)
            head = np.flatnonzero(C.first_of_run(value[order]))
            length = np.diff(np.append(head, len(order)))
            keep = order[np.repeat(length > 1, length)]
            order = keep[np.lexsort((at[keep], doc[keep], around[keep], value[keep]))]
            new_value, new_context = C.first_of_run(value[order]), C.first_of_run(around[order])
            new_context |= new_value
            group, context = np.cumsum(new_value) - 1, np.cumsum(new_context) - 1
            lead = order[np.flatnonzero(new_context)][context]
            status[order[(doc[order] > doc[lead]) | (doc[order] == doc[lead]) & (at[order] > at[lead])]] = 1
            contexts = np.bincount(group, new_context)
            if len(order):
                span = np.flatnonzero(new_value)
                several = (contexts > 1) & (np.maximum.reduceat(source[order], span) > np.minimum.reduceat(source[order], span))
                first = new_context & several[group]
                status[order[first]] = np.where(contexts[group[first]] > hot_contexts, 3, 2)
            cut = np.append(0, np.cumsum(sizes))
            for (block, bundle), lo, hi in zip(owner, cut, cut[1:]):
                marked = lo + np.flatnonzero(status[lo:hi])
                if len(marked):
                    out.append((block, bundle, C.pack(*(x[marked] for x in (status, ordinal, at, value)))))
        return C.messages(out)

    def contexts(key, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs_table.num_rows or not replies.num_rows:
            return C.messages([])
        bundle = key[0].as_py()
        shard = Shard(docs_table, width, id, text)
        n = int(shard.offsets[-1])
        gone = shard.marked([blob for block, _, blob in C.entries(replies) if block < 0])
        marked = [C.unpack(blob, np.uint8, np.int32, np.int64, np.uint64) for block, _, blob in C.entries(replies) if block >= 0]
        status, text_of, at, value = (np.concatenate([m[i] for m in marked]) if marked else np.zeros(0, t) for i, t in enumerate((np.uint8, np.int32, np.int64, np.uint64)))
        at = at + shard.offsets[text_of]
        start, end = shard.context(text_of, at)
        whole = status == 1
        gone |= C.covered(n, start[whole], end[whole])
        out = [(bundle % blocks, -1 - bundle, shard.split(gone))] if gone.any() else []
        few, many = np.flatnonzero(status == 2), np.flatnonzero(status == 3)
        first, last, route = start[few], end[few], value[few]
        if len(many):
            count = end[many] - start[many] - width + 1
            single = np.repeat(start[many] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            single = C.distinct(single)
            hashed = C.mix(C.Rolling(shard.data[:n], 0x5851F42D4C957F2D).of(single, single + width))
            first, last, route = np.append(first, single), np.append(last, single + width), np.append(route, hashed)
        by = np.argsort(route, kind="stable")
        first, last, route = first[by], last[by], route[by]
        owner = np.searchsorted(shard.offsets, first, side="right") - 1
        for block, lo, hi in zip(*C.by_block(route, blocks)):
            head = C.pack(route[lo:hi], shard.ids[owner[lo:hi]], owner[lo:hi].astype(np.int32), first[lo:hi] - shard.offsets[owner[lo:hi]], (last[lo:hi] - first[lo:hi]).astype(np.int32))
            out.append((int(block), bundle, head + b"".join(shard.data[i:j].tobytes() for i, j in zip(first[lo:hi], last[lo:hi]))))
        return C.messages(out)

    def compare(table: pa.Table) -> pa.Table:
        """Texts of one anchor meet in one suffix array, of about a shard's size."""
        out, got, texts, bundles = [], [], [], []
        for _, bundle, blob in C.entries(table):
            if bundle < 0:
                out.append((-1, -1 - bundle, blob))
                continue
            got.append(C.unpack(blob, np.uint64, np.int64, np.int32, np.int64, np.int32))
            texts.append(blob[len(blob) - int(got[-1][4].sum()) :])
            bundles.append(np.full(len(got[-1][0]), bundle))
        if got:
            route, doc, ordinal, at, size = (np.concatenate([g[i] for g in got]) for i in range(5))
            joined, begins, owner = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum(size)), np.concatenate(bundles)
            rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)
            order = np.argsort(route, kind="stable")
            head = np.flatnonzero(C.first_of_run(route[order]))
            part = np.append(0, np.cumsum(size[order], dtype=np.int64))[head] // shard_bytes
            cut = head[C.first_of_run(part)]
            who, start = [], []
            for lo, hi in zip(cut, np.append(cut[1:], len(order))):
                chosen = order[lo:hi]
                offsets = np.append(0, np.cumsum(size[chosen], dtype=np.int64))
                data = np.zeros(offsets[-1] + 2 * width, np.uint8)
                data[: offsets[-1]] = joined[np.repeat(begins[chosen] - offsets[:-1], size[chosen]) + np.arange(offsets[-1])]
                found = repeats(data, offsets, rank[chosen], at[chosen], width)
                text_of = np.searchsorted(offsets, found, side="right") - 1
                who.append(chosen[text_of])
                start.append(at[chosen[text_of]] + found - offsets[text_of])
            who, start = np.concatenate(who), np.concatenate(start)
            by = np.lexsort((start, ordinal[who], owner[who]))
            who, start = who[by], start[by]
            cut = np.flatnonzero(C.first_of_run(owner[who]))
            for lo, hi in zip(cut, np.append(cut[1:], len(who))):
                text_of, b = ordinal[who[lo:hi]], start[lo:hi]
                step = b - np.arange(len(b))
                head = np.flatnonzero(C.first_of_run(text_of) | C.first_of_run(step))  # consecutive starts are one run
                tail = np.append(head[1:], len(b)) - 1
                out.append((-1, int(owner[who[lo]]), C.pack(text_of[head], b[head], b[tail] + width)))
        return C.messages(out)

    def finish(key, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        shard = Shard(docs_table, width, id, text)
        gone = shard.marked([blob for _, _, blob in C.entries(replies)])
        spans, kept, removed = [], [], []
        for lo, hi in zip(shard.offsets, shard.offsets[1:]):
            own = gone[lo:hi]
            start, end = C.runs(own)
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
            removed.append(int((end - start).sum()))
            kept.append(shard.data[lo:hi][~own].tobytes())
        C.trim()
        return C.replace_columns(
            shard.rows,
            n_bytes=pa.array(np.diff(shard.offsets), pa.int64()),
            n_removed=pa.array(removed, pa.int64()),
            n_spans=pa.array([len(s) for s in spans], pa.int64()),
            spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            kept=pa.array(kept, pa.binary()),
        )

    schema = C.schema_with(docs, n_bytes="bigint", n_removed="bigint", n_spans="bigint", spans="array<struct<start:bigint,end:bigint>>", kept="binary")
    by_bundle = dealt.groupBy(F.col(C.BUNDLE).alias("bundle"))
    merged = by_bundle.applyInArrow(local, C.MESSAGE).groupBy("block").applyInArrow(merge, C.MESSAGE)
    asked = by_bundle.cogroup(merged.groupBy("bundle")).applyInArrow(contexts, C.MESSAGE)
    found = asked.groupBy("block").applyInArrow(compare, C.MESSAGE)
    return by_bundle.cogroup(found.groupBy("bundle")).applyInArrow(finish, schema)


def brute(docs: list[tuple[int, bytes]], width: int) -> list[tuple[int, bytes, int]]:
    """Plain check for tests: (id, kept bytes, spans) of each document."""
    first: dict[bytes, tuple[int, int]] = {}
    for id, data in docs:
        for i in range(len(data) - width + 1):
            at = (id, i)
            if at < first.get(data[i : i + width], (2**63, 0)):
                first[data[i : i + width]] = at
    out = []
    for id, data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if first[data[i : i + width]] < (id, i):
                gone[i : i + width] = b"\1" * width
        spans = bytes(gone).count(b"\1", 0, 1) + bytes(gone).count(b"\0\1")
        out.append((id, bytes(b for b, g in zip(data, gone) if not g), spans))
    return out
