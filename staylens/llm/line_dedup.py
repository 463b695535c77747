"""Near-duplicate lines by deletion neighbourhoods; the earliest stays.

A line is the words between two newlines; each character of a script that is written without spaces (Han, kana, Thai, Lao,
Burmese, Khmer) is a word of its own. Lines of fewer than `min_words` words are never removed (1: all with a word are judged). A line goes if the same words
form an earlier line (smaller id, or same id and earlier line), or if both have `fuzzy_words` words or more and differ by one edit: a
word put in, left out or replaced, which covers any edit inside one word. Lines are judged on the input, not on what is
left.

1. Equal lines: each bundle sends its distinct lines by hash (96 bits), and hears which begin earlier elsewhere.
2. First copies emit all variants within the edit bound as hashed keys: the line itself, and the line without each of its
   words. So that only shared keys travel in full, each bundle first sends the low bits of its keys, sorted and delta
   coded, and gets back which of them two lines share. Bits may only collide, so no shared key is lost.
3. Shared keys are joined. A key without the same word position holds lines that replace one word by another; a whole line
   that equals a key is that line with one word less. Every line needs its earliest neighbour alone, so a bundle sends one
   entry (its earliest line) for a key and position, and no pairs are formed, however many lines share a template.
4. The edit distance to that neighbour is verified on the words, and lines are removed.

Nulls and empty texts have no lines to remove; rows that share an id are one place in the order; a null id comes last; equal
rows get equal results. A text that loses all its words keeps its empty remainder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C

BUNDLE_BYTES, MIN_WORDS, FUZZY_WORDS = 1 << 20, 5, 10
BASE = 0x5851F42D4C957F2D
LENGTH = np.uint64(0xD6E8FEB86659FD93)


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of the characters of scripts without spaces, as the lengths of the characters, else 0."""
    out = np.zeros(len(data), np.int64)
    at = np.flatnonzero(data >= 0xE0)  # E0 and above begin characters of three and four bytes
    lead, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    three = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
    three |= (lead == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
    three |= (lead == 0xE3) & (second >= 0x81) | (lead >= 0xE4) & (lead <= 0xE9)  # kana, Han
    three |= (lead == 0xEF) & (second >= 0xA4) & (second <= 0xAB)  # compatibility forms of Han
    out[at[three]] = 3
    out[at[(lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3)]] = 4  # further planes of Han
    return out


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, those of scripts without spaces cut into characters."""
    start, end, _ = C.words(data, offsets)
    size = unspaced(data)
    single = np.flatnonzero(size)
    if not len(single):
        return start, end
    # a cut lies before and behind each such character, unless the word ends there
    cut = C.distinct(np.concatenate([single, single + size[single]]))
    cut = cut[~np.isin(cut, start) & ~np.isin(cut, end)]
    return np.sort(np.append(start, cut)), np.sort(np.append(end, cut))


def words_of(line: bytes) -> list[bytes]:
    """The words of one line."""
    data = np.frombuffer(line, np.uint8)
    start, end = split_words(data, np.array([0, len(data)]))
    return [line[a:b] for a, b in zip(start.tolist(), end.tolist())]


class Lines:
    """Lines of a bundle, numbered alike in each pass."""

    def __init__(self, table: pa.Table, id: str, text: str, hashed: bool = True):
        self.rows = C.ordered(table, id, text)
        self.data, self.offsets = C.flat(self.rows.column(text))
        ids = np.array([np.iinfo(np.int64).max if v is None else v for v in self.rows.column(id).to_pylist()], np.int64)
        n = len(self.data)
        self.start, self.end = split_words(self.data, self.offsets)
        begins = np.zeros(n + 1, bool)
        begins[np.flatnonzero(self.data == 0x0A) + 1] = True
        begins[self.offsets[:-1]] = True  # the first line of a text; texts without bytes have none
        begins[n] = False
        self.line = np.flatnonzero(begins)
        self.stop = np.append(self.line[1:], n)
        self.owner = np.searchsorted(self.offsets, self.line, side="right") - 1
        self.number = np.arange(len(self.line)) - np.searchsorted(self.line, self.offsets[:-1])[self.owner]
        self.doc = ids[self.owner]
        edge = np.searchsorted(self.start, np.append(self.line, n))
        self.first, self.count = edge[:-1], np.diff(edge)
        if hashed:
            self.words = C.word_hashes(self.data, self.start, self.end)
            last = self.first + self.count
            with np.errstate(over="ignore"):
                self.rolling = C.Rolling(self.words, BASE)
                self.key = C.mix(self.rolling.of(self.first, last) + self.count.astype(np.uint64) * LENGTH)
                self.check = C.Prime(self.words).of(self.first, last).astype(np.uint32)

    def heads(self, min_words: int) -> np.ndarray:
        """First copy in the bundle of each line to judge, in order of keys."""
        at = np.flatnonzero(self.count >= min_words)
        order = at[np.lexsort((self.number[at], self.doc[at], self.check[at], self.key[at]))]
        return order[C.first_of_run(self.key[order]) | C.first_of_run(self.check[order])]

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the lines (position -1) and of the lines without each word, with line and position."""
        n, first = self.count[lines], self.first[lines]
        line, begin, size = np.repeat(lines, n), np.repeat(first, n), np.repeat(n, n)
        position = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        word, total = begin + position, self.rolling.sum
        with np.errstate(over="ignore"):
            less = (total[word] - total[begin]) + (total[begin + size] - total[word + 1]) * self.rolling.down[1]
            less = C.mix(less * self.rolling.down[begin] + (size - 1).astype(np.uint64) * LENGTH)
        return np.append(self.key[lines], less), np.append(lines, line), np.append(np.full(len(lines), -1), position)

    def text(self, line: int) -> bytes:
        return self.data[self.line[line] : self.stop[line]].tobytes()


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Word lists at an edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    return a[head + (len(a) >= len(b)) :] == b[head + (len(b) >= len(a)) :]


def removal(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The columns of `docs`, with the remaining lines as text, and `n_lines`, `n_removed`, `n_near` (removed, but not equal to an
    earlier line). A null text stays null."""
    dealt, bundles = C.bundled(docs, bundle_bytes, id, text)
    blocks = max(min(bundles, 32), bundles // 8)
    bits = min(32, max(16, (bundles * bundle_bytes // (6 * blocks)).bit_length() + 6))

    def equal(table: pa.Table) -> pa.Table:
        lines, bundle, out = Lines(table, id, text), table.column(C.BUNDLE)[0].as_py(), []
        head = lines.heads(min_words)
        for block, lo, hi in zip(*C.by_block(lines.key[head], blocks)):
            x = head[lo:hi]
            out.append((int(block), bundle, C.pack(lines.key[x], lines.check[x], lines.doc[x], lines.number[x].astype(np.int32), x.astype(np.int32))))
        return C.messages(out)

    def earliest(table: pa.Table) -> pa.Table:
        """For each bundle, the lines that also begin earlier elsewhere."""
        got = [(b, C.unpack(blob, np.uint64, np.uint32, np.int64, np.int32, np.int32)) for _, b, blob in C.entries(table)]
        key, check, doc, number, line = (np.concatenate([g[i] for _, g in got]) for i in range(5))
        bundle = np.repeat([b for b, _ in got], [len(g[0]) for _, g in got])
        order = np.lexsort((number, doc, check, key))
        head = np.flatnonzero(C.first_of_run(key[order]) | C.first_of_run(check[order]))
        lead = np.repeat(order[head], np.diff(np.append(head, len(order))))
        late = order[(doc[order] > doc[lead]) | (number[order] > number[lead]) & (doc[order] == doc[lead])]
        late = late[np.argsort(bundle[late], kind="stable")]
        cut = np.flatnonzero(C.first_of_run(bundle[late]))
        return C.messages([(-1, int(bundle[late[lo]]), C.pack(line[late[lo:hi]])) for lo, hi in zip(cut, np.append(cut[1:], len(late)))])

    def keyed(lines: Lines, late: np.ndarray):
        """Variants of the lines whose first copy is here, by block and low bits of their keys."""
        head = np.setdiff1d(lines.heads(fuzzy_words), late, assume_unique=True)
        key, line, position = lines.variants(head)
        cell = (C.block_of(key, blocks).astype(np.uint64) << np.uint64(32)) | (key & np.uint64((1 << bits) - 1))
        return key, line, position, cell

    def late_lines(replies: pa.Table) -> np.ndarray:
        own = [C.unpack(blob, np.int32)[0] for block, _, blob in C.entries(replies) if block == -1]
        return np.concatenate([np.zeros(0, np.int32), *own])

    def announce(key_, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return C.messages([])
        lines, bundle, late = Lines(docs_table, id, text), docs_table.column(C.BUNDLE)[0].as_py(), late_lines(replies)
        out = [(bundle % blocks, -1 - bundle, C.pack(late))] if len(late) else []
        cell = C.distinct(keyed(lines, late)[3])
        block = (cell >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(C.first_of_run(block))
        for lo, hi in zip(cut, np.append(cut[1:], len(cell))):
            out.append((int(block[lo]), bundle, C.pack(np.diff(cell[lo:hi].astype(np.uint32), prepend=np.uint32(0)))))
        return C.messages(out)

    def shared(table: pa.Table) -> pa.Table:
        out, got, bundle_of, block_of = [], [], [], []
        for block, bundle, blob in C.entries(table):
            if bundle < 0:
                out.append((-1, -1 - bundle, blob))
            else:
                got.append(np.cumsum(C.unpack(blob, np.uint32)[0], dtype=np.uint32))
                bundle_of.append(bundle)
                block_of.append(block)
        if got:
            value = np.sort(np.concatenate(got))
            value = value[1:][value[1:] == value[:-1]]
            for block, bundle, cell in zip(block_of, bundle_of, got):
                at = np.minimum(np.searchsorted(value, cell), max(len(value) - 1, 0))
                both = value[at] == cell if len(value) else np.zeros(len(cell), bool)
                if both.any():
                    out.append((block, bundle, C.pack(cell[both])))
        return C.messages(out)

    def offer(key_, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        """One entry for each shared key and position: the earliest line with its text, and all lines that have it."""
        if not docs_table.num_rows:
            return C.messages([])
        lines, bundle, late = Lines(docs_table, id, text), docs_table.column(C.BUNDLE)[0].as_py(), late_lines(replies)
        out = [(bundle % blocks, -1 - bundle, C.pack(late))] if len(late) else []
        key, line, position, cell = keyed(lines, late)
        wanted = [(np.uint64(block) << np.uint64(32)) | C.unpack(blob, np.uint32)[0].astype(np.uint64) for block, _, blob in C.entries(replies) if block >= 0]
        twice = np.sort(cell)
        twice = C.distinct(twice[1:][twice[1:] == twice[:-1]])
        here = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, cell), len(twice) - 1)] == cell) if len(twice) else np.zeros(0, np.int64)
        here = here[np.lexsort((line[here], cell[here]))]
        own = cell[here[C.first_of_run(cell[here]) | C.first_of_run(line[here])]]  # once for each line
        wanted = C.distinct(np.concatenate([own[1:][own[1:] == own[:-1]], *wanted]))
        if not len(wanted):
            return C.messages(out)
        at = np.minimum(np.searchsorted(wanted, cell), len(wanted) - 1)
        take = wanted[at] == cell
        key, line, position = key[take], line[take], position[take]
        order = np.lexsort((lines.number[line], lines.doc[line], position, key))
        key, line, position = key[order], line[order], position[order]
        head = np.flatnonzero(C.first_of_run(key) | C.first_of_run(position))
        size = np.diff(np.append(head, len(key)))
        for block, lo, hi in zip(*C.by_block(key[head], blocks)):
            h, s = head[lo:hi], size[lo:hi]
            leads, which = np.unique(line[h], return_inverse=True)  # a line with many of the keys sends its text once
            texts = [lines.text(i) for i in leads]
            members = line[h[0] : h[-1] + s[-1]].astype(np.int32)
            top = C.pack(key[h], position[h].astype(np.int32), lines.doc[line[h]], lines.number[line[h]].astype(np.int32), s.astype(np.int32), which.astype(np.int32))
            out.append((int(block), bundle, top + C.pack(members) + C.pack(np.array([len(t) for t in texts], np.int32)) + b"".join(texts)))
        return C.messages(out)

    def neighbours(table: pa.Table) -> pa.Table:
        """Earliest neighbour of each entry: among the entries of its key and position, and between whole lines and lines
        with one word more."""
        out, got, texts, member = [], [], [], []
        for _, bundle, blob in C.entries(table):
            if bundle < 0:
                out.append((-1, -1 - bundle, blob))
                continue
            top = C.unpack(blob, np.uint64, np.int32, np.int64, np.int32, np.int32, np.int32)
            at = 4 + 32 * len(top[0])
            members = C.unpack(blob[at:], np.int32)[0]
            at += 4 + 4 * len(members)
            lengths = C.unpack(blob[at:], np.int32)[0]
            at += 4 + 4 * len(lengths)
            edge = np.append(0, np.cumsum(lengths))
            top[5] = top[5] + len(texts)
            texts += [blob[at + a : at + b] for a, b in zip(edge, edge[1:])]
            edge = np.append(0, np.cumsum(top[4]))
            member += [members[a:b] for a, b in zip(edge, edge[1:])]
            got.append((*top, np.full(len(top[0]), bundle)))
        if not got:
            return C.messages(out)
        key, position, doc, number, size, text_of, bundle = (np.concatenate([g[i] for g in got]) for i in range(7))
        order = np.lexsort((number, doc, position, key))
        new = C.first_of_run(key[order])
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(order)))
        replies: dict[int, dict[int, tuple[int, list]]] = {}  # for each bundle and text of a neighbour, the lines near it

        def tell(entry: int, partner: int) -> None:
            near = replies.setdefault(int(bundle[entry]), {}).setdefault(int(text_of[partner]), (partner, []))
            near[1].append(member[entry])

        place = lambda e: (doc[e], number[e])
        for lo, n in zip(head, length):
            if n == 1:
                if size[order[lo]] > 1 and position[order[lo]] >= 0:
                    tell(order[lo], order[lo])
                continue
            group = order[lo : lo + n]
            whole = [e for e in group if position[e] < 0]
            less = group[len(whole) :]
            if whole and len(less):
                least = min(less, key=place)
                for e in whole:
                    if place(least) < place(e):
                        tell(e, least)
            lead = None
            for e in less:
                if lead is None or position[e] != position[lead]:
                    lead = e
                if e != lead or size[e] > 1:
                    tell(e, lead)
                if whole and place(whole[0]) < place(e):
                    tell(e, whole[0])
        for b, found in replies.items():
            lead = np.array([e for e, _ in found.values()])
            near = [C.distinct(np.concatenate(m)) for _, m in found.values()]
            sent = [texts[i] for i in found]
            top = C.pack(np.array([len(m) for m in near], np.int32), doc[lead], number[lead], np.array([len(x) for x in sent], np.int32))
            out.append((0, b, top + C.pack(np.concatenate(near)) + b"".join(sent)))
        return C.messages(out)

    def finish(key_, docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        lines, late = Lines(docs_table, id, text), late_lines(replies)
        gone, near = np.zeros(len(lines.line), bool), np.zeros(len(lines.line), bool)
        at = np.flatnonzero(lines.count >= min_words)
        order = at[np.lexsort((lines.number[at], lines.doc[at], lines.check[at], lines.key[at]))]
        head = np.flatnonzero(C.first_of_run(lines.key[order]) | C.first_of_run(lines.check[order]))
        lead = np.repeat(order[head], np.diff(np.append(head, len(order))))
        own = (lines.doc[order] > lines.doc[lead]) | (lines.doc[order] == lines.doc[lead]) & (lines.number[order] > lines.number[lead])
        gone[order[own]] = True
        elsewhere = np.zeros(len(gone), bool)
        elsewhere[late] = True
        gone[order[elsewhere[lead]]] = True
        for block, _, blob in C.entries(replies):
            if block < 0:
                continue
            size, doc, number, length = C.unpack(blob, np.int32, np.int64, np.int32, np.int32)
            start = 4 + 20 * len(size)
            members = C.unpack(blob[start:], np.int32)[0]
            start += 4 + 4 * len(members)
            edge, cut = np.append(0, np.cumsum(size)), start + np.append(0, np.cumsum(length))
            for i in range(len(size)):
                partner = words_of(blob[cut[i] : cut[i + 1]])
                for m in members[edge[i] : edge[i + 1]].tolist():
                    if (lines.doc[m], lines.number[m]) > (doc[i], number[i]) and not near[m] and one_edit(words_of(lines.text(m)), partner):
                        near[m] = True
        near[order] |= near[lead]  # rows that share the id of a first copy hold it at the same place
        near &= ~gone
        kept, n_removed, n_near = [], [], []
        edge = np.searchsorted(lines.line, lines.offsets)
        for t, lo, hi in zip(lines.rows.column(text).to_pylist(), edge, edge[1:]):
            drop = gone[lo:hi] | near[lo:hi]
            n_removed.append(int(drop.sum()))
            n_near.append(int(near[lo:hi].sum()))
            kept.append("\n".join([x for x, d in zip(t.split("\n"), drop.tolist()) if not d] + t.split("\n")[hi - lo :]) if drop.any() else t)
        C.trim()
        return C.replace_columns(
            lines.rows,
            **{text: pa.array(kept, pa.string())},
            n_lines=pa.array(np.diff(edge), pa.int64()),
            n_removed=pa.array(n_removed, pa.int64()),
            n_near=pa.array(n_near, pa.int64()),
        )

    by_bundle = dealt.groupBy(F.col(C.BUNDLE).alias("bundle"))
    known = by_bundle.applyInArrow(equal, C.MESSAGE).groupBy("block").applyInArrow(earliest, C.MESSAGE)
    announced = by_bundle.cogroup(known.groupBy("bundle")).applyInArrow(announce, C.MESSAGE)
    both = announced.groupBy("block").applyInArrow(shared, C.MESSAGE)
    offered = by_bundle.cogroup(both.groupBy("bundle")).applyInArrow(offer, C.MESSAGE)
    found = offered.groupBy("block").applyInArrow(neighbours, C.MESSAGE)
    return by_bundle.cogroup(found.groupBy("bundle")).applyInArrow(finish, C.schema_with(docs, n_lines="bigint", n_removed="bigint", n_near="bigint"))
