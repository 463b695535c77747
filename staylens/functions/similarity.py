"""Token-set similarity of two titles, after its published definition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of `a`."""
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        u = row & positions.get(ch, 0)
        row = ((row + u) | (row - u)) & mask
    return len(a) - row.bit_count()


def token_set_ratio(a: str | None, b: str | None) -> float:
    """0..100: 100 when one token set contains the other, else the best of the normalised insert/delete similarities
    between the shared tokens and the shared tokens followed by each side's own."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    shared, only_l, only_r = left & right, left - right, right - left
    if shared and (not only_l or not only_r):
        return 100.0
    s, l, r = (" ".join(sorted(x)) for x in (shared, only_l, only_r))
    gap = 1 if s else 0
    len_l, len_r = len(s) + gap + len(l), len(s) + gap + len(r)
    distance = len(l) + len(r) - 2 * _common_subsequence(l, r)
    best = 100.0 * (1 - distance / (len_l + len_r))
    if s:
        best = max(best, 100.0 * (1 - (gap + len(l)) / (len(s) + len_l)), 100.0 * (1 - (gap + len(r)) / (len(s) + len_r)))
    return best


# --- columns ---------------------------------------------------------------------------------------------------------
CELLS = 1 << 22


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs at once: the bit-parallel recurrence over words of 64 bits, a step for each
    place of the second texts. Pairs are taken by length, in groups of at most `CELLS` cells, so a long text does not widen the others."""
    out = np.zeros(len(a), np.int32)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(size[order[end]]) <= CELLS:
            end += 1
        which = order[at:end]
        out[which] = _subsequences(*(_letters([t[i] for i in which]) for t in (a, b)))
        at = end
    return out


def _letters(texts: list[str]) -> np.ndarray:
    """Code points as a matrix, zero behind the end of a text."""
    wide = np.array(texts, dtype=np.str_)
    return wide.view(np.uint32).reshape(len(texts), -1) if wide.dtype.itemsize else np.zeros((len(texts), 0), np.uint32)


def _subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    words = -(-a.shape[1] // 64)
    padded = np.zeros((len(a), words * 64), np.uint32)
    padded[:, : a.shape[1]] = a
    inside = np.packbits(padded != 0, axis=1, bitorder="little").view(np.uint64)
    row = inside.copy()
    for letter in b.T:
        same = np.packbits((padded == letter[:, None]) & (letter[:, None] != 0), axis=1, bitorder="little").view(np.uint64)
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            u = row[:, w] & same[:, w]
            plus = row[:, w] + u
            total = plus + carry
            carry = ((plus < u) | (total < plus)).astype(np.uint64)
            row[:, w] = (total | (row[:, w] & ~u)) & inside[:, w]
    return (np.bitwise_count(inside).astype(np.int32) - np.bitwise_count(row).astype(np.int32)).sum(axis=1)


@F.pandas_udf(T.IntegerType())
def _subsequence_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(common_subsequences(a.fillna("").tolist(), b.fillna("").tolist()), dtype="int32")


def token_parts(a: Column, b: Column) -> Column:
    """Struct of the shared tokens and of each side's own, sorted and joined, and the number of tokens of each side."""
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.coalesce(c, F.lit("")), "(?U)[\\s\\x1c-\\x1f]+"), ""))
    joined = lambda x: F.array_join(F.sort_array(x), " ")
    left, right = tokens(a), tokens(b)
    return F.struct(
        joined(F.array_intersect(left, right)).alias("s"), joined(F.array_except(left, right)).alias("l"), joined(F.array_except(right, left)).alias("r"),
        F.size(left).alias("n"), F.size(right).alias("m"))


def _ratio(p: Column, common: Column) -> Column:
    s, l, r = (F.length(p[x]) for x in "slr")
    gap = F.when(s > 0, 1).otherwise(0)
    len_l, len_r = s + gap + l, s + gap + r
    whole = 100.0 * (1 - (l + r - 2 * common) / (len_l + len_r))
    best = F.when(s > 0, F.greatest(whole, 100.0 * (1 - (gap + l) / (s + len_l)), 100.0 * (1 - (gap + r) / (s + len_r)))).otherwise(whole)
    return F.when((p["n"] == 0) | (p["m"] == 0), 0.0).when((s > 0) & ((l == 0) | (r == 0)), 100.0).otherwise(best)


def highest_ratio(p: Column) -> Column:
    """What the ratio of `token_parts` can be at most, from lengths alone: no more letters can be common than the shorter side has."""
    return _ratio(p, F.least(F.length(p["l"]), F.length(p["r"])))


def parts_ratio(p: Column) -> Column:
    return _ratio(p, _subsequence_udf(p["l"], p["r"]))


def token_set_ratio_column(a: Column, b: Column) -> Column:
    """UD-02: the sets are built-in functions, only the common subsequence leaves the JVM, a batch at a time."""
    return parts_ratio(token_parts(a, b))
