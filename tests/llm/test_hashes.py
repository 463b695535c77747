"""Different texts whose polynomial hashes modulo 2**64 agree for every odd base: Thue-Morse sequences and their complements."""

import numpy as np
import pytest

from staylens.llm import common as C
from staylens.llm import line_dedup, near_copies, substring_dedup


def thue_morse(n, zero, one):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [one if b else zero for b in bits], [zero if b else one for b in bits]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_of_two_letters(n):
    a, b = ("".join(x).encode() for x in thue_morse(n, "a", "b"))
    data = np.frombuffer(a + b, np.uint8)
    one, two = C.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two


def test_word_hashes_depend_on_bytes_and_length_only():
    words = [b"", b"a", b"ab", b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 17, b"b" * 5000, b"ab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = C.word_hashes(data, end - [len(w) for w in words], end)
    assert len(set(got.tolist())) == len(words) - 1 and got[2] == got[8]
    alone = C.word_hashes(np.frombuffer(b"xxab", np.uint8), np.array([2]), np.array([4]))
    assert alone[0] == got[2]


def test_prime_equals_plain_arithmetic():
    r = np.random.default_rng(2)
    symbols = r.integers(0, 2**63, 300).astype(np.uint64)
    start = r.integers(0, 150, 40)
    end = start + r.integers(0, 150, 40)
    p, small = 2**31 - 1, [int(x) >> 34 for x in C.mix(symbols, 11)]
    assert C.Prime(symbols).of(start, end).tolist() == [sum(small[i] * pow(1220703125, i - a, p) for i in range(a, b)) % p for a, b in zip(start.tolist(), end.tolist())]


@pytest.mark.parametrize("n", [1024, 2048])
def test_nothing_is_removed(spark, n):
    lines = [" ".join(x) for x in thue_morse(n, "up", "down")]
    words = ["".join(x) for x in thue_morse(n, "a", "b")]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.removal(docs, min_words=1, fuzzy_words=2).collect()] == [0, 0]
    around = [f"{' '.join(f'w{i}' for i in range(6))} {w} {' '.join(f'v{i}' for i in range(6))}" for w in words]
    docs = spark.createDataFrame(list(enumerate(around)), "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.removal(docs).collect()] == [0, 0]
    docs = spark.createDataFrame(list(enumerate(f"{w} one two three four five six" for w in words)), "doc_id long, text string")
    assert near_copies.one_of_each(docs).count() == 2
