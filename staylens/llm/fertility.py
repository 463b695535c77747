"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated windows of words. Fertility looks at each word with two public
vocabularies: pieces with byte fallback, and byte-level ranks. Per text: characters per token of both, the share of
byte-fallback tokens, and the entropy of the pieces. Bands are the quartiles of the language's texts that pass the base rules
and have `MIN_TOKENS` tokens, widened by a multiple of their distance, computed over all documents (a quantile sketch). A text is
rejected if the base rules reject it, if one measure lies outside the wide band (`WIDE`), or if characters per token and
entropy both fall below their narrow ones (`LOW_CHARS`, `LOW_ENTROPY`): junk of few, badly covered words. Languages with fewer than `MIN_TEXTS` such texts, and a null language, take the bands of all texts. Texts with fewer than `MIN_TOKENS` tokens have
no stable measures and are judged by the base rules alone.

Nulls and empty texts have no words and fail the base rules. Equal rows get equal verdicts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C
from staylens.session import materialise

REMEMBERED, MIN_TOKENS, MIN_TEXTS, MAX_BANDS = 100_000, 200, 30, 10_000
WIDE, LOW_CHARS, LOW_ENTROPY = 6.0, 3.0, 1.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("piece_chars", "byte_chars", "fallback_share", "entropy")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Vocabularies:
    """Ids of a word's pieces behind its negative number of byte-level tokens; remembers frequent words."""

    _made: dict[tuple, Vocabularies] = {}

    def __init__(self, pieces: bytes, ranks: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, shared) -> Vocabularies:
        if shared.value not in cls._made:
            cls._made[shared.value] = cls(*shared.value)
        return cls._made[shared.value]

    def learn(self, words: list[bytes]) -> None:
        count, read = self.ranks.encode_ordinary, [w.decode() for w in words]
        for w, t, ids in zip(words, read, self.pieces.encode(read, num_threads=1)):
            self.known[w] = np.array([-len(count(" " + t)), *ids], np.int32).tobytes()

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        distinct = {w for words in texts for w in words}
        missing = distinct.difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, missing = {}, distinct
        self.learn(list(missing))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in texts]


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each text inside windows that occur twice or more in it."""
    texts = len(first) - 1
    count = np.maximum(np.diff(first) - width + 1, 0)
    at = np.repeat(first[:-1] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    key, doc = C.Rolling(hashes, 0x5851F42D4C957F2D).of(at, at + width), np.repeat(np.arange(texts), count)
    order = np.lexsort((key, doc))
    head = C.first_of_run(key[order]) | C.first_of_run(doc[order])
    single = head & np.append(head[1:], True)
    hit = at[order[~single]]
    cover = np.append(0, np.cumsum(C.covered(len(hashes), hit, hit + width)))
    return cover[first[1:]] - cover[first[:-1]]


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            again += line in seen
            seen.add(line)
    return again


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def measures(column: pa.Array, vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    data, offsets = C.flat(column)
    start, end, first = C.words(data, offsets)
    texts = [t or "" for t in column.to_pylist()]
    point = (data & 0xC0 != 0x80) & ~C.WHITE[data]
    out = {
        "n_words": np.diff(first),
        "word_chars": per_text(point, offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(C.word_hashes(data, start, end), first),
    }
    n = len(texts)
    ids = vocabularies.ids([(t.encode()).split() for t in texts])
    doc, ids = np.repeat(np.arange(n), [len(x) for x in ids]), np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int64)
    byte_tokens = -np.bincount(doc[ids < 0], ids[ids < 0], n)
    doc, ids = doc[ids >= 0], ids[ids >= 0]
    tokens = np.bincount(doc, minlength=n)
    fallback = np.bincount(doc[vocabularies.bytes[ids]], minlength=n) / np.maximum(tokens, 1)
    key = np.sort(doc << 32 | ids)
    head = np.flatnonzero(C.first_of_run(key))
    times, owner = np.diff(np.append(head, len(key))), key[head] >> 32
    share = times / tokens[owner]
    entropy = np.bincount(owner, -share * np.log2(share), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out |= {"n_tokens": tokens, "piece_chars": out["word_chars"] / tokens, "byte_chars": out["word_chars"] / byte_tokens, "fallback_share": fallback, "entropy": entropy}
    for name in ("piece_chars", "byte_chars"):
        out[name][tokens == 0] = 0.0
    return out


def measured(docs: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of `docs` and the counts and measures of each text. `pieces` and `ranks`: vocabulary files of fixed size."""
    C.prepare(docs)
    content = []
    for path in (pieces, ranks):
        with open(path, "rb") as f:
            content.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast((*content, pattern))
    types = dict.fromkeys((*COUNTS, "n_tokens"), "bigint") | dict.fromkeys(MEASURES, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies.of(shared)
        try:
            for batch in batches:
                found = measures(batch.column(text), vocabularies)
                yield from C.replace_columns(pa.Table.from_batches([batch]), **{k: pa.array(found[k], pa.int64() if t == "bigint" else pa.float64()) for k, t in types.items()}).to_batches()
        finally:  # a worker goes on to other stages
            Vocabularies._made.clear()
            del vocabularies
            C.trim()

    return docs.mapInArrow(run, C.schema_with(docs, **types))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(found: DataFrame, lang: str = "lang") -> DataFrame:
    """The columns of `found` (of `measured`) and base_failed, kept."""
    steady = found.where(~base_failed() & (F.col("n_tokens") >= MIN_TOKENS))
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(m) for m in MEASURES]
    bands = steady.groupBy(lang).agg(F.count(F.lit(1)).alias("texts"), *quartiles).where((F.col("texts") >= MIN_TEXTS) & F.col(lang).isNotNull())
    every = steady.agg(F.struct(*quartiles).alias("every"))
    bands = materialise(bands.select(F.col(lang).alias("__lang"), F.struct(*MEASURES).alias("own")))
    if bands.count() <= MAX_BANDS:  # one row a language; more than so many are joined by a shuffle
        bands = F.broadcast(bands)
    joined = found.join(F.broadcast(every)).join(bands, F.col(lang) == F.col("__lang"), "left")
    off = {}  # distance from the quartiles in units of theirs, negative below
    for m in MEASURES:
        low, middle, high = (F.coalesce(F.col("own")[m], F.col("every")[m])[i] for i in range(3))
        unit = F.greatest(high - low, F.lit(0.02) * middle, F.lit(0.01))
        off[m] = F.coalesce(F.when(F.col(m) < low, (F.col(m) - low) / unit).when(F.col(m) > high, (F.col(m) - high) / unit), F.lit(0.0))
    wide = reduce(lambda a, b: a | b, [F.abs(off[m]) > WIDE for m in MEASURES])
    poor = (F.least(off["piece_chars"], off["byte_chars"]) < -LOW_CHARS) & (off["entropy"] < -LOW_ENTROPY)
    verdict = ~base_failed() & ((F.col("n_tokens") < MIN_TOKENS) | ~(wide | poor))
    return joined.select(*[F.col(f"`{c}`") for c in found.columns if c not in ("base_failed", "kept")], base_failed().alias("base_failed"), verdict.alias("kept"))


def verdicts(docs: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns of `docs` except the text, the counts, measures and verdicts. Measures are stored once, as bands and verdicts
    both need them."""
    return judged(materialise(measured(docs, pieces, ranks, pattern, text).drop(text)), lang)
