"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

Base spans come from patterns per kind, leftmost and without overlap; a match that fails its check is dropped. The model is trained
in numpy on a bounded sample of windows (`SAMPLE`, the least by hash over the whole corpus) that the base patterns label. Texts are cut into windows
of `WINDOW` code points that overlap by half. An entity needs a digit or an at sign, so a window without either is outside by
constraint; all others are read by the two LSTMs. Where windows overlap their scores are averaged, weighted towards their middles, and
one Viterbi pass over each covered stretch reconciles them. A decoded span is added if its kind's check holds (digits, parts,
Luhn) and it overlaps no base span, so base spans stay as they are.

Positions are code points, ends exclusive. Null and empty texts have no spans. Equal rows get equal spans. If no window can be
sampled, no spans are added. Patterns take time in proportion to the text, however long a run of digits or letters is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C

KINDS = ("email", "ip", "card", "phone")
WINDOW, SAMPLE, HIDDEN, EPOCHS, BATCH, RATE = 64, 1500, 12, 6, 64, 0.02
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CLASSES = 16
CLASS = np.ones(128, np.int64)  # 0 is padding, 1 anything else
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "(", ")", " ", "_%", ",;:", "\n\t\r", "'\"=")):
    CLASS[[ord(c) for c in _chars]] = 2 + _k

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        name, at, host = text.partition("@")
        return bool(name and at and "." in host.strip("."))
    if kind == 1:
        part = text.split(".")
        return len(part) == 4 and all(p.isascii() and p.isdigit() and int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in part)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind and start."""
    out, done = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in NAME:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            done = m.end()
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def codes(text: str) -> np.ndarray:
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(point < 128, CLASS[np.minimum(point, 127)], 2)


def window_starts(code: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign."""
    step = WINDOW // 2
    half = np.flatnonzero((code == 4) | (code == 5)) // step
    start = np.unique(np.concatenate([half, half - 1])) * step
    return start[start >= 0]


def window_codes(code: np.ndarray, start: np.ndarray) -> np.ndarray:
    padded = np.concatenate([code, np.zeros(WINDOW, np.int64)])
    return padded[start[:, None] + np.arange(WINDOW)]


def labels(text: str, length: int) -> np.ndarray:
    tag = np.zeros(length + WINDOW, np.int64)
    for kind, a, b in reversed(base_spans(text)):
        tag[a:b] = 2 + 2 * kind
        tag[a] = 1 + 2 * kind
    return tag


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Two LSTMs over character classes, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, seed: int = 7):
        r, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.3, (CLASSES, 4 * h))
            self.p["x" + d][:, h : 2 * h] += 1  # remember at first
            self.p["h" + d] = r.normal(0, 0.3 / np.sqrt(h), (h, 4 * h))
        self.p["o"] = r.normal(0, 0.3, (2 * h, TAGS))
        self.p["c"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))
        self.p["s"] = np.zeros(TAGS)

    def run(self, code: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (batch, time, hidden) of one direction."""
        n, size, h = len(code), code.shape[1], HIDDEN
        state, cell, out = np.zeros((n, h)), np.zeros((n, h)), np.zeros((n, size, h))
        for t in range(size) if d == "f" else range(size - 1, -1, -1):
            z = self.p["x" + d][code[:, t]] + state @ self.p["h" + d]
            gate, new = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            before, cell = cell, f * cell + i * new
            top = np.tanh(cell)
            if keep is not None:
                keep.append((t, state, before, i, f, o, new, top))
            state = o * top
            out[:, t] = state
        return out

    def back(self, code: np.ndarray, d: str, keep: list, grad: np.ndarray, into: dict) -> None:
        h = HIDDEN
        next_state, next_cell = np.zeros((len(code), h)), np.zeros((len(code), h))
        for t, state, before, i, f, o, new, top in reversed(keep):
            gs = grad[:, t] + next_state
            gc = next_cell + gs * o * (1 - top * top)
            gz = np.concatenate([gc * new * i * (1 - i), gc * before * f * (1 - f), gs * top * o * (1 - o), gc * i * (1 - new * new)], axis=1)
            np.add.at(into["x" + d], code[:, t], gz)
            into["h" + d] += state.T @ gz
            next_state, next_cell = gz @ self.p["h" + d].T, gc * f

    def scores(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(code, "f"), self.run(code, "b")], axis=2) @ self.p["o"] + self.p["c"]

    def gradient(self, code: np.ndarray, tag: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradient."""
        n, size = code.shape
        keep_f, keep_b = [], []
        hidden = np.concatenate([self.run(code, "f", keep_f), self.run(code, "b", keep_b)], axis=2)
        e, a = hidden @ self.p["o"] + self.p["c"], self.p["t"]
        alpha, beta = np.zeros((size, n, TAGS)), np.zeros((size, n, TAGS))
        alpha[0] = e[:, 0] + self.p["s"]
        for t in range(1, size):
            x = alpha[t - 1][:, :, None] + a
            m = x.max(1)
            alpha[t] = m + np.log(np.exp(x - m[:, None]).sum(1)) + e[:, t]
        for t in range(size - 2, -1, -1):
            x = a + (e[:, t + 1] + beta[t + 1])[:, None, :]
            m = x.max(2)
            beta[t] = m + np.log(np.exp(x - m[:, :, None]).sum(2))
        m = alpha[-1].max(1)
        z = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
        ge = np.exp((alpha + beta).transpose(1, 0, 2) - z[:, None, None])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        gold = np.take_along_axis(e, tag[:, :, None], 2).sum((1, 2)) + self.p["s"][tag[:, 0]] + a[tag[:, :-1], tag[:, 1:]].sum(1)
        for t in range(1, size):
            g["t"] += np.exp(alpha[t - 1][:, :, None] + a + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["t"], (tag[:, :-1].ravel(), tag[:, 1:].ravel()), -1)
        ge[np.arange(n)[:, None], np.arange(size), tag] -= 1
        g["s"] = ge[:, 0].sum(0)
        g["c"] = ge.sum((0, 1))
        g["o"] = np.einsum("nth,ntk->hk", hidden, ge)
        gh = ge @ self.p["o"].T
        self.back(code, "f", keep_f, gh[:, :, :HIDDEN], g)
        self.back(code, "b", keep_b, gh[:, :, HIDDEN:], g)
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def train(self, code: np.ndarray, tag: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> list[float]:
        r, one, two, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            order = r.permutation(len(code))
            for at in range(0, len(order), BATCH):
                loss, grad = self.gradient(code[order[at : at + BATCH]], tag[order[at : at + BATCH]])
                norm = np.sqrt(sum((v * v).sum() for v in grad.values()))
                step += 1
                for k, v in grad.items():
                    v = v * min(1.0, 5.0 / max(norm, 1e-9))
                    one[k], two[k] = 0.9 * one.get(k, 0) + 0.1 * v, 0.99 * two.get(k, 0) + 0.01 * v * v
                    rate = RATE * (1 - 0.8 * epoch / max(epochs - 1, 1))
                    self.p[k] = self.p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
                losses.append(loss)
        return losses

    def viterbi(self, score: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags of stretches laid end to end; all stretches advance together."""
        out, back = np.zeros(len(score), np.int64), np.zeros((len(score), TAGS), np.int8)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        best = score[begin] + self.p["s"]
        last = best.copy()
        for t in range(1, int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            x = best[:live, :, None] + self.p["t"]
            back[begin[:live] + t] = x.argmax(1)
            best = x.max(1) + score[begin[:live] + t]
            last[:live] = best
        tag = last.argmax(1)
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = begin[:live] + t
            out[at] = tag[:live]
            tag[:live] = back[at, tag[:live]]
        return out

    def decode(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of each text's decoded entities."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        starts = [window_starts(c) for c in texts]
        if not any(len(s) for s in starts):
            return found
        base = np.append(0, np.cumsum([len(c) + WINDOW for c in texts]))
        place = np.concatenate([s + b for s, b in zip(starts, base)])
        code = np.concatenate([window_codes(c, s) for c, s in zip(texts, starts)])
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)
        used = np.unique((place[:, None] + np.arange(WINDOW))[code > 0])
        total, mass = np.zeros((len(used), TAGS)), np.zeros(len(used))
        for at in range(0, len(place), 2048):
            here = slice(at, at + 2048)
            score = self.scores(code[here])
            real = code[here] > 0
            index = np.searchsorted(used, (place[here, None] + np.arange(WINDOW))[real])
            w = np.broadcast_to(weight, real.shape)[real]
            for k in range(TAGS):
                total[:, k] += np.bincount(index, score[..., k][real] * w, len(used))
            mass += np.bincount(index, w, len(used))
        head = np.flatnonzero(np.concatenate(([True], np.diff(used) != 1)))
        tag = self.viterbi(total / mass[:, None], head, np.diff(np.append(head, len(used))))
        inside = np.flatnonzero(tag)
        kind = (tag[inside] - 1) // 2
        fresh = np.concatenate(([True], (np.diff(used[inside]) != 1) | (kind[1:] != kind[:-1]) | (tag[inside][1:] % 2 == 1))) if len(inside) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        for a, b in zip(at, np.append(at[1:], len(inside))):
            t = int(np.searchsorted(base, used[inside[a]], side="right")) - 1
            found[t].append((int(kind[a]), int(used[inside[a]] - base[t]), int(used[inside[b - 1]] - base[t]) + 1))
        return found


def sampled(docs: DataFrame, text: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of `count` windows of the corpus, the least by a hash of text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                code = codes(t)
                tag = labels(t, len(code))
                for s in window_starts(code).tolist():
                    order = int(C.mix(np.array([h], np.int64).view(np.uint64), s)[0] >> np.uint64(1))
                    out.append((order, window_codes(code, np.array([s]))[0].astype(np.uint8).tobytes(), tag[s : s + WINDOW].astype(np.uint8).tobytes()))
            out = sorted(out)[:count]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["o", "code", "tag"])

    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    rows = some.mapInArrow(run, "o bigint, code binary, tag binary").orderBy("o", "code").limit(count).collect()
    read = lambda k: np.frombuffer(b"".join(r[k] for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return read("code"), read("tag")


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def found(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The columns of `docs` and `base`, `spans` (base and added): arrays of (kind, start, end) by kind, then start."""
    C.prepare(docs)
    code, tag = sampled(docs, text, sample)
    tagger = Tagger()
    if len(code):
        tagger.train(code, tag)
    shared = docs.sparkSession.sparkContext.broadcast(tagger if len(code) else None)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows_of(spans):
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in spans], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            base: list[list] = [[] for _ in texts]
            at = [i for i, t in enumerate(texts) if t and TRIGGER.search(t)]
            for i in at:
                base[i] = base_spans(texts[i])
            spans = [list(b) for b in base]
            for i, more in zip(at, model.decode([codes(texts[i]) for i in at]) if model and at else []):
                held = sorted((a, b) for _, a, b in base[i])
                for k, a, b in more:
                    near = np.searchsorted([x[0] for x in held], b) if held else 0
                    if valid(k, texts[i][a:b]) and not any(x[1] > a for x in held[:near]):
                        spans[i].append((k, a, b))
                spans[i].sort()
            yield from C.replace_columns(pa.Table.from_batches([batch]), base=rows_of(base), spans=rows_of(spans)).to_batches()

    return docs.mapInArrow(run, C.schema_with(docs, base=SPANS, spans=SPANS))
