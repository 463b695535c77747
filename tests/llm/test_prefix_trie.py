"""The conversation trie against brute force, in one shard and in many."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from staylens.llm import prefix_trie
from staylens.session import materialise

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, n string, conv string"  # the last two clash with columns of the operator


def brute(conversations):
    """Nodes of {id: turns}."""
    members, nodes = defaultdict(list), []
    for id, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(id)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(i for i in ids if tuple(conversations[i]) == node)))
        nodes.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(nodes)


def listed(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}


def branched(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def rows(seed=2, n=240):
    r = random.Random(seed)
    said = ["", "hi", "a  b\tc", "né d"] + [f"t{i} " * (i % 5) for i in range(30)]
    out = []
    for c in range(n):
        if c % 40 == 20:
            continue  # a block without its first conversation
        turns = [(r.choice(["user", "assistant"]), r.choice(said)) for _ in range(r.randint(1, 9))]
        if c % 3 == 0:
            turns = [("user", "hot start"), ("assistant", "same answer"), ("user", "once more")][: r.randint(1, 3)] + turns[: r.randint(0, 3)]
        if c % 7 == 0:
            turns = [("user", "copied"), ("assistant", "word for word")]
        out += [(c, i, *t) for i, t in enumerate(turns)]
    out += [(501, None, None, None), (501, 0, "user", None), (502, 0, None, "x"), (503, 5, "user", "late"), (503, -5, "user", "early"), (503, 5, "user", "late")]
    out += [(504, i, "user", f"long {i % 3}") for i in range(300)] + [(None, 0, "user", "nobody"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "own", "own") for r in rows()], SCHEMA).repartition(5)


@pytest.mark.parametrize("shard_turns", [100_000, 60])
def test_nodes(spark, table, shard_turns):
    """Small shards make most upper nodes shared ones."""
    own = listed(rows())
    got = prefix_trie.nodes(materialise(prefix_trie.sequences(table)), shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(own)
    got = prefix_trie.nodes(prefix_trie.branched(materialise(prefix_trie.sequences(table))), shard_turns)
    assert Counter(tuple(r) for r in got.collect()) == brute(branched(own))


def test_hot_conversation_and_hot_start(spark, monkeypatch):
    """A third of the conversations are equal and another third begin alike for six turns; ids arrive in chunks of 7."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    made = {c: [("user", "copy")] * 2 if c % 3 == 0 else [("user", f"s{d}") for d in range(6)] + [("user", f"{c % 50}"), ("user", str(c))] if c % 3 == 1 else [("user", str(c))] for c in range(900)}
    flat = [(c, i, *t) for c, turns in made.items() for i, t in enumerate(turns)]
    table = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string").repartition(6)
    got = prefix_trie.nodes(materialise(prefix_trie.sequences(table)), shard_turns=200)
    assert Counter(tuple(r) for r in got.collect()) == brute(made)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(prefix_trie.branched(prefix_trie.sequences(none))).collect() == []
    nobody = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(prefix_trie.sequences(nobody)).collect() == []


def test_double_array():
    """Every child is found from its parent, no slot is taken twice, and other labels lead nowhere."""
    r = np.random.default_rng(4)
    trie, level, known = prefix_trie.DoubleArray(300, 10), np.array([1]), {}
    for _ in range(5):
        pairs = np.unique(np.concatenate([s * 301 + r.choice(300, r.choice([1, 1, 2, 20]), replace=False) + 1 for s in level]))
        parents, labels = np.divmod(pairs, 301)
        trie.add(parents, labels)
        child = trie.step(parents, labels)
        assert (child > 0).all()
        known.update(zip(zip(parents.tolist(), labels.tolist()), child.tolist()))
        level = child[:: max(1, len(child) // 60)]
    assert len(set(known.values())) == len(known)
    slots = np.repeat(level, 300)
    tried = np.tile(np.arange(1, 301), len(level))
    assert [known.get(k, 0) for k in zip(slots.tolist(), tried.tolist())] == trie.step(slots, tried).tolist()
