"""A trie of all conversations: which beginnings they share, how often, and what sharing them would save.

A conversation is a sequence of turns (role, text). Every distinct beginning of d turns is a node of depth d, the root has none. The members
of a node are the conversations that begin so. A subtree has its top.

How. Turns become 16 bytes of a SHA-256. Conversations of equal turns become one sequence with a count; their ids are hashed in order as
a stream, in chunks sorted by range, so copies of one conversation do not meet in one task's memory. Sequences are dealt to shards by
their first r turns, r = 1, 2, 4 and so on: as long as more than `shard_turns` turns begin alike, they are parted by a longer beginning. A shard
numbers its turns densely and packs a double-array trie: the child of the node in slot s by turn t is in slot BASE[s] + t, if CHECK of that
slot is s. All its sequences then walk the arrays together, a depth at a time, and leave counts and smallest members in the slots.
Nodes from depth r down are whole in their shard. Those above are shared: their aggregates are merged over the shards, and their subtrees are
sums over the tops below and over the shared nodes that have them among their ancestors.

Turns are ordered by turn (null first); equal turns by role and digest. A null role or text is an empty one. Rows without a conversation id belong
to no conversation and are left out, as no member could be named. Repeated rows are repeated turns. An empty table has no nodes. Columns
other than these four are not looked at, whatever their names. The turns of one conversation are one value, 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import common as C
from staylens.llm import hot
from staylens.session import materialise

SHARD_TURNS, WIDTH, STRIDE, CHUNK = 100_000, 16, 1 << 12, 1 << 12
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Frame (conv, turns): the turns of each conversation in order, as structs of digest and words."""
    spoken, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\n", F.octet_length(spoken).cast("string"), F.concat(spoken, said)), 256)), 1, WIDTH)
    words = F.regexp_count(said, F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    one = F.struct(F.col(turn).cast("bigint").alias("turn"), spoken.alias("role"), digest.alias("digest"), words.alias("words"))
    listed = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), one.alias("one")).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return listed.select("conv", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def packed(listed: DataFrame) -> DataFrame:
    """Frame (conv, seq, words): digests one behind the other, and the words of each turn."""
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return listed.select("conv", joined.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))


def beginning(depth: Column | int) -> Column:
    """Key of the first turns of a sequence."""
    return F.substring(F.unhex(F.sha2(F.col("seq").substr(F.lit(1), F.lit(depth) * WIDTH), 256)), 1, WIDTH)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Frame (key, seq, words, n, conv, ends): each different sequence, its members' number, the smallest and the SHA-256 of all in order."""
    C.prepare(convs)
    keyed = materialise(convs.withColumn("key", F.substring(F.unhex(F.sha2("seq", 256)), 1, WIDTH)))
    one = keyed.groupBy("key").agg(F.min_by(F.struct("seq", "words"), "conv").alias("one"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
    copied = materialise(one)
    single = copied.where("n = 1").select("key", "one.*", "n", "conv", F.sha2(F.col("conv").cast("string"), 256).alias("ends"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of a run of equal keys as text, in chunks."""
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cut = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            parts = [(a, min(a + CHUNK, b)) for lo, b in zip(cut[:-1], cut[1:]) for a in range(lo, b, CHUNK)]
            yield pa.record_batch({
                "key": pa.array([keys[a] for a, _ in parts], pa.binary()),
                "low": pa.array([int(ids[a]) for a, _ in parts], pa.int64()),
                "ids": pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in parts], pa.string()),
            })

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One running hash over the chunks of a key, which come in order."""
        now, running = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if running:
                        done.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pa.record_batch({"key": pa.array([k for k, _ in done], pa.binary()), "ends": pa.array([e for _, e in done], pa.string())})
        if running:
            yield pa.record_batch({"key": pa.array([now], pa.binary()), "ends": pa.array([running.hexdigest()], pa.string())})

    many = copied.where("n > 1")
    ids = hot.attach(keyed.select("key", "conv"), many.select("key", F.lit(True).alias("many")), "key").where("many").select("key", "conv")
    texts = ids.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(chunks, "key binary, low bigint, ids string")
    ends = texts.repartition("key").sortWithinPartitions("key", "low").mapInArrow(hashed, "key binary, ends string")
    return single.unionByName(many.select("key", "one.*", "n", "conv").join(ends, "key"))


def routed(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Adds `depth`, the number of first turns that part a sequence from those of other shards, and `route`, their key. Beginnings with
    more than `shard_turns` turns behind them are parted again, at twice the depth."""
    length = F.octet_length("seq") / WIDTH
    open_, done, depth = seqs, [], 1
    while True:
        keyed = materialise(open_.withColumn("route", beginning(F.least(F.lit(depth), length.cast("int")))))
        heavy = materialise(keyed.groupBy("route").agg(F.sum(length + 1).alias("turns"), F.count(F.lit(1)).alias("n")).where((F.col("turns") > shard_turns) & (F.col("n") > 1)).select("route", F.lit(True).alias("heavy")))
        if heavy.isEmpty():
            done.append(keyed.withColumn("depth", F.lit(depth)))
            break
        parted = materialise(hot.attach(keyed, heavy, "route"))
        done.append(parted.where("heavy is null").drop("heavy").withColumn("depth", F.lit(depth)))
        open_, depth = parted.where("heavy").drop("heavy", "route"), depth * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class DoubleArray:
    """A trie over dense labels 1 to `labels`. Slot 1 is the root; the child of slot s by label t is slot BASE[s] + t, and has CHECK s."""

    def __init__(self, labels: int, nodes: int):
        size = 2 + 2 * (labels + nodes)
        self.base, self.check = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.check[:2] = -1  # slot 0 is no node, the root has no parent
        self.free = 2  # no slot below it is free

    def room(self, slots: int) -> None:
        if slots > len(self.check):
            more = np.zeros(max(slots, 2 * len(self.check)) - len(self.check), np.int64)
            self.base, self.check = np.append(self.base, more), np.append(self.check, more)

    def open_slots(self, most: int) -> np.ndarray:
        """So many free slots, the first ones."""
        found, at = [np.zeros(0, np.int64)], self.free
        while most > 0:
            self.room(at + STRIDE)
            found.append((at + np.flatnonzero(self.check[at : at + STRIDE] == 0))[:most])
            most, at = most - len(found[-1]), at + STRIDE
        return np.concatenate(found)

    def put(self, parent: int, labels: np.ndarray) -> None:
        """Children of one node: the first base at which all their slots are free."""
        at = self.free
        while True:
            self.room(at + STRIDE + int(labels[-1] - labels[0]) + 1)
            base = at + np.flatnonzero(self.check[at : at + STRIDE] == 0) - labels[0]
            for label in labels[1:]:  # the bases left shrink with every child
                base = base[self.check[base + label] == 0]
                if not len(base):
                    break
            if len(base):
                break
            at += STRIDE
        self.base[parent] = base[0]
        self.check[base[0] + labels] = parent
        self.advance()

    def put_single(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Nodes with one child each: any free slot will do."""
        slots = self.open_slots(len(parents))
        self.base[parents] = slots - labels
        self.check[slots] = parents
        self.advance()

    def advance(self) -> None:
        while self.free < len(self.check) and self.check[self.free]:
            taken = self.check[self.free : self.free + STRIDE] != 0
            self.free += len(taken) if taken.all() else int(np.argmin(taken))

    def add(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Children of a level: pairs (parent, label), sorted and without repeats."""
        head = np.flatnonzero(C.first_of_run(parents))
        size = np.diff(np.append(head, len(parents)))
        for i in np.flatnonzero(size > 1)[np.argsort(-size[size > 1], kind="stable")]:
            self.put(int(parents[head[i]]), labels[head[i] : head[i] + size[i]])
        alone = head[size == 1]
        if len(alone):
            self.put_single(parents[alone], labels[alone])

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Slots of the children, 0 where there is none."""
        child = self.base[slots] + labels
        inside = (child > 0) & (child < len(self.check))
        child = np.where(inside, child, 0)
        return np.where(self.check[child] == slots, child, 0)


def dense(digests: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers 1.. of digests, in the order of their bytes."""
    different, number = np.unique(digests, return_inverse=True)
    return number + 1, len(different)


NODE = "conv bigint, depth bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string, shared binary, above binary, words bigint, path array<binary>"


def walk(table: pa.Table) -> pa.RecordBatch:
    """Nodes of a shard. Nodes above the depth of their route are `shared` under their key, with the keys of the nodes on the way (`path`); those
    right below name the shared node above them."""
    count = table.num_rows
    seq, n, conv, ends, routes, words = (table.column(c) for c in ("seq", "n", "conv", "ends", "depth", "words"))
    data, offsets = C.flat(seq)
    n, conv, route = n.to_numpy(), conv.to_numpy(), routes.to_numpy().astype(np.int64)
    raw = data.tobytes()
    label, labels = dense(data.view(f"V{WIDTH}"))
    said = words.combine_chunks().flatten().to_numpy().astype(np.int64)
    first = offsets[:-1] // WIDTH
    length = np.diff(offsets) // WIDTH
    trie = DoubleArray(labels, int(length.sum()))
    slot, levels, live, depth = np.ones(count, np.int64), [], np.arange(count), 0
    while True:
        levels.append((live, slot[live]))
        live = live[length[live] > depth]
        if not len(live):
            break
        step = label[first[live] + depth]
        pair = C.distinct(slot[live] * (labels + 1) + step)
        trie.add(*np.divmod(pair, labels + 1))
        slot[live] = trie.step(slot[live], step)
        depth += 1
    # aggregates in the slots, then gathered in order of depth
    size = len(trie.check)
    members, smallest, least = np.zeros(size, np.int64), np.full(size, 2**63 - 1), np.zeros(size, np.int64)
    weight, level, sample = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for d, (live, at) in enumerate(levels):
        np.add.at(members, at, n[live])
        np.minimum.at(smallest, at, conv[live])
        np.maximum.at(least, at, route[live])
        sample[at], level[at] = live, d
        if d:
            weight[at] = said[first[live] + d - 1]
    nodes = np.concatenate([C.distinct(at) for _, at in levels])
    parent = trie.check[nodes]
    children = np.bincount(parent[1:], minlength=size)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * weight
    bounds = np.cumsum([0, *[len(C.distinct(at)) for _, at in levels]])
    for d in range(len(levels) - 1, 0, -1):
        own = nodes[bounds[d] : bounds[d + 1]]
        np.add.at(leaves, trie.check[own], leaves[own])
        np.add.at(saved, trie.check[own], saved[own])
    ending = np.full(size, -1)
    ending[slot] = np.arange(count)
    key = lambda i, d: hashlib.sha256(raw[offsets[i] : offsets[i] + d * WIDTH]).digest()[:WIDTH]
    depths, samples = level[nodes], sample[nodes]
    # all sequences through a shared node have the same beginning, so they agree on whether it lies above their route
    shared = depths < least[nodes]
    top = depths == least[nodes]
    ends, listed = ends.to_pylist(), list(zip(shared.tolist(), top.tolist(), samples.tolist(), depths.tolist()))
    return pa.record_batch({
        "conv": pa.array(smallest[nodes]),
        "depth": pa.array(depths),
        "parent": pa.array(smallest[np.maximum(parent, 0)], mask=shared | top),
        "n": pa.array(members[nodes]),
        "children": pa.array(children[nodes]),
        "leaves": pa.array(leaves[nodes]),
        "saved": pa.array(saved[nodes]),
        "ends": pa.array([ends[e] if e >= 0 else None for e in ending[nodes].tolist()], pa.string()),
        "shared": pa.array([key(i, d) if s else None for s, _, i, d in listed], pa.binary()),
        "above": pa.array([key(i, d - 1) if d and (s or t) else None for s, t, i, d in listed], pa.binary()),
        "words": pa.array(weight[nodes]),
        "path": pa.array([[key(i, e) for e in range(d + 1)] if s else None for s, _, i, d in listed], pa.list_(pa.binary())),
    })


def shard_nodes(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of all shards, as `walk` gives them."""
    total = seqs.agg(F.sum(F.octet_length("seq") / WIDTH + 1)).first()[0] or 0
    shards = max(1, int(-(-total // shard_turns)))
    placed = seqs.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        C.trim()
        return pa.Table.from_batches([walk(table)])

    return placed.select("shard", "seq", "words", "n", "conv", "ends", "depth").groupBy("shard").applyInArrow(run, NODE)


def merged(found: DataFrame) -> DataFrame:
    """Frame of all nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own, upper = found.where("shared is null"), found.where("shared is not null")
    facts = [F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("above", ignorenulls=True).alias("above"), F.sum("n").alias("n"), F.first("words").alias("words"), F.max("ends").alias("ends"), F.first("path").alias("path")]
    upper = materialise(upper.groupBy("shared").agg(*facts))
    tops = own.where("above is not null").groupBy("above").agg(F.count(F.lit(1)).alias("tops"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    inner = upper.where("above is not null").groupBy("above").agg(F.count(F.lit(1)).alias("inner"))
    upper = upper.join(tops.withColumnRenamed("above", "shared"), "shared", "left").join(inner.withColumnRenamed("above", "shared"), "shared", "left").na.fill(0, ["tops", "leaves", "saved", "inner"])
    upper = materialise(upper.withColumn("children", F.col("tops") + F.col("inner")))
    # what a shared node adds to itself and to each node on its path
    adds = upper.select(F.explode("path").alias("shared"), (F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)).alias("l"), (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("s"))
    sums = adds.groupBy("shared").agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved"))
    upper = materialise(upper.drop("leaves", "saved", "path").join(sums, "shared"))
    named = upper.select(F.col("shared").alias("above"), F.col("conv").alias("named"))
    kept = ["conv", "depth", "n", "children", "leaves", "saved", "ends"]
    below = hot.attach(own.select(*kept, "parent", "above"), named, "above").select(*kept, F.coalesce("named", "parent").alias("parent"))
    above = upper.join(named, "above", "left").select(*kept, F.col("named").alias("parent"))
    every = below.unionByName(above)
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


def nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of a frame of `sequences`."""
    seqs = materialise(distinct_sequences(packed(convs)))
    return merged(materialise(shard_nodes(routed(seqs, shard_turns), shard_turns)))


def branched(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations that begin like the first of their block of `every` ids: its first h turns, then their own behind the first h, where h is
    the CRC-32 of the decimal id modulo `most` + 1."""
    head = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("__head"), F.slice("turns", 1, most).alias("__first"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = convs.withColumn("__h", h).join(head, F.col("conv") - F.col("conv") % every == F.col("__head"), "left")
    taken = F.coalesce(F.expr("slice(__first, 1, __h)"), F.expr("slice(turns, 1, 0)"))
    return rows.select("conv", F.concat(taken, F.expr("slice(turns, __h + 1, greatest(size(turns), 1))")).alias("turns"))
