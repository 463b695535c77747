"""Sharding by best-fit-decreasing bin packing.

Documents of equal text form a group, and a group goes whole into one bin, unless it is larger than a bin: then it is cut into
pieces of at most a bin. All pieces, largest first, enter the bin with the tightest remaining capacity that holds them; a balanced
tree of remaining capacities finds it. The capacity is the least, within `slack` of an even share, at which the pieces fit `bins`
bins, so sizes come out near equal; or it is given, and the number of bins is what the packing needs.

At scale the packing works on size classes. Spark counts the pieces of each class, the driver packs classes
(runs of equal pieces at once), and each piece learns its bin from its number within the class. Sizes up to 2**13 are classes of
their own, larger ones are rounded up to 13 significant bits, so there are at most 2**12 classes per doubling and the plan is bounded
however many documents there are. Numbers within a class, and slots within a shard, come from counts per hashed bucket, so no
task holds a class or a shard.

A null text weighs as an empty one and is in its group: one byte for the row. Equal rows are separate rows of one group. An empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.session import materialise

BITS, BUCKETS, MOVED = 13, 64, "__pack"


def size_class(size: Column) -> Column:
    """Sizes rounded up to `BITS` significant bits."""
    drop = F.greatest(F.length(F.bin(size)) - F.lit(BITS), F.lit(0))
    unit = F.expr("bigint(1)") * F.pow(F.lit(2), drop).cast("bigint")
    return (F.floor((size + unit - 1) / unit) * unit).cast("bigint")


class Bins:
    """Open bins by remaining capacity: runs of bins of equal room under one key of a sorted tree."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.rooms: list[tuple[int, int]] = []  # (remaining, bin), ascending

    def place(self, size: int, pieces: int) -> list[tuple[int, int]]:
        """Bins and numbers of `pieces` equal pieces, each into the tightest bin that holds it."""
        placed = []
        while pieces:
            at = bisect_left(self.rooms, (size, -1))
            if at == len(self.rooms):
                room, bin_ = self.capacity, self.count
                self.count += 1
            else:
                room, bin_ = self.rooms.pop(at)
            taken = min(pieces, room // size)  # it stays the tightest as long as it holds one more
            pieces -= taken
            insort(self.rooms, (room - taken * size, bin_))
            placed.append((bin_, taken))
        return placed


def pack(classes: list[tuple[int, int]], capacity: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of bins, and runs (class, first number, end, bin). `classes`: (size, pieces), largest first."""
    bins, out = Bins(capacity), []
    for size, pieces in classes:
        at = 0
        for bin_, taken in bins.place(size, pieces):
            out.append((size, at, at + taken, bin_))
            at += taken
    return bins.count, out


def least_capacity(classes: list[tuple[int, int]], bins: int) -> int:
    """A capacity near the even share at which the packing needs at most `bins` bins."""
    total = sum(s * n for s, n in classes)
    low = max(-(-total // bins), classes[0][0])
    if pack(classes, low)[0] <= bins:
        return low
    high = low
    while pack(classes, high)[0] > bins:
        high += max(1, high // 256)
    while high - low > max(1, low // 4096):
        middle = (low + high) // 2
        low, high = (low, middle) if pack(classes, middle)[0] <= bins else (middle, high)
    return high


def numbered(df: DataFrame, within: list[str], spread: Column, name: str) -> DataFrame:
    """Adds gapless numbers from 0 within each key: rows are numbered in hashed buckets, behind the counts of the buckets before."""
    df = df.withColumn("__bucket", F.pmod(spread, F.lit(BUCKETS)).cast("int"))
    own = Window.partitionBy(*within, "__bucket").orderBy("__order")
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = df.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counted = df.withColumn("__row", F.row_number().over(own) - 1)
    return counted.join(offset.drop("__n"), [*within, "__bucket"]).withColumn(name, (F.col("__row") + F.col("__offset")).cast("bigint")).drop("__row", "__offset", "__bucket")


def shards(docs: DataFrame, bins: int | None = 16, capacity: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Frame (id, size, text_crc32, shard, slot). Give a number of bins, or a capacity in bytes that the packing keeps."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id), (F.octet_length(raw) + F.lit(1)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("key"), F.xxhash64(raw).alias("__order"))
    rows = materialise(rows)
    group = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("rows"), F.min("__order").alias("__order"))
    total = rows.agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).first()
    if total["bytes"] is None:
        return rows.select(id, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    limit = capacity if capacity else max(-(-total["bytes"] // bins), total["largest"])
    if total["largest"] > limit:
        raise ValueError(f"a text of {total['largest']} bytes does not fit a bin of {limit}")
    # a group larger than a bin is cut into pieces of as many rows as fit
    fit = F.greatest(F.floor(F.lit(limit) / F.col("size")), F.lit(1))
    pieces = group.withColumn("__fit", fit).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / F.col("__fit")).cast("bigint"))))
    held = F.least(F.col("__fit"), F.col("rows") - F.col("piece") * F.col("__fit"))
    pieces = pieces.select("key", "size", "piece", "__fit", "__order", F.least(size_class(held * F.col("size")), F.lit(limit)).alias("class"))
    pieces = materialise(numbered(pieces, ["class"], F.xxhash64("key", "piece"), "number"))
    classes = [(r["class"], r["n"]) for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect()]
    _, plan = pack(classes, capacity if capacity else least_capacity(classes, bins))
    runs = docs.sparkSession.createDataFrame(plan, "class bigint, lo bigint, hi bigint, shard int")
    placed = pieces.join(F.broadcast(runs), "class").where("number >= lo and number < hi").select("key", "piece", "__fit", "shard")
    # rows of a cut group are dealt to its pieces by number, all others have one piece
    cut = pieces.where("piece > 0").select("key").distinct().withColumn("cut", F.lit(True))
    marked = rows.join(F.broadcast(cut), "key", "left")
    whole = marked.where("cut is null").withColumn("piece", F.lit(0).cast("bigint"))
    split = numbered(marked.where("cut"), ["key"], F.xxhash64(id, F.lit(1)), "n").join(placed.where("piece = 0").select("key", "__fit"), "key").withColumn("piece", F.floor(F.col("n") / F.col("__fit")).cast("bigint"))
    columns = [id, "size", "text_crc32", "key", "piece"]
    dealt = whole.select(*columns).unionByName(split.select(*columns)).join(placed.drop("__fit"), ["key", "piece"])
    # rows and buckets by id: equal ids may take either of their slots
    dealt = materialise(dealt.select(id, "size", "text_crc32", "shard", F.col(id).alias("__order")))
    return numbered(dealt, ["shard"], F.xxhash64(id), "slot").select(id, "size", "text_crc32", "shard", "slot")
