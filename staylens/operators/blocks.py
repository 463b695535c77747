"""Order statistics of keys that may hold most of the rows: sorted blocks, and what the blocks before each one sum to.

Rows are range-partitioned by key and order, so a block is a stretch of about equal length, whoever owns it, and a large key lies in
many blocks. Within a block a window is small; from block to block only one number per key is carried forward."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens.session import materialise

BLOCK = "_block"


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int | None = None) -> DataFrame:
    """The rows, stored, each with the number of its block; blocks ascend with (keys, order)."""
    count = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(count, *keys, *order).withColumn(BLOCK, F.spark_partition_id()))


def carried(sums: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For one row per (keys, block): `before`, the sum of the value over the earlier blocks of the key. A key has at most as
    many rows here as there are blocks."""
    listed = F.sort_array(F.collect_list(F.struct(BLOCK, value)))
    start = F.struct(F.array().cast(f"array<struct<{BLOCK}:int,before:bigint>>").alias("out"), F.lit(0).cast("bigint").alias("sum"))
    fold = F.aggregate(
        "l", start,
        lambda s, x: F.struct(F.concat(s["out"], F.array(F.struct(x[BLOCK], s["sum"].alias("before")))).alias("out"), (s["sum"] + x[value]).alias("sum")),
        lambda s: s["out"])
    return sums.groupBy(*keys).agg(listed.alias("l")).select(*keys, F.inline(fold))


def within(keys: Sequence[str], order: Sequence[Column | str]):
    return W.partitionBy(*keys, BLOCK).orderBy(*order)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, count: int | None = None) -> DataFrame:
    """Adds gapless numbers from 0 within each key."""
    placed = in_blocks(df, keys, order, count)
    before = carried(placed.groupBy(*keys, BLOCK).agg(F.count("*").alias("_n")), keys, "_n")
    own = placed.withColumn("_i", F.row_number().over(within(keys, order)) - 1)
    return meet(own, before, [*keys, BLOCK]).select(*df.columns, (F.col("_i") + F.col("before")).cast("bigint").alias(name))


def meet(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Join on equal names, where null equals null; the names of the left side stay."""
    right = right.select(*[F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names] + ([] if also is None else [also])
    return left.join(right, reduce(lambda a, b: a & b, same, F.lit(True)), how).drop(*[f"_r_{c}" for c in names])
