"""Joins whose left side may hold one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1000


def attach(rows: DataFrame, lookup: DataFrame, key: str, partitions: int | None = None, most: int = MOST) -> DataFrame:
    """Left join of `rows` to `lookup`, which has one row for each key; both should be stored, they are read twice.

    A key is hot if more than 1/`most` of all rows have it, so there are fewer than `most` hot keys, whatever the data: their lookups are
    broadcast. The rows of a hot key find theirs there and are spread over all tasks, the others meet theirs in a shuffle join. Null
    keys find nothing. The columns of the lookup must not be those of the rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = counts.where(F.col("__n") > max(1, total // most)).select(key)
    values = [c for c in lookup.columns if c != key]
    kept = F.struct(*values)
    few = lookup.join(F.broadcast(hot), key).select(F.col(key).alias("__hot"), kept.alias("__few"))
    rest = lookup.select(F.concat(F.lit("k"), F.hex(F.col(key).cast("binary"))).alias("__key"), kept.alias("__rest"))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("__hot"), "left")
    # a row that needs no partner gets a key of its own
    own = F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))
    marked = marked.withColumn("__key", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.hex(F.col(key).cast("binary")))).otherwise(own))
    if partitions:
        marked, rest = marked.repartition(partitions, "__key"), rest.repartition(partitions, "__key")
    joined = marked.join(rest, "__key", "left")
    found = F.coalesce(F.col("__few"), F.col("__rest"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[found[v].alias(v) for v in values])
