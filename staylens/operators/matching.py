"""Pair finding without pairing everything: similar titles, nearest neighbours on the map, connected groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens.functions import metrics as X
from staylens.functions.similarity import highest_ratio, parts_ratio, token_parts
from staylens.operators import blocks as B
from staylens.operators.events import EVENT_COLUMNS, merge_groups
from staylens.session import materialise, ship_package, spread, stored

FUZZY_THRESHOLD = 88.0
# A pair above the threshold shares at least this part of the smaller side's letter pairs: with L characters a title has
# L + 1 padded letter pairs, an edit destroys three of both sides' pairs together, and at most 12 % of the characters of
# both sides differ, so the overlap is at least 0.5 - 0.18 = 0.32 of both sides' sum; containment gives 0.78 or more.
MIN_OVERLAP = 0.64


def letter_pairs(key: Column) -> Column:
    """Letter pairs of every distinct token with its boundaries, as text."""
    padded = F.transform(F.array_distinct(F.split(key, " ")), lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    return F.flatten(F.transform(padded, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))))


def fuzzy_pairs(titles: DataFrame, bucket: Sequence[str], key: str = "title_key") -> DataFrame:
    """Pairs of different title keys of one bucket with a token-set ratio above the threshold.

    Candidates come from a prefix filter: letter pairs are ordered from the rarest in the bucket, and a title can only
    match another that contains one of its rarest ones. The two sides meet on (bucket, letter pair), an equi-join that
    splits a crowded bucket over its letter pairs and that adaptive execution can split further; no bucket is gathered
    in one task and pairs without a rare letter pair in common never exist. Each candidate is then scored exactly."""
    keys = titles.select(*bucket, key).distinct().select(*bucket, key, F.inline(F.array(F.struct(letter_pairs(F.col(key)).alias("_g")))))
    found = keys.select(*bucket, key, F.size("_g").alias("n"), F.explode("_g").alias("g"))
    repeats = found.groupBy(*bucket, key, "n", "g").agg(F.count("*").alias("k"))
    # a letter pair that repeats in a title is several different ones
    grams = repeats.select(*bucket, key, "n", "g", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("j")).withColumn(
        "g", F.concat("g", F.col("j").cast("string"))).drop("j")
    freq = grams.groupBy(*bucket, "g").agg(F.count("*").alias("f")).filter("f > 1")
    # letter pairs that occur once cannot be shared; they use up prefix places without producing candidates
    w = W.partitionBy(*bucket, key)  # one title's letter pairs, at most sixty
    ranked = grams.join(freq, [*bucket, "g"]).withColumns({
        "rn": F.row_number().over(w.orderBy("f", "g")), "alone": F.col("n") - F.count("*").over(w)})
    prefix_len = F.col("n") - F.ceil(F.col("n") * MIN_OVERLAP) + 1 - F.col("alone")
    ranked = materialise(ranked.select(*bucket, "g", key, "n", (F.col("rn") <= prefix_len).alias("in_prefix")))
    a = ranked.filter("in_prefix").select(*bucket, "g", F.col(key).alias("a"), F.col("n").alias("na"))
    b = ranked.select(*bucket, "g", F.col(key).alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, [*bucket, "g"]).filter((F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")))
    pairs = pairs.select(*bucket, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # lengths decide most pairs; what they leave open is scored exactly
    split = pairs.select(*bucket, "a", "b", F.inline(F.array(F.struct(token_parts(F.col("a"), F.col("b")).alias("p")))))
    likely = split.filter(highest_ratio(F.col("p")) > FUZZY_THRESHOLD)
    return likely.filter(parts_ratio(F.col("p")) > FUZZY_THRESHOLD).select(*bucket, "a", "b")


def connected_groups(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest member of the connected group of every node. Each round a node takes the smallest label among itself and
    its neighbours and then that label's own label, so chains shrink by more than half; rounds stop when none changes.
    Labels are stored in the shared checkpoint folder each round."""
    edges = materialise(pairs.select(*keys, "a", "b").union(pairs.select(*keys, F.col("b"), F.col("a"))).distinct())
    labels = materialise(edges.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = labels.join(near, [*keys, "node"], "left").select(*keys, "node", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        jump = labels.select(*keys, F.col("node").alias("next"), F.col("label").alias("far"))
        moved = materialise(hop.join(jump, [*keys, "next"], "left").select(*keys, "node", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = moved.filter(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select(*keys, "node", F.col("next").alias("label"))
        if changed == 0:
            return labels


def fuzzy_dedup(exact: DataFrame) -> DataFrame:
    """SO-05: exactly merged events whose titles are alike on the same day and in the same district become one.

    Groups are the transitive closure of the alike relation, so the result does not depend on the order of the rows;
    the sources found by the exact pass are kept."""
    bucket = ["date_start", "district"]
    exact = materialise(exact)
    named = exact.filter(F.coalesce("title_key", F.lit("")) != "")
    groups = connected_groups(fuzzy_pairs(named, bucket), bucket)
    labelled = named.join(groups.withColumnRenamed("node", "title_key"), [*bucket, "title_key"], "left").withColumn(
        "group_key", F.coalesce("label", "title_key"))
    rest = [c for c in EVENT_COLUMNS if c != "date_start"]
    merged = merge_groups(labelled, ["group_key", "date_start", "district"])
    # the group key repeats date_start: keep the first
    flat = merged.toDF(*["group_key", "date_start", "district", *[f"_{c}" for c in EVENT_COLUMNS], "also_at"])
    out = flat.select("district", "date_start", "group_key", *[F.col(f"_{c}").alias(c) for c in rest], "also_at")
    passed = exact.filter(F.coalesce("title_key", F.lit("")) == "").withColumn("group_key", F.lit(""))
    return out.unionByName(passed.select(*out.columns))


# --- map -------------------------------------------------------------------------------------------------------------
def _cells(df: DataFrame, radius_km: float) -> DataFrame:
    """Grid cells of the radius: 1 degree of latitude is 111.19 km, of longitude at most that."""
    step = radius_km / 111.0
    lat_cell = F.floor(F.col("lat") / step)
    # longitude cells are as wide as the radius at the row's latitude band, computed from the band so neighbours agree
    return df.withColumn("cy", lat_cell)


def _lon_cell(lon: Column, cy: Column, radius_km: float) -> Column:
    step = radius_km / 111.0
    widest = F.greatest(F.abs(cy * step), F.abs((cy + 1) * step))
    return F.floor(lon * F.greatest(F.cos(F.radians(F.least(widest, F.lit(89.0)))), F.lit(0.01)) / step)


SHEET = 256


def _sheets(rows: DataFrame, name: str) -> DataFrame:
    """Rows of equal coordinates in sheets of at most `SHEET` ids, so that a crowded place is neither one row nor one task."""
    placed = rows.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("id").alias(name), "lat", "lon")
    dealt = B.numbered(placed, ["lat", "lon"], [name], "i")
    return dealt.groupBy("lat", "lon", F.floor(F.col("i") / SHEET).alias("sheet")).agg(F.collect_list(F.struct(name)).alias(f"{name}s")).drop("sheet")


def pairs_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """Pairs (left id, right key, km) closer than the radius. Right rows are registered in the three latitude bands and
    three longitude cells around them, each left row looks into its own cell: an equi-join on cells. Rows of equal coordinates are measured
    once, and only sheets of ids that are close are sent on; their pairs are written where they are read."""
    l = _cells(_sheets(left, "l"), radius_km)
    l = l.withColumn("cx", _lon_cell(F.col("lon"), F.col("cy"), radius_km))
    r = _cells(_sheets(right, "r"), radius_km).withColumnsRenamed({"lat": "rlat", "lon": "rlon"})
    r = r.withColumn("cy", F.explode(F.array(F.col("cy") - 1, F.col("cy"), F.col("cy") + 1)))
    x = _lon_cell(F.col("rlon"), F.col("cy"), radius_km)
    r = r.withColumn("cx", F.explode(F.array(x - 1, x, x + 1)))
    km = X.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    near = stored(l.join(r, ["cy", "cx"]).select("ls", "rs", km.alias("km")).filter(F.col("km") < radius_km))
    pairs = near.agg(F.sum(F.size("ls").cast("bigint") * F.size("rs"))).first()[0] or 0
    return spread(near, pairs, 1_000_000).select(F.inline("ls"), "rs", "km").select("l", F.inline("rs"), "km").select("l", "r", "km")


LEAF, FAN, LISTED, SHRINK, SMALL = 64, 16, 16, 4, 20_000
BOX = ("lat_lo", "lat_hi", "lon_lo", "lon_hi", "n")


def _spread_bits(c: Column) -> Column:
    """Thirty bits with a zero before each."""
    for shift, mask in ((16, 0x3FFF0000FFFF), (8, 0x3F00FF00FF00FF), (4, 0x30F0F0F0F0F0F0F), (2, 0x333333333333333), (1, 0x555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _leaves(points: DataFrame, radius_km: float) -> DataFrame:
    """Cells cut into leaves of at most `LEAF` points: the points of a cell in the order of a quadtree's depth-first walk (the bits of both
    coordinates in turn), every `LEAF` of them in a box. A crowded cell has many small boxes, an ordinary one has one."""
    whole = float(1 << 30)
    y, x = (F.floor((F.col(c) + shift) / span * whole).cast("bigint") for c, shift, span in (("lat", 90.0, 181.0), ("lon", 180.0, 361.0)))
    placed = _cells(points, radius_km).withColumn("cx", _lon_cell(F.col("lon"), F.col("cy"), radius_km)).withColumn("code", F.shiftleft(_spread_bits(y), 1).bitwiseOR(_spread_bits(x)))
    dealt = B.numbered(placed, ["cy", "cx"], ["code", "place"], "i").withColumn("node", F.floor(F.col("i") / LEAF))
    return stored(dealt.groupBy("cy", "cx", "node").agg(
        F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"), F.count("*").alias("n"),
        F.collect_list(F.struct("place", "first", "lat", "lon")).alias("points")))


def _nodes(leaves: DataFrame, level: int, side: str) -> DataFrame:
    """Boxes of `FAN` to the power of `level` neighbouring leaves."""
    up = leaves.groupBy("cy", "cx", F.floor(F.col("node") / FAN ** level).alias("node")).agg(
        F.min("lat_lo").alias("lat_lo"), F.max("lat_hi").alias("lat_hi"), F.min("lon_lo").alias("lon_lo"), F.max("lon_hi").alias("lon_hi"), F.sum("n").alias("n"))
    return up.select(*[F.col(c).alias(f"{side}_{c}") for c in ("cy", "cx", "node", *BOX)])


def _box_km(nearest: bool) -> Column:
    """A bound on the distance of points of two boxes: none is closer, or none is farther."""
    def gap(lo: str, hi: str) -> Column:
        apart = F.greatest(F.col(f"l_{lo}") - F.col(f"r_{hi}"), F.col(f"r_{lo}") - F.col(f"l_{hi}"), F.lit(0.0))
        reach = F.greatest(F.col(f"l_{hi}") - F.col(f"r_{lo}"), F.col(f"r_{hi}") - F.col(f"l_{lo}"))
        return F.radians(apart if nearest else reach)
    ends = [F.abs(F.col(f"{s}_{e}")) for s in "lr" for e in ("lat_lo", "lat_hi")]
    crosses = F.least(*[F.col(f"{s}_lat_lo") for s in "lr"]) * F.greatest(*[F.col(f"{s}_lat_hi") for s in "lr"]) <= 0
    widest = F.greatest(*ends) if nearest else F.when(crosses, 0.0).otherwise(F.least(*ends))
    h = F.pow(F.sin(gap("lat_lo", "lat_hi") / 2), 2) + F.pow(F.cos(F.radians(widest)) * F.sin(gap("lon_lo", "lon_hi") / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _near_boxes(left: DataFrame, right: DataFrame, radius_km: float, listed: int) -> DataFrame:
    """Pairs of leaves that may hold one of the `listed` nearest points of a point of the other. Boxes of whole cells come first, then their
    parts: a pair goes if it is farther apart than boxes with enough points certainly are."""
    last = max(int(df.agg(F.max("node")).first()[0] or 0) for df in (left, right))
    top = 0
    while FAN ** top <= last:
        top += 1
    pairs = None
    for level in range(top, -1, -1):
        l, r = _nodes(left, level, "l"), _nodes(right, level, "r")
        if pairs is None:
            band = l.withColumn("r_cy", F.explode(F.array(F.col("l_cy") - 1, F.col("l_cy"), F.col("l_cy") + 1)))
            x = lambda c: _lon_cell(F.col(c), F.col("r_cy"), radius_km)
            around = band.withColumn("r_cx", F.explode(F.sequence(x("l_lon_lo") - 1, x("l_lon_hi") + 1)))
            met = around.join(r, ["r_cy", "r_cx"])
        else:
            down = lambda df, side: df.withColumn(f"{side}_up", F.floor(F.col(f"{side}_node") / FAN))
            met = pairs.join(down(l, "l"), ["l_cy", "l_cx", "l_up"]).join(down(r, "r"), ["r_cy", "r_cx", "r_up"])
        met = met.withColumn("closest", _box_km(True)).withColumn("farthest", _box_km(False)).filter(F.col("closest") < radius_km)
        ids = {s: [f"{s}_cy", f"{s}_cx", f"{s}_node"] for s in "lr"}
        sure = lambda own, other: F.coalesce(F.min(F.when(F.col(f"{other}_n") >= listed, F.col("farthest"))).over(W.partitionBy(*ids[own])), F.lit(radius_km))
        near = met.withColumn("l_sure", sure("l", "r")).withColumn("r_sure", sure("r", "l")).filter((F.col("closest") <= F.col("l_sure")) | (F.col("closest") <= F.col("r_sure")))
        pairs = stored(near.select(*ids["l"], *ids["r"], (F.col("closest") <= F.col("l_sure")).alias("for_l"), (F.col("closest") <= F.col("r_sure")).alias("for_r")))
        if level:
            pairs = pairs.drop("for_l", "for_r").withColumnsRenamed({"l_node": "l_up", "r_node": "r_up"})
    return pairs


def nearest_places(left: DataFrame, right: DataFrame, radius_km: float, listed: int = LISTED) -> DataFrame:
    """Frame (side, own, other, km, first): for each place of either side (l, r) its `listed` nearest places of the other side within the radius,
    ties by the first id there. Inputs: (place, first, lat, lon). Two leaves meet as one matrix of distances, of which at most
    `listed` entries a point are passed on, so a crowded cell is neither stored nor sent as pairs."""
    ship_package(left.sparkSession)
    leaves = {"l": _leaves(left, radius_km), "r": _leaves(right, radius_km)}
    pairs = _near_boxes(leaves["l"], leaves["r"], radius_km, listed)
    # few bytes may be much work: the number of tasks follows the pairs of leaves, not their size
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // 1000))
    return _listed(leaves, pairs, "l", "r", radius_km, listed, tasks).unionByName(_listed(leaves, pairs, "r", "l", radius_km, listed, tasks))


def _listed(leaves: dict[str, DataFrame], pairs: DataFrame, own: str, other: str, radius_km: float, listed: int, tasks: int) -> DataFrame:
    """One side of `nearest_places`: a leaf meets the leaves around it that may hold the nearest points of one of its own."""
    ids = lambda s: [f"{s}_{c}" for c in ("cy", "cx", "node")]
    side = lambda s: leaves[s].select(*[F.col(c).alias(i) for c, i in zip(("cy", "cx", "node"), ids(s))], F.col("points").alias(f"{s}_points"))
    met = pairs.filter(f"for_{own}").join(side(other), ids(other)).repartition(tasks, *ids(own)).groupBy(*ids(own)).agg(F.flatten(F.collect_list(f"{other}_points")).alias(f"{other}_points"))
    rows = met.join(side(own), ids(own)).select(f"{own}_points", f"{other}_points")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (place, _, at), (others, first, around) = (_points(batch.column(c), i) for c in (0, 1))
                km = _km(at, around)
                order = np.argsort(km, axis=1, kind="stable")[:, :listed]  # columns are in the order of ids
                near = np.take_along_axis(km, order, axis=1)
                row, column = np.nonzero(near < radius_km)
                picked = pa.array(order[row, column])
                yield pa.record_batch({
                    "side": pa.array([own] * len(row), pa.string()), "own": place.take(pa.array(row)), "other": others.take(picked),
                    "km": pa.array(near[row, column], pa.float64()), "first": first.take(picked)})

    return rows.mapInArrow(best, "side string, own string, other string, km double, first string")


def _points(column: pa.Array, i: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Places, first ids and coordinates in radians of one leaf, by first id."""
    a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    rows = column.values.slice(a, b - a)
    place, first, lat, lon = rows.flatten()
    order = pc.array_sort_indices(first)
    return place.take(order), first.take(order), np.radians(np.stack([lat.take(order).to_numpy(), lon.take(order).to_numpy()]))


def _km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dlat, dlon = (a[i][:, None] - b[i][None, :] for i in (0, 1))
    h = np.sin(dlat / 2) ** 2 + np.cos(a[0])[:, None] * np.cos(b[0])[None, :] * np.sin(dlon / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def settled(rows: list) -> list[tuple]:
    """The rounds of `match_one_to_one` over a few listed places: (l, r, km, rows, used before)."""
    n, used, near, out = {}, {}, {}, []
    for x in rows:
        own, other = (x["side"], x["own"]), ("r" if x["side"] == "l" else "l", x["other"])
        n[own], n[other] = x["own_n"], x["other_n"]
        used[own], used[other] = x["own_used"], x["other_used"]
        near.setdefault(own, []).append((x["km"], x["first"], x["other"]))
    lists = {k: sorted(v, reverse=True) for k, v in near.items()}
    while True:
        best = {}
        for (side, place), ahead in lists.items():
            facing = "r" if side == "l" else "l"
            while ahead and n[facing, ahead[-1][2]] <= 0:
                ahead.pop()
            if ahead and n[side, place] > 0:
                best[side, place] = ahead[-1]
        pairs = [(place, b[2], b[0]) for (side, place), b in best.items() if side == "l" and best.get(("r", b[2]), (0, 0, None))[2] == place]
        if not pairs:
            return out
        for l, r, km in pairs:
            m = min(n["l", l], n["r", r])
            out.append((l, r, km, m, used["l", l], used["r", r]))
            for end in (("l", l), ("r", r)):
                n[end], used[end] = n[end] - m, used[end] + m


def match_one_to_one(left: DataFrame, right: DataFrame, radius_km: float = 0.3) -> DataFrame:
    """JN-08: each row is used once; in every round the places that are each other's nearest with free rows (ties by first id) exchange
    as many rows as both have, in the order of their ids, until no free pair within the radius is left: a round takes the closest open
    pair at least, so rounds end. The outcome does not depend on the order of the rows. Inputs: (id, lat, lon).

    Rows of equal coordinates are one place with a count, so a place with most of the rows is one row here. Rounds run on the few nearest places listed for
    each place; only places whose list is used up are searched again among what is still free."""
    located = lambda df: df.filter((F.col("lat") != 0) & (F.col("lon") != 0)).select(F.col("id").cast("string").alias("id"), F.col("lat").cast("double"), F.col("lon").cast("double")).withColumn(
        "place", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))
    rows = {"l": located(left), "r": located(right)}
    places = {s: stored(df.groupBy("place").agg(F.min("id").alias("first"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count("*").alias("n"))) for s, df in rows.items()}
    every = places["l"].withColumn("side", F.lit("l")).unionByName(places["r"].withColumn("side", F.lit("r"))).select("side", "place", "n")
    found: list[DataFrame] = []

    def free() -> DataFrame:
        """Places with free rows, their number and how many are used."""
        if not found:
            return every.withColumn("used", F.lit(0).cast("bigint"))
        ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("place")) for s in "lr"])).alias("e")
        used = reduce(DataFrame.unionByName, found).select("m", ends).groupBy("e.side", "e.place").agg(F.sum("m").alias("used"))
        return every.join(used, ["side", "place"], "left").na.fill(0, ["used"]).select("side", "place", (F.col("n") - F.col("used")).alias("n"), "used").filter("n > 0")

    while True:
        state, began = stored(free()), len(found)
        open_ = {s: places[s].drop("n").join(state.filter(F.col("side") == s).select("place"), "place", "left_semi") for s in "lr"}
        listed = stored(nearest_places(open_["l"], open_["r"], radius_km))
        while True:
            other = F.when(F.col("side") == "l", "r").otherwise("l").alias("side")
            alive = listed.join(state.withColumnsRenamed({"place": "own", "n": "own_n", "used": "own_used"}), ["side", "own"]).join(
                state.select(other, F.col("place").alias("other"), F.col("n").alias("other_n"), F.col("used").alias("other_used")), ["side", "other"])
            if (len(found) - began) % SHRINK == 0 and len(some := alive.limit(SMALL + 1).collect()) <= SMALL:
                if rest := settled(some):
                    found.append(stored(left.sparkSession.createDataFrame(rest, "l string, r string, km double, m bigint, l_used bigint, r_used bigint")))
                break
            best = alive.groupBy("side", "own").agg(F.min(F.struct("km", "first", "other", F.least("own_n", "other_n").alias("m"), "own_used", "other_used")).alias("b"))
            l = best.filter("side = 'l'").select(F.col("own").alias("l"), F.col("b.other").alias("r"), "b.km", "b.m", F.col("b.own_used").alias("l_used"), F.col("b.other_used").alias("r_used"))
            r = best.filter("side = 'r'").select(F.col("own").alias("r"), F.col("b.other").alias("l"))
            taken = stored(l.join(r, ["l", "r"]))
            if taken.isEmpty():
                break
            found.append(taken)
            state = stored(free())
            if (len(found) - began) % SHRINK == 0:
                gone_other = state.select(other, F.col("place").alias("other"))
                listed = stored(listed.join(state.select("side", F.col("place").alias("own")), ["side", "own"], "left_semi").join(gone_other, ["side", "other"], "left_semi"))
            if len(found) > 20:  # a long chain settles one pair a round
                found[:], began = [stored(reduce(DataFrame.unionByName, found))], 0
        if len(found) == began:
            break
    if not found:
        return rows["l"].limit(0).select(F.col("id").alias("l"), F.col("id").alias("r"), F.lit(0.0).alias("km"))
    each = reduce(DataFrame.unionByName, found).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    each = each.select("l", "r", "km", (F.col("l_used") + F.col("_i")).alias("l_k"), (F.col("r_used") + F.col("_i")).alias("r_k"))
    ranked = lambda s: B.numbered(rows[s].select("place", "id"), ["place"], ["id"], f"{s}_k").select(F.col("place").alias(s), f"{s}_k", F.col("id").alias(f"{s}_id"))
    return each.join(ranked("l"), ["l", "l_k"]).join(ranked("r"), ["r", "r_k"]).select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), "km")


def fill_types(hotels: DataFrame, catalogue: DataFrame, radius_km: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """JN-09: (hotels with missing kinds filled from the matched catalogue, report of kinds and match rate)."""
    missing = hotels.filter(F.col("accommodation_type").isNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    pairs = match_one_to_one(missing, catalogue, radius_km)
    kinds = pairs.join(catalogue.select(F.col("id").alias("r"), F.col("accommodation_type").alias("_kind")), "r").filter("_kind IS NOT NULL")
    filled = hotels.join(kinds.select(F.col("l").alias("id"), "_kind"), "id", "left").withColumn(
        "accommodation_type", F.coalesce("accommodation_type", "_kind")).drop("_kind")
    total = missing.agg(F.count("*")).scalar()
    report = kinds.groupBy(F.col("_kind").alias("accommodation_type")).agg(F.count("*").alias("filled")).withColumn(
        "share_of_missing", F.col("filled") / F.nullif(total, F.lit(0)) * 100)
    return filled, report


def fill_descriptions(items: DataFrame, fallback: dict[str, str], by_kind: dict[str, str]) -> DataFrame:
    """JN-19: own text, else the entry of the same name, else the first entry whose name contains the item's or is
    contained in it, else the text of its kind."""
    from staylens.functions.text import lookup

    low = F.lower("name")
    partial = [F.when(F.contains(low, F.lit(n.lower())) | F.contains(F.lit(n.lower()), low), F.lit(t)) for n, t in fallback.items()]
    exact = lookup({n.lower(): t for n, t in fallback.items()}, low)
    kind = F.coalesce(lookup(by_kind, F.coalesce("type", F.lit(""))), F.lit(""))
    return items.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), exact, *partial, kind))


def merge_weather(history: DataFrame, forecast: DataFrame, today: Column) -> DataFrame:
    """JN-17: measured days before today, forecast from today on; a date present in both keeps the forecast."""
    both = history.filter(F.col("date") < today).withColumn("_rank", F.lit(0)).unionByName(forecast.withColumn("_rank", F.lit(1)))
    rest = [c for c in history.columns if c != "date"]
    return both.groupBy("date").agg(F.max_by(F.struct(*rest), F.col("_rank")).alias("r")).select("date", "r.*")
