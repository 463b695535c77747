"""District lookups from the fixed gazetteer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions.text import lookup


def resolve_district_name(name: Column) -> Column:
    """SC-45: a city of the gazetteer, else a valid district, else the first district contained in the text or
    containing it; NULL when nothing fits."""
    low = F.lower(name)
    mutual = [
        F.when(F.contains(low, F.lit(d.lower())) | F.contains(F.lit(d.lower()), low), F.lit(d)) for d in M.DISTRICTS
    ]
    return F.coalesce(lookup(M.CITY_TO_DISTRICT, low), F.when(name.isin(list(M.DISTRICTS)), name), *mutual)


def district_coords(district: Column) -> tuple[Column, Column]:
    """SC-46: the district's centre, or the default coordinates."""
    lat = reduce(lambda acc, kv: acc.when(district == kv[0], kv[1][0]), M.DISTRICT_CENTERS.items(), F)
    lon = reduce(lambda acc, kv: acc.when(district == kv[0], kv[1][1]), M.DISTRICT_CENTERS.items(), F)
    return lat.otherwise(M.DEFAULT_COORDS[0]), lon.otherwise(M.DEFAULT_COORDS[1])


def city_district(text: Column, default: str | None = None) -> Column:
    """JN-06: district of the first gazetteer city, in gazetteer order, that the text contains."""
    hits = [F.when(F.contains(F.lower(text), F.lit(c)), F.lit(d)) for c, d in M.CITY_TO_DISTRICT.items()]
    return F.coalesce(*hits, F.lit(default)) if default is not None else F.coalesce(*hits)
