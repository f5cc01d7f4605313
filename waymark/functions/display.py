"""Derived columns of result cards, links and the map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import query_string

#: Half a side of the box around a site, in degrees (a fixed value).
BOX = 0.01450
#: Colours of regions in order of appearance (fixed values).
PALETTE = ("#166534", "#92400e", "#0369a1", "#15803d", "#7c2d12", "#047857")


def status_chip(is_open: Column) -> Column:
    return F.when(is_open, "Open").otherwise("Closed")


def badges(has_water: Column, has_restrooms: Column) -> Column:
    found = F.array_compact(F.array(F.when(has_water, "Water"), F.when(has_restrooms, "Restrooms")))
    return F.when(F.size(found) == 0, F.array(F.lit("No amenities listed"))).otherwise(found)


def box(lat: Column, lon: Column, offset: float = BOX) -> Column:
    """``top, left, bottom, right`` around a point; null if a coordinate is."""
    a, b = lat.cast("double"), lon.cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct((a + offset).alias("top"), (b - offset).alias("left"), (a - offset).alias("bottom"), (b + offset).alias("right")))


def box_url(lat: Column, lon: Column, base: str) -> Column:
    b = box(lat, lon)
    part = lambda name, key: F.concat(F.lit(f"{name}="), b[key].cast("string"))
    query = F.concat_ws("&", part("b_br_lat", "bottom"), part("b_br_lng", "right"), part("b_tl_lat", "top"), part("b_tl_lng", "left"))
    return F.when(b.isNotNull(), F.concat(F.lit(base), F.lit("?"), query))


def reservation(facility_id: Column, n: Column, base: str) -> Column:
    """``url, num_sites``: no link and 0 where the count is null or not positive."""
    some = F.coalesce(n > 0, F.lit(False))
    return F.struct(F.when(some, F.concat(F.lit(base), facility_id)).alias("url"), F.when(some, n).otherwise(F.lit(0)).cast("int").alias("num_sites"))


def detail_link(site_id: Column, start: Column, end: Column, base: str = "/campsite/") -> Column:
    query = query_string({"start": start, "end": end})
    return F.concat(F.lit(base), site_id.cast("string"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def region_label(forest: Column) -> Column:
    return F.coalesce(F.nullif(forest, F.lit("")), F.lit("Other"))
