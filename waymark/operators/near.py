"""Places within a distance or a box, by an equi-join on cells of a grid and an exact check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
RADIUS = 6371.0088
#: Rows of one place that make one list, about; a place with more has more lists.
LIST_ROWS = 1024


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * RADIUS)


def _wrapped(lon: Column) -> Column:
    """A longitude from -180 up to but not including 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def _by_place(df: DataFrame, columns: list[str], name: str, list_rows: int) -> DataFrame:
    """The rows of each place (``_lat``, ``_lon``) as structs of ``columns`` in lists ``name``.

    Rows of crowded places, which are few for their number of rows and broadcast, are dealt by their hash to as many lists as they need.
    """
    crowded = df.groupBy("_lat", "_lon").count().where(F.col("count") > list_rows)
    parts = crowded.select("_lat", "_lon", F.ceil(F.col("count") / list_rows).alias("_parts"))
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    dealt = df.join(F.broadcast(parts), ["_lat", "_lon"], "left").withColumn("_part", F.pmod(F.xxhash64(*hashed), F.coalesce("_parts", F.lit(1))))
    # A number of partitions that stays: they are small in bytes, but have all pairs before them.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "_lat", "_lon", "_part")
    return dealt.groupBy("_lat", "_lon", "_part").agg(F.collect_list(F.struct(*(columns or ["_lat"]))).alias(name)).drop("_part")


def within_distance(left: DataFrame, right: DataFrame, km: float, also: dict[str, Column] | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """All pairs of rows at most ``km`` apart, with ``km_apart``. Both tables have ``latitude`` and ``longitude``; other names must differ.

    The grid has bands of latitude as high as the distance, and in each band cells that are at least as wide as the distance at
    its end nearer to a pole, a whole number of them around the earth. A right row is in one cell; a left row asks the
    cells that the distance can reach: of its own band and of those above and below, usually three each, all of a band
    around a pole. So a pair meets in exactly one cell, across the date line too. Rows without coordinates, or
    with a latitude beyond the poles, have no pairs.

    Rows of one place go through the cells as one list, or lists of about ``list_rows``: the distance is worked out once for two
    places, and their pairs of rows are only written out. ``also``: further columns, expressions over ``km_apart``, worked out
    once in the same way.
    """
    if not 0 < km < RADIUS:
        raise ValueError("the distance must be positive and below the earth's radius")
    reach = math.degrees(km / RADIUS)
    also = also or {}
    names = [c for c in [*left.columns, *right.columns, *also] if c not in ("latitude", "longitude")]
    if len(names) != len(set(names)):
        raise ValueError("columns of the two tables clash")
    band_of = lambda lat: F.floor(lat / reach)

    def cells_in(band: Column) -> Column:
        """How many cells go around the earth in a band: as wide as the distance where the band is narrowest."""
        far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * reach, F.lit(90.0))
        wide = F.cos(F.radians(far)) * (360 / reach)
        return F.greatest(F.floor(wide), F.lit(1))

    def usable(df: DataFrame) -> DataFrame:
        lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
        return df.where((F.abs(lat) <= 90) & (F.abs(lon) <= 1e6)).withColumns({"_lat": lat, "_lon": _wrapped(lon)})

    own, others = ([c for c in df.columns if c not in ("latitude", "longitude")] for df in (left, right))
    there = _by_place(usable(right), others, "_right", list_rows).withColumn("_band", band_of(F.col("_lat")))
    there = there.withColumn("_cell", F.floor((F.col("_lon") + 180) / 360 * cells_in(F.col("_band"))))
    there = there.select("_band", "_cell", "_right", F.col("_lat").alias("_rlat"), F.col("_lon").alias("_rlon"))
    here = _by_place(usable(left), own, "_left", list_rows).withColumn("_band", F.explode(F.sequence(band_of(F.col("_lat") - reach), band_of(F.col("_lat") + reach))))
    # Degrees of longitude that the distance spans at the row's latitude; all of them where it reaches over a pole.
    s, c = F.lit(math.sin(math.radians(reach))), F.cos(F.radians("_lat"))
    span = F.when(c > s, F.degrees(F.asin(F.least(s / c, F.lit(1.0)))) + 1e-9).otherwise(F.lit(180.0))
    n = cells_in(F.col("_band"))
    first, last = F.floor((F.col("_lon") - span + 180) / 360 * n), F.floor((F.col("_lon") + span + 180) / 360 * n)
    cells = F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda x: F.pmod(x, n))
    here = here.withColumn("_cell", F.explode(cells)).select("_band", "_cell", "_left", "_lat", "_lon")
    apart = distance_km(F.col("_lat"), F.col("_lon"), F.col("_rlat"), F.col("_rlon"))
    places = here.join(there, ["_band", "_cell"]).withColumn("km_apart", apart).where(F.col("km_apart") <= km)
    places = places.withColumns(also) if also else places
    values = ["km_apart", *also]
    pairs = places.select(*values, "_right", F.explode("_left").alias("_left")).select(*values, "_left", F.explode("_right").alias("_right"))
    return pairs.select(*[F.col(f"_left.{c}").alias(c) for c in own], *[F.col(f"_right.{c}").alias(c) for c in others], *values)


def inside_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """``points`` (latitude, longitude) with the ``boxes`` (bottom, left, top, right, edges included) that they lie in.

    A box is listed under every cell of ``cell`` degrees that it covers, so ``cell`` should be about the size of the usual box;
    a box that spans many becomes as many rows. Boxes over the date line have ``left`` beyond ``right``. Null edges match nothing.
    """
    grid = lambda c: F.floor(c.cast("double") / cell)
    here = points.withColumns({"_y": grid(F.col("latitude")), "_x": grid(F.col("longitude"))})
    span = lambda a, b: F.when(grid(a) <= grid(b), F.sequence(grid(a), grid(b))).otherwise(F.array().cast("array<bigint>"))
    l, r = F.col("left"), F.col("right")  # noqa: E741
    across = F.concat(span(l, F.lit(180.0)), span(F.lit(-180.0), r))
    there = boxes.withColumn("_y", F.explode(span(F.col("bottom"), F.col("top")))).withColumn("_x", F.explode(F.array_distinct(F.when(l <= r, span(l, r)).otherwise(across))))
    lon = F.col("longitude")
    east = F.when(l <= r, (lon >= l) & (lon <= r)).otherwise((lon >= l) | (lon <= r))
    return here.join(there, ["_y", "_x"]).where((F.col("latitude") >= F.col("bottom")) & (F.col("latitude") <= F.col("top")) & east).drop("_y", "_x")


def totals_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, id_col: str = "id") -> DataFrame:
    """``boxes`` that hold any of ``points``, with ``n``, the number of points, and ``first_id``, their smallest ``id_col``.

    Points of one place are counted before the join and equal boxes asked once, so no pair of a point and a box is made:
    the join grows with the number of different places and different boxes.
    """
    edges = ["bottom", "left", "top", "right"]
    spots = points.groupBy("latitude", "longitude").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    views = boxes.select(*edges).distinct()
    found = inside_boxes(spots, views, cell).groupBy(*edges).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    return boxes.join(found, edges)
