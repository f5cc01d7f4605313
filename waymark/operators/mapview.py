"""Map points, their bounds and region colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import display


def map_points(sites: DataFrame) -> DataFrame:
    """Sites with both coordinates; tables of the older form have ``managing_unit`` in the place of the forest."""
    region = "forest_name" if "forest_name" in sites.columns else "managing_unit"
    rows = sites.na.drop(subset=["latitude", "longitude"])
    return rows.select("id", "name", F.col(region).alias("forest_name"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("latitude").alias("min_lat"), F.min("longitude").alias("min_lon"), F.max("latitude").alias("max_lat"), F.max("longitude").alias("max_lon"))


def palette(points: DataFrame, colours=display.PALETTE) -> DataFrame:
    """``region, slot, colour``: regions by first appearance (smallest id), colours going round.

    One row a region before the ranking, so the single ordered window sees regions and not points.
    """
    first = points.groupBy(display.region_label(F.col("forest_name")).alias("region")).agg(F.min("id").alias("first_id"))
    slot = (F.dense_rank().over(Window.orderBy("first_id")) - 1) % len(colours)
    rows = first.withColumn("slot", slot.cast("int"))
    return rows.select("region", "slot", F.element_at(F.array(*map(F.lit, colours)), F.col("slot") + 1).alias("colour"))
