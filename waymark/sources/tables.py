"""Schemas of the place catalogue and readers that lay it over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t[0] if isinstance(t, tuple) else t, not isinstance(t, tuple)) for n, t in fields.items()])


#: A type in a tuple is not nullable.
SITES = _struct(
    id=(_I,), name=(_S,), forest_name=_S, managing_unit=_S, latitude=T.DecimalType(9, 6), longitude=T.DecimalType(9, 6), address=_S, reservation_type=_S, fs_usda_url=_S,
    site_url=_S, reservation_url=_S, contact_name=_S, contact_phone=_S, seasons_of_use=_S, num_sites=_I, fee=_S, primary_image_url=_S, overview=_S, recreation_facility_id=_S,
)
AMENITIES = _struct(id=_I, campsite_id=_I, water_activities=_B, boating=_B, water=_B, restrooms=_B, amenities=_S, body_of_water=_B)
IMAGES = _struct(id=_I, campsite_id=_I, image_url=(_S,), description=_S)
STATUS = _struct(id=_I, campsite_id=_I, is_open=_B, fire_restrictions=_S, last_checked=_TS)
WEATHER = _struct(id=_I, campsite_id=_I, forecast_json=_S, last_updated=_TS)
AVAILABILITY = _struct(id=_I, campsite_id=_I, is_available=_B, availability_raw=_S, last_checked=_TS)
CATALOGUE = {"campsites": SITES, "amenities": AMENITIES, "images": IMAGES, "status_updates": STATUS, "weather_forecasts": WEATHER, "availability": AVAILABILITY}


def create_catalogue(spark: SparkSession, root: str) -> None:
    """Empty Parquet tables of the catalogue under ``root``; tables that exist stay as they are."""
    for name, schema in CATALOGUE.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to all shuffle partitions, for small rows with much work before them: files and adaptive plans go by bytes and would make one task of many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# The catalogue seen in the star schema: parts as sites, line items as status reports, events as weather.


def sites(spark: SparkSession, root: str) -> DataFrame:
    p = read(spark, root, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.nullif("p_type", F.lit("STANDARD")).alias("forest_name"),
        (F.col("p_retailprice") % 90).alias("latitude"),
        (F.col("p_size") * F.lit(-2.5)).alias("longitude"),
    )


def status_reports(spark: SparkSession, root: str) -> DataFrame:
    """Many reports a site; returned items tell nothing, so some sites have none."""
    rows = read(spark, root, "lineitem").where("l_returnflag <> 'R'")
    return rows.select(F.col("l_partkey").alias("campsite_id"), (F.col("l_linestatus") == "O").alias("is_open"))


def status(spark: SparkSession, root: str) -> DataFrame:
    """One row a site: open if any report says so."""
    return status_reports(spark, root).groupBy("campsite_id").agg(F.bool_or("is_open").alias("is_open"))


def amenities(spark: SparkSession, root: str) -> DataFrame:
    """Large sites have no amenity row."""
    p = read(spark, root, "part").where("p_size <= 40")
    return p.select(F.col("p_partkey").alias("campsite_id"), (F.col("p_size") < 25).alias("water"), (F.col("p_brand") < "Brand#3").alias("restrooms"))


def weather(spark: SparkSession, root: str) -> DataFrame:
    """The latest report for each site, as stored text."""
    e = read(spark, root, "events")
    latest = F.max_by("props", F.struct("ts", "event_id")).alias("forecast_json")
    return e.groupBy(F.col("user_id").alias("campsite_id")).agg(latest)
