"""Weather documents: flattening, summaries and the sky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(raw: Column) -> Column:
    """A day of the forecast service: missing branches and bad text give nulls."""
    j = F.try_parse_json(raw)

    def number(path: str) -> Column:
        return F.try_variant_get(j, path, "double")

    return F.struct(
        F.try_variant_get(j, "$.date", "string").alias("date"),
        number("$.precipitation.total").alias("precipitation_total"),
        number("$.temperature.min").alias("temp_min"),
        number("$.temperature.max").alias("temp_max"),
        number("$.cloud_cover.afternoon").alias("cloud_cover_afternoon"),
    )


def by_place(raw: DataFrame, version: list[str]) -> DataFrame:
    """``lat, lon, day, forecast``: the stored document (JSON text) of each place and day, the one of the largest version.

    ``raw``: lat, lon, day, raw (a response of the forecast service) and the version's columns.
    """
    latest = raw.groupBy("lat", "lon", "day").agg(F.max_by("raw", F.struct(*version)).alias("raw"))
    return latest.select("lat", "lon", "day", F.to_json(flatten(F.col("raw"))).alias("forecast"))


def sky(clouds: Column) -> Column:
    """Null stays null; a value that is no number counts as clouded."""
    return F.when(clouds.isNotNull(), F.when(clouds < 25, "mostly clear").when(clouds < 60, "partly cloudy").otherwise("cloudy"))


def summary(stored: Column, clouds: str = "cloud_cover_afternoon") -> Column:
    """``date, high, low, precip_in, sky`` of a stored document, or of the first of a stored array; null unless it is an
    object that is not empty. The text is parsed once."""

    def of(day: Column) -> Column:
        kind = F.schema_of_variant(day)
        field = lambda name, as_: F.try_variant_get(day, f"$.{name}", as_)
        return F.when(
            F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>"),
            F.struct(
                field("date", "string").alias("date"),
                field("temp_max", "double").alias("high"),
                field("temp_min", "double").alias("low"),
                field("precipitation_total", "double").alias("precip_in"),
                sky(field(clouds, "double")).alias("sky"),
            ),
        )

    parsed = F.transform(F.array(F.try_parse_json(stored)), lambda j: F.coalesce(F.try_variant_get(j, "$[0]", "variant"), j))
    return F.get(F.transform(parsed, of), F.lit(0))


def round_binary(x: Column, places: int = 2) -> Column:
    """``x`` to so many places (1 to 5) by its exact binary value, halves to even: 2.675, which lies below its text, gives 2.67.

    Only where the text of the number ends in a 5 behind the places can the two differ. There the exact product with a
    power of ten, as a rounded one and its error, tells on which side of the text the number lies.
    """
    scale = float(10 ** (places + 1))
    texts = F.round(x * scale, 0)
    tie = (F.pmod(F.abs(texts), F.lit(10.0)) == 5) & (texts / scale == x) & (F.abs(texts) < 2.0**50)
    wide = x * 134217729.0  # splits the 53 bits of a double in two halves, whose products with the scale are exact
    high = wide - (wide - x)
    product = x * scale
    above = (product - texts) + ((high * scale - product) + (x - high) * scale)
    near = lambda d: (texts + d) / 10 / (scale / 10)
    return F.when(tie & (above > 0), near(5.0)).when(tie & (above < 0), near(-5.0)).otherwise(F.bround(x, places))


def weather_line(sky_: Column, high: Column, low: Column, precip: Column) -> Column:
    """The line of a result card: sky, rounded high and low if both are there, precipitation with two places."""
    one = lambda x: F.bround(x, 0).cast("decimal(20,1)").cast("string")
    degrees = F.when(high.isNotNull() & low.isNotNull(), F.concat(F.lit("High "), one(high), F.lit("° / Low "), one(low), F.lit("°")))
    wet = F.when(precip.isNotNull(), F.concat(round_binary(precip).cast("string"), F.lit(" in precip")))
    return F.concat_ws(" · ", F.nullif(sky_, F.lit("")), degrees, wet)
