"""Requests as keyword arguments, and answers as JSON: the programmatic form of the former routes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import dates, display, weather
from waymark.operators import mapview, search


def search_arguments(args: dict[str, str | None]) -> dict:
    """Only the text ``true`` sets a flag; an unset flag and a false one filter nothing."""
    flag = lambda k: True if args.get(k) == "true" else None
    return {"query": (args.get("query") or "") or None, "is_open": flag("is_open"), "has_water": flag("has_water"), "has_restrooms": flag("has_restrooms"), "forest": args.get("forest") or None}


def search_string(form: dict[str, str | bool | None]) -> str:
    """The query string of a form: the trimmed text and every field that is set."""
    from urllib.parse import urlencode

    pairs = [("query", str(form.get("query") or "").strip())]
    pairs += [(k, "true" if form.get(k) else "") for k in ("is_open", "has_water", "has_restrooms")]
    pairs += [(k, str(form.get(k) or "")) for k in ("forest", "start", "end")]
    return urlencode([(k, v) for k, v in pairs if v])


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def api_search(t: search.Tables, args: dict) -> DataFrame:
    """Matches as JSON; ``LookupError`` if there are none."""
    rows = search.search(t, **search_arguments(args), limit=200)
    if rows.isEmpty():
        raise LookupError("No matches found")
    return as_json(rows)


def api_site(sites: DataFrame, site_id: int) -> dict:
    found = search.by_id(sites, site_id).first()
    if found is None:
        raise LookupError("Campsite not found")
    return found.asDict()


def results(t: search.Tables, args: dict) -> DataFrame:
    """Search results with a weather summary, chips, badges and detail links."""
    rows = search.search(t, **search_arguments(args), limit=200)
    return rows.withColumns(
        {
            "weather_summary": weather.summary(F.col("forecast")),
            "status": display.status_chip(F.col("is_open")),
            "badges": display.badges(F.col("has_water"), F.col("has_restrooms")),
            "link": display.detail_link(F.col("id"), F.lit(args.get("start")), F.lit(args.get("end"))),
        }
    )


def request_day(text: str | None, default: dt.date | None) -> dt.date | None:
    """A day of a request; ``ValueError`` for other text."""
    return dt.datetime.strptime(text, "%Y-%m-%d").date() if text else default


def weather_range(sites: DataFrame, recorded: DataFrame, site_id: int | None, start: str | None, end: str | None, today: dt.date) -> DataFrame:
    """One row: site_id, lat, lon and the forecasts of the range in order, from recorded rows (id, day, forecast).

    Without an end just the first day; an end before the start gives no day. ``ValueError`` without an id or with a
    bad date, ``LookupError`` for an unknown site.
    """
    if site_id is None:
        raise ValueError("site_id is required")
    site = sites.where(F.col("id") == site_id)
    if site.isEmpty():
        raise LookupError("Campsite not found")
    first = request_day(start, today)
    last = request_day(end, None) or first
    spans = site.select(F.col("id").alias("site_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(first).alias("first"), F.lit(last).alias("last"))
    return forecast_ranges(spans, recorded)


def forecast_ranges(spans: DataFrame, recorded: DataFrame) -> DataFrame:
    """``site_id, lat, lon, forecast`` for each of ``spans`` (site_id, lat, lon, first, last): the recorded forecasts of its days in order.

    ``recorded``: id, day, forecast. A day without one is left out; a span that ends before it begins has no day, and an empty list.
    """
    wanted = spans.select("site_id", "lat", "lon", F.explode_outer(dates.days(F.col("first"), F.col("last"))).alias("day"))
    rows = wanted.join(recorded.select(F.col("id").alias("site_id"), "day", "forecast"), ["site_id", "day"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("forecast").isNotNull(), F.struct("day", "forecast"))))
    return rows.groupBy("site_id", "lat", "lon").agg(F.transform(ordered, lambda x: x["forecast"]).alias("forecast"))


def detail_forecast(site: DataFrame, stored: DataFrame, start: Column, end: Column) -> DataFrame:
    """``site_id, summaries`` of a detail page: the summaries of the range's days in order, at least the first day.

    ``site``: id, latitude, longitude; ``stored``: lat, lon, day, forecast. All or nothing: one day without a stored
    forecast empties the list, as a failed call does; days whose forecast has no summary are left out.
    """
    wanted = site.select(F.col("id").alias("site_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.explode(dates.days(start, end, least=1)).alias("day"))
    rows = wanted.join(stored.select("lat", "lon", "day", "forecast", F.lit(True).alias("hit")), ["lat", "lon", "day"], "left")
    made = F.struct("day", weather.summary(F.col("forecast")).alias("s"))
    listed = F.transform(F.filter(F.array_sort(F.collect_list(made)), lambda x: x["s"].isNotNull()), lambda x: x["s"])
    return rows.groupBy("site_id").agg(F.when(F.bool_and(F.coalesce("hit", F.lit(False))), listed).otherwise(F.slice(listed, 1, 0)).alias("summaries"))


def api_map(sites: DataFrame) -> DataFrame:
    return as_json(mapview.map_points(sites))
