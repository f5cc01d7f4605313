"""Filter-first place search with fuzzy ranking.

Order of rows with equal scores is ``pos``: the site's id. Children (status, weather, amenities) fan out as
joined; ``dedupe`` keeps one row a site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import fuzzy, text

COLUMNS = ["id", "name", "forest_name", "latitude", "longitude", "is_open", "forecast", "has_water", "has_restrooms"]


@dataclass
class Tables:
    """Sites with their children; each child is keyed by ``campsite_id``."""

    sites: DataFrame
    status: DataFrame
    weather: DataFrame
    amenities: DataFrame


def filtered(t: Tables, is_open: bool | None = None, has_water: bool | None = None, has_restrooms: bool | None = None, forest: str | None = None) -> DataFrame:
    """The denormalised rows. A flag only filters when true; ``forest`` is a contains-pattern with wildcards."""
    return _with_children(t.sites.alias("c"), t, is_open, has_water, has_restrooms, forest).select(*map(F.col, COLUMNS))


def _with_children(sites: DataFrame, t: Tables, is_open, has_water, has_restrooms, forest) -> DataFrame:
    """Rows of ``sites`` (aliased ``c``), whose columns all stay, with their children's."""
    s, w, a = t.status.alias("s"), t.weather.alias("w"), t.amenities.alias("a")
    rows = sites
    for child, name in ((s, "s"), (w, "w"), (a, "a")):
        rows = rows.join(child, F.col("c.id") == F.col(f"{name}.campsite_id"), "left")
    wanted: Column = F.lit(True)
    if is_open:
        wanted &= F.col("s.is_open")
    if has_water:
        wanted &= F.col("a.water")
    if has_restrooms:
        wanted &= F.col("a.restrooms")
    if forest:
        wanted &= F.lower("c.forest_name").like(text.like_pattern(forest))
    return rows.where(wanted).select(
        "c.*", "s.is_open", F.col("w.forecast_json").alias("forecast"), F.coalesce("a.water", F.lit(False)).alias("has_water"), F.coalesce("a.restrooms", F.lit(False)).alias("has_restrooms"),
    )


def matching(t: Tables, is_open: bool | None = None, has_water: bool | None = None, has_restrooms: bool | None = None, forest: str | None = None) -> DataFrame:
    """The sites that have a row in ``filtered``, each once: children are only asked whether they are there."""
    rows = t.sites.select(*COLUMNS[:5])
    if forest:
        rows = rows.where(F.lower("forest_name").like(text.like_pattern(forest)))
    if is_open:
        rows = rows.join(t.status.where("is_open").select(F.col("campsite_id").alias("_s")), F.col("id") == F.col("_s"), "left_semi")
    # One amenity row has to meet both wishes.
    wanted = [c for c, flag in (("water", has_water), ("restrooms", has_restrooms)) if flag]
    if wanted:
        rows = rows.join(t.amenities.where(" and ".join(wanted)).select(F.col("campsite_id").alias("_a")), F.col("id") == F.col("_a"), "left_semi")
    return rows


def site_score(name: Column, q: str) -> Column:
    """The better of the ratio and the length-adjusted partial ratio; over 100 where the query is longer than the name."""
    share = F.when(F.length(name) > 0, F.lit(float(len(q))) / F.length(name)).otherwise(F.lit(1.0))
    return F.greatest(fuzzy.ratio_to(name, q), fuzzy.partial_to(name, q) * share)


def forest_partial(forest: Column, q: str) -> Column:
    return fuzzy.partial_to(forest, q)


def forest_score(forest: Column, part: Column, q: str) -> Column:
    return F.greatest(part * 0.6, F.when(F.contains(forest, F.lit(q)), F.lit(100.0)).otherwise(F.lit(0.0)))


def scored(rows: DataFrame, sites: DataFrame, query: str) -> DataFrame:
    """``rows`` with ``score``, ``forest_part`` and ``forest_score`` for a query text.

    Each distinct name and forest of ``sites`` is scored once, in a scan of two columns, and joined to the rows.
    """
    q = normalized_query(query)
    names = sites.select("name").distinct().select(F.col("name").alias("_name"), site_score(text.normalize(F.col("name")), q).alias("score"))
    forest = text.normalize(F.col("forest_name"))
    regions = sites.select("forest_name").distinct().select(F.col("forest_name").alias("_forest"), forest.alias("_flat"), forest_partial(forest, q).alias("forest_part"))
    regions = regions.select("_forest", "forest_part", forest_score(F.col("_flat"), F.col("forest_part"), q).alias("forest_score"))
    rows = rows.join(names, F.col("name").eqNullSafe(F.col("_name")))
    return rows.join(regions, F.col("forest_name").eqNullSafe(F.col("_forest"))).drop("_name", "_forest")


def normalized_query(query: str) -> str:
    return "".join(query.lower().split())


def search(t: Tables, query: str | None = None, *, is_open=None, has_water=None, has_restrooms=None, forest=None, fuzzthresh: float = 40, limit: int = 200, dedupe: bool = False) -> DataFrame:
    """Matching sites, best first, with a ``score`` (null without a query).

    A first row of score exactly 100 whose forest does not also match exactly is returned alone. Otherwise, if the
    best forest beats the best site, the sites of the forest nearest to the query; otherwise all sites at or
    above the threshold. Rows of equal scores follow the site's id, then its other columns.
    """
    sites = matching(t, is_open, has_water, has_restrooms, forest)
    if not query:
        first = [F.coalesce("forest_name", F.lit("")), F.col("name")]
        # A page of rows holds no other sites than the first so many, so children are joined to these only.
        page = sites.withColumns({"score": F.lit(None).cast("double"), "mode": F.lit("name")}).orderBy(*first, "id").limit(limit)
        order = [*first, _pos()]
    else:
        page = _best_sites(scored(sites, t.sites, query), fuzzthresh).orderBy(F.desc("score"), "id").limit(limit)
        order = [F.desc("score"), _pos()]
    ids = page.select(F.col("id").alias("_page"))
    shown = Tables(page, *(_of_page(child, ids) for child in (t.status, t.weather, t.amenities)))
    rows = _with_children(page.alias("c"), shown, is_open, has_water, has_restrooms, None)
    if dedupe:
        rest = [c for c in rows.columns if c != "id"]
        rows = rows.groupBy("id").agg(F.min_by(F.struct(*rest), _pos()).alias("r")).select("id", "r.*")
    best = rows.orderBy(*order).limit(limit)
    # An exact hit is one row, also where equal rows fan out; the window sees the rows of one page only.
    best = best.withColumn("place", F.row_number().over(Window.orderBy(*order))).where("mode <> 'exact' or place = 1")
    return best.orderBy("place").select(*COLUMNS[:5], "score", *COLUMNS[5:])


def _pos() -> Column:
    return F.struct("id", F.coalesce("is_open", F.lit(False)).alias("o"), F.coalesce("forecast", F.lit("")).alias("f"), "has_water", "has_restrooms")


def _of_page(child: DataFrame, ids: DataFrame) -> DataFrame:
    """The children of the sites of one page: at most ``limit`` ids, which every task may hold."""
    return child.join(F.broadcast(ids), F.col("campsite_id") == F.col("_page"), "left_semi")


def _best_sites(rows: DataFrame, fuzzthresh: float) -> DataFrame:
    """The rows of ``scored`` sites that the query's mode keeps, with the ``mode``."""
    exact = (F.col("score") == 100) & (F.col("forest_score") != 100)
    near = F.col("forest_score") >= fuzzthresh
    facts = rows.agg(
        F.min(F.when(exact, F.col("id"))).alias("exact"),
        F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("best_site"),
        F.greatest(F.coalesce(F.max("forest_score"), F.lit(0.0)), F.lit(0.0)).alias("best_forest"),
        # Of forests with the best partial ratio the one that comes first.
        F.max_by(F.struct("forest_name"), F.when(near, F.struct("forest_part", (-F.col("id")).alias("p")))).alias("forest"),
    )
    by_forest = (F.col("best_forest") >= fuzzthresh) & (F.col("best_forest") > F.col("best_site"))
    mode = F.when(F.col("exact").isNotNull(), "exact").when(by_forest, "forest").otherwise("name")
    # One row of facts decides what is kept; it is a scalar subquery, so nothing is collected.
    decided = rows.withColumn("d", facts.select(F.struct(mode.alias("mode"), "exact", "forest")).scalar())
    keep = (
        F.when(F.col("d.mode") == "exact", F.col("id") == F.col("d.exact"))
        .when(F.col("d.mode") == "forest", near & F.col("forest_name").eqNullSafe(F.col("d.forest.forest_name")))
        .otherwise(F.col("score") >= fuzzthresh)
    )
    return decided.where(keep).select(*COLUMNS[:5], "score", F.col("d.mode").alias("mode"))


def by_name(t: Tables, query: str, fuzzthresh: float = 40, limit: int = 10) -> DataFrame:
    return search(t, query, fuzzthresh=fuzzthresh, limit=limit)


def forests(sites: DataFrame) -> DataFrame:
    return sites.where("forest_name is not null").select("forest_name").distinct().orderBy("forest_name")


def by_id(sites: DataFrame, site_id: int) -> DataFrame:
    """The point lookup; columns that a table lacks are left out."""
    columns = [c for c in ("id", "name", "latitude", "longitude", "site_url") if c in sites.columns]
    return sites.where(F.col("id") == site_id).select(*columns).limit(1)
