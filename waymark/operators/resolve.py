"""Best-match resolution of sites against nested candidate facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import fuzzy, text
from waymark.operators.similar import similar_names

#: Accepted kind of facility and lowest accepted score.
KIND = "Campground"
ACCEPT = 70


def in_areas(areas: Column, forest: Column, field: str = "RecAreaName") -> Column:
    """Whether a nested area's name contains the forest; without a forest every candidate passes, without areas none."""
    hit = F.exists(F.coalesce(areas, F.array().cast(f"array<struct<{field}:string>>")), lambda a: F.contains(F.lower(F.coalesce(a[field], F.lit(""))), F.lower(forest)))
    return F.when(F.coalesce(forest, F.lit("")) == "", F.lit(True)).otherwise(F.coalesce(hit, F.lit(False)))


def candidates(facilities: DataFrame, name: Column, state: str | None = None, activities: list[int] | None = None, limit: int = 5) -> DataFrame:
    """The request for candidates over a stored table: ``site_id, pos, facility`` of the first ``limit`` a site.

    ``facilities``: site_id, pos, facility, state, activities. ``name`` must be part of the facility's name in any case
    (null or empty: any); ``state`` must be equal, and one of ``activities`` must be among the facility's.
    """
    wanted = F.contains(F.lower(F.coalesce("facility.FacilityName", F.lit(""))), F.lower(F.coalesce(name, F.lit(""))))
    if state is not None:
        wanted &= F.coalesce(F.col("state") == state, F.lit(False))
    if activities is not None:
        wanted &= F.coalesce(F.arrays_overlap("activities", F.array(*map(F.lit, activities))), F.lit(False))
    in_order = Window.partitionBy("site_id").orderBy("pos")
    rows = facilities.where(wanted).withColumn("pos", F.row_number().over(in_order) - 1)
    return rows.where(F.col("pos") < limit).select("site_id", "pos", "facility")


def best_match(sites: DataFrame, candidates: DataFrame, accept: float = ACCEPT, kind: str | None = KIND, per_site: int | None = 5, suffix: str = " campground") -> DataFrame:
    """``site_id, facility, score``: for each site the first candidate with the highest score of at least ``accept``.

    ``candidates``: site_id, pos, facility (a struct with FacilityName, Reservable, FacilityTypeDescription,
    RECAREA). They are blocked by site, so the join is an equi-join; only the ``per_site`` first of a site are
    looked at. The length bound of the ratio drops pairs that can't reach ``accept`` before they are scored.
    """
    if per_site is not None:
        candidates = candidates.where(F.col("pos") < per_site)
    f = F.col("facility")
    a, b = text.normalize_name(F.col("name"), suffix), text.normalize_name(f["FacilityName"], suffix)
    pairs = candidates.join(sites.select(F.col("id").alias("site_id"), "name", "forest_name"), "site_id")
    wanted = F.coalesce(f["Reservable"], F.lit(False)) & in_areas(f["RECAREA"], F.col("forest_name"))
    if kind is not None:
        wanted &= F.coalesce(f["FacilityTypeDescription"] == kind, F.lit(False))
    pairs = pairs.where(wanted).withColumns({"a": a, "b": b})
    la, lb = F.length("a"), F.length("b")
    reach = F.when(la + lb > 0, 200 * F.least(la, lb) / (la + lb)).otherwise(F.lit(100.0))
    pairs = pairs.where(reach >= accept - 1e-9).withColumn("score", fuzzy.token_sort_ratio(F.col("a"), F.col("b")))
    # An aggregate and not a window: candidates of a site are combined before the shuffle.
    pick = F.max_by(F.struct("facility", "score"), F.struct("score", (-F.col("pos")).alias("p")))
    best = pairs.where((F.col("score") >= accept) & (F.col("score") > 0)).groupBy("site_id").agg(pick.alias("m"))
    return best.select("site_id", F.col("m.facility").alias("facility"), F.col("m.score").alias("score"))


def match_unlisted(sites: DataFrame, facilities: DataFrame, accept: float = ACCEPT, kind: str | None = KIND, suffix: str = " campground") -> DataFrame:
    """``site_id, facility, score`` as ``best_match``, where nobody has listed candidates: every facility is one for every site.

    ``sites``: id, name, forest_name; ``facilities``: pos (decides between equal scores), facility. Names meet by
    ``similar_names``. Sites of one name and forest are one question, and facilities of one name and areas one answer (the
    first of them), so a name that a third of all rows have doesn't multiply.
    """
    f = F.col("facility")
    wanted = F.coalesce(f["Reservable"], F.lit(False))
    if kind is not None:
        wanted &= F.coalesce(f["FacilityTypeDescription"] == kind, F.lit(False))
    tokens = lambda c: fuzzy.sorted_tokens(text.normalize_name(c, suffix))
    named = sites.select(F.col("id").alias("site_id"), tokens(F.col("name")).alias("a"), "forest_name")
    asked = named.groupBy("a", "forest_name").agg(F.count("*").alias("n")).drop("n")
    offered = facilities.where(wanted).select("pos", "facility", tokens(f["FacilityName"]).alias("b"), f["RECAREA"].alias("areas"))
    offered = offered.groupBy("b", "areas").agg(F.min_by(F.struct("pos", "facility"), "pos").alias("o"))
    found = similar_names(asked, offered, "a", "b", accept)
    pairs = asked.join(found, "a").join(offered, "b").where(in_areas(F.col("areas"), F.col("forest_name")))
    pick = F.max_by(F.struct("o.facility", "score"), F.struct("score", (-F.col("o.pos")).alias("p")))
    best = pairs.groupBy("a", "forest_name").agg(pick.alias("m")).withColumnRenamed("forest_name", "forest")
    rows = named.join(best.withColumnRenamed("a", "_a"), (F.col("a") == F.col("_a")) & F.col("forest_name").eqNullSafe(F.col("forest")))
    return rows.select("site_id", F.col("m.facility").alias("facility"), F.col("m.score").alias("score"))


def images_of(matches: DataFrame) -> DataFrame:
    """``site_id, image_url, description`` of the matched facilities' media of kind Image."""
    media = F.filter(F.coalesce(F.col("facility.MEDIA"), F.array().cast("array<struct<MediaType:string,URL:string,Title:string>>")), lambda m: m["MediaType"] == "Image")
    return matches.select("site_id", F.explode(media).alias("m")).select("site_id", F.col("m.URL").alias("image_url"), F.col("m.Title").alias("description"))
