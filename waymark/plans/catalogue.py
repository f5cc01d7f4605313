"""Every registered query of the library with its SQL. ``(spark, root) -> DataFrame``; root holds the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import dates, display, fuzzy, text, weather
from waymark.operators import changes, mapview, resolve, search
from waymark.plans import joins, requests, runs  # noqa: F401  some register their queries
from waymark.plans import oracle as o
from waymark.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from waymark.sources import page_function, pages, tables
from waymark.sources.shared import new_path
from waymark.streaming import latest

def catalogue(spark: SparkSession, root: str, status=tables.status) -> search.Tables:
    return search.Tables(tables.sites(spark, root), status(spark, root), tables.weather(spark, root), tables.amenities(spark, root))


# Lookups and the map


@query(f"with {o.SITES} select id, name, latitude, longitude from sites where id = 42")
def point_lookup(spark, root):
    return search.by_id(tables.sites(spark, root), 42)


@query(f"with {o.SITES} select distinct forest_name from sites where forest_name is not null order by 1")
def distinct_forests(spark, root):
    return search.forests(tables.sites(spark, root))


@query(f"with {o.SITES} select id, name, forest_name, latitude, longitude from sites where latitude is not null and longitude is not null")
def map_points(spark, root):
    return mapview.map_points(tables.sites(spark, root))


@query(f"with {o.SITES} select min(latitude) as min_lat, min(longitude) as min_lon, max(latitude) as max_lat, max(longitude) as max_lon from sites")
def map_bounds(spark, root):
    return mapview.bounds(mapview.map_points(tables.sites(spark, root)))


_COLOURS = "[" + ", ".join(f"'{c}'" for c in display.PALETTE) + "]"


@query(
    f"with {o.SITES}, r as (select coalesce(nullif(forest_name, ''), 'Other') as region, min(id) as f from sites group by 1), "
    f"s as (select region, ((dense_rank() over (order by f) - 1) % 6)::int as slot from r) select region, slot, {_COLOURS}[slot + 1] as colour from s"
)
def map_palette(spark, root):
    return mapview.palette(mapview.map_points(tables.sites(spark, root)))


@query(f"with {o.SITES} select id, name, name as forest_name, latitude, longitude from sites")
def column_fallback(spark, root):
    old = tables.sites(spark, root).drop("forest_name").withColumn("managing_unit", F.col("name"))
    return mapview.map_points(old)


# Search


@query(
    f"with {o.filtered("s.is_open and a.water and lower(c.forest_name) like '%o%'")} "
    "select id, name, forest_name, latitude, longitude, null::double as score, is_open, forecast, has_water, has_restrooms from rows_ order by coalesce(forest_name, ''), name, id limit 200"
)
def search_filter_only(spark, root):
    return search.search(catalogue(spark, root), is_open=True, has_water=True, forest=" O")


@query(f"with {o.filtered('a.restrooms', 'reports')} select * from rows_")
def search_fanout(spark, root):
    return search.filtered(catalogue(spark, root, tables.status_reports), has_restrooms=True)


@query(f"with {o.filtered("lower(c.forest_name) like '%_o%m%'")} select * from rows_")
def search_like_wildcards(spark, root):
    return search.filtered(catalogue(spark, root), forest="_O%m ")


@query(o.search("smll rng"))
def search_name_mode(spark, root):
    return search.search(catalogue(spark, root), "smll rng")


@query(o.search("promo", "s.is_open"))
def search_forest_mode(spark, root):
    return search.search(catalogue(spark, root), "Promo", is_open=True)


@query(o.search("small ring"))
def search_exact_hit(spark, root):
    return search.search(catalogue(spark, root), "Small Ring")


@query(o.search("small ring", status="reports"))
def search_exact_fanout(spark, root):
    """Sites with many status reports: the exact hit is still one row."""
    return search.search(catalogue(spark, root, tables.status_reports), "Small Ring")


@query(o.search("smll rng", "a.water", status="reports"))
def search_name_fanout(spark, root):
    return search.search(catalogue(spark, root, tables.status_reports), "smll rng", has_water=True)


@query(o.search("small ring with extras"))
def search_long_query(spark, root):
    return search.search(catalogue(spark, root), "small ring with extras")


@query(o.search("zzz"))
def search_nothing(spark, root):
    return search.search(catalogue(spark, root), "zzz")


@query(o.search("  "))
def search_blank(spark, root):
    return search.search(catalogue(spark, root), "  ")


# Similarity


@query(f"select distinct p_name as name, {o.ratio('p_name', "'small ring'")} as score from part")
def fuzzy_ratio(spark, root):
    names = tables.read(spark, root, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("score", fuzzy.ratio_to(F.col("name"), "small ring"))


@query(
    "with n as (select distinct p_name as name, p_brand as brand from part), "
    "t as (select name, brand, array_to_string(list_sort(string_split(name, ' ')), ' ') as a, array_to_string(list_sort(string_split(lower(brand) || ' ring', ' ')), ' ') as b from n) "
    f"select name, brand, {o.ratio('a', 'b')} as score from t"
)
def fuzzy_token_sort(spark, root):
    names = tables.read(spark, root, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).distinct()
    return names.withColumn("score", fuzzy.token_sort_ratio(F.col("name"), F.concat(F.lower("brand"), F.lit(" ring"))))


@query(f"with {o.partials('part', 'p_name', 'red plate')} select x as name, p as score from part")
def fuzzy_partial(spark, root):
    names = tables.read(spark, root, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("score", fuzzy.partial_to(F.col("name"), "red plate"))


@query(
    f"with {o.partials('part', 'p_name', 'small')}, r as (select x, {o.ratio('x', "'small'")} as r from texts) "
    "select p.x as name, r.r as token_score, p.p * (5.0::double / length(p.x)) as adjusted, greatest(r.r, p.p * (5.0::double / length(p.x))) as score, "
    "greatest(p.p * 0.6::double, case when contains(p.x, 'small') then 100.0 else 0.0 end) as forest_score from part p join r on p.x = r.x"
)
def score_parts(spark, root):
    names = tables.read(spark, root, "part").select(F.col("p_name").alias("name")).distinct()
    n = F.col("name")
    rows = names.withColumns({"token_score": fuzzy.ratio_to(n, "small"), "part": fuzzy.partial_to(n, "small")})
    rows = rows.withColumn("adjusted", F.col("part") * (F.lit(5.0) / F.length(n))).withColumn("score", F.greatest("token_score", "adjusted"))
    return rows.withColumn("forest_score", search.forest_score(n, F.col("part"), "small")).drop("part")


@query(
    "with l as (select l_orderkey, l_linenumber, l_partkey, l_linestatus, l_returnflag from lineitem), "
    "c as (select a.l_partkey as site_id, row_number() over (partition by a.l_partkey order by a.l_orderkey, a.l_linenumber, b.l_partkey) - 1 as pos, "
    "b.l_partkey as fid, b.l_linestatus = 'O' as reservable, case when b.l_returnflag = 'A' then 'Trail' else 'Campground' end as kind "
    "from l a join l b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber - 1), "
    "k as (select c.*, s.p_name as name, nullif(s.p_type, 'STANDARD') as forest, f.p_name as fname, f.p_type as area from c join part s on s.p_partkey = site_id join part f on f.p_partkey = fid where pos < 5), "
    "n as (select *, case when ends_with(name, ' ring') then replace(name, ' ring', '') else name end as na, case when ends_with(fname, ' ring') then replace(fname, ' ring', '') else fname end as nb from k "
    "where reservable and kind = 'Campground' and (forest is null or contains(lower(area), lower(forest)))), "
    "t as (select *, array_to_string(list_sort(string_split(na, ' ')), ' ') as a, array_to_string(list_sort(string_split(nb, ' ')), ' ') as b from n), "
    f"s as (select site_id, pos, fid, fname, {o.ratio('a', 'b')} as score from t), "
    "r as (select *, row_number() over (partition by site_id order by score desc, pos) as rn from s where score >= 70) select site_id, fid::varchar as facility_id, fname as facility_name, score from r where rn = 1"
)
def resolve_best_match(spark, root):
    """Candidates of a site are the parts on the next line of its orders; the first five count."""
    m = resolve.best_match(tables.sites(spark, root), facility_candidates(spark, root), suffix=" ring")
    return m.select("site_id", F.col("facility.FacilityID").alias("facility_id"), F.col("facility.FacilityName").alias("facility_name"), "score")


def facility_candidates(spark: SparkSession, root: str) -> DataFrame:
    lines = tables.read(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") == F.col("b.l_linenumber") - 1))
    rows = pairs.select(F.col("a.l_partkey").alias("site_id"), F.col("a.l_orderkey").alias("ok"), F.col("a.l_linenumber").alias("ln"), F.col("b.l_partkey").alias("fid"), F.col("b.l_linestatus").alias("ls"), F.col("b.l_returnflag").alias("rf"))
    first = Window.partitionBy("site_id").orderBy("ok", "ln", "fid")
    rows = rows.withColumn("pos", F.row_number().over(first) - 1).where("pos < 5")
    part = tables.read(spark, root, "part").select(F.col("p_partkey").alias("fid"), "p_name", "p_type")
    facility = F.struct(
        F.col("fid").cast("string").alias("FacilityID"),
        F.col("p_name").alias("FacilityName"),
        (F.col("ls") == "O").alias("Reservable"),
        F.when(F.col("rf") == "A", "Trail").otherwise("Campground").alias("FacilityTypeDescription"),
        F.array(F.struct(F.col("p_type").alias("RecAreaName"))).alias("RECAREA"),
    )
    return rows.join(part, "fid").select("site_id", "pos", facility.alias("facility"))


# Weather


@query(
    "with w as (select event_id, try_cast(json_extract_string(props, '$.k') as double) as c from events) select event_id, null::varchar as date, null::double as high, null::double as low, null::double as precip_in, "
    "case when c is null then null when c < 25 then 'mostly clear' when c < 60 then 'partly cloudy' else 'cloudy' end as sky from w"
)
def weather_summary(spark, root):
    rows = tables.read(spark, root, "events").select("event_id", weather.summary(F.col("props"), "k").alias("s"))
    return rows.select("event_id", "s.*")


@query(
    "with e as (select user_id, ts::date as day, arg_max(props, (ts, event_id)) as props from events group by 1, 2), u as (select user_id, min(day) as s from e group by 1), "
    "d as (select user_id, unnest(generate_series(s, s + interval 6 day, interval 1 day))::date as day from u) "
    "select d.user_id as site_id, count(*) as days, sum(coalesce(json_extract_string(props, '$.k')::bigint, 0))::bigint as clouds, "
    "coalesce(string_agg(strftime(d.day, '%Y-%m-%d') || '=' || json_extract_string(props, '$.k'), ';' order by d.day), '') as forecast from d left join e on d.user_id = e.user_id and d.day = e.day group by 1"
)
def weather_range(spark, root):
    """Seven days from each site's first one; days without a report stay out of the list."""
    e = tables.read(spark, root, "events").withColumn("day", F.to_date("ts"))
    reports = e.groupBy(F.col("user_id").alias("site_id"), "day").agg(F.max_by("props", F.struct("ts", "event_id")).alias("forecast"))
    first = e.groupBy(F.col("user_id").alias("site_id")).agg(F.min("day").alias("s"))
    wanted = first.select("site_id", F.explode(dates.days(F.col("s"), F.date_add("s", 6))).alias("day"))
    k = F.try_variant_get(F.try_parse_json("forecast"), "$.k", "bigint")
    rows = wanted.join(reports, ["site_id", "day"], "left").withColumn("k", k)
    listed = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("="), F.col("k").cast("string")))))
    return rows.groupBy("site_id").agg(F.count("*").alias("days"), F.sum(F.coalesce("k", F.lit(0))).alias("clouds"), F.array_join(listed, ";").alias("forecast"))


@query(
    f"with {o.filtered()} select id, case when is_open then 'Open' else 'Closed' end as status, case when has_water and has_restrooms then 'Water,Restrooms' when has_water then 'Water' when has_restrooms then 'Restrooms' else 'No amenities listed' end as badges, "
    "'cloudy · High ' || round_even(latitude, 0)::decimal(20,1)::varchar || '° / Low ' || round_even(longitude, 0)::decimal(20,1)::varchar || '°' as line from rows_"
)
def status_badges(spark, root):
    rows = search.filtered(catalogue(spark, root))
    line = weather.weather_line(F.lit("cloudy"), F.col("latitude"), F.col("longitude"), F.lit(None).cast("double"))
    return rows.select("id", display.status_chip(F.col("is_open")).alias("status"), F.array_join(display.badges(F.col("has_water"), F.col("has_restrooms")), ",").alias("badges"), line.alias("line"))


@query(
    "with w as (select event_id, user_id % 40 as lat, -(user_id % 25) as lon, ts::date as day, value, json_extract_string(props, '$.k')::double as k from events), "
    "u as (select *, row_number() over (partition by lat, lon, day order by event_id desc) as r from w) "
    "select lat::double as lat, lon::double as lon, day, strftime(day, '%Y-%m-%d') as date, k + 1.5 as high, k - 3.25 as low, k / 16 as precip_in, case when k < 25 then 'mostly clear' when k < 60 then 'partly cloudy' else 'cloudy' end as sky, "
    "(case when k < 25 then 'mostly clear' when k < 60 then 'partly cloudy' else 'cloudy' end) || ' · High ' || round_even(k + 1.5, 0)::decimal(20,1)::varchar || '° / Low ' || round_even(k - 3.25, 0)::decimal(20,1)::varchar || '° · ' "
    "|| round_even(k / 16, 2)::varchar || ' in precip' as line from u where r = 1"
)
def weather_cards(spark, root):
    """Raw forecast documents of places and days, the last one of each, flattened, stored and shown."""
    e, k = tables.read(spark, root, "events"), F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    day = F.to_date("ts")
    raw = F.to_json(
        F.struct(
            F.date_format(day, "yyyy-MM-dd").alias("date"), F.struct((k / 16).alias("total")).alias("precipitation"), F.struct((k - 3.25).alias("min"), (k + 1.5).alias("max")).alias("temperature"), F.struct(k.alias("afternoon")).alias("cloud_cover")
        )
    )
    rows = e.select((F.col("user_id") % 40).cast("double").alias("lat"), (-(F.col("user_id") % 25)).cast("double").alias("lon"), day.alias("day"), raw.alias("raw"), "event_id")
    stored = weather.by_place(rows, ["event_id"])
    shown = stored.select("lat", "lon", "day", weather.summary(F.col("forecast")).alias("s")).select("lat", "lon", "day", "s.*")
    return shown.withColumn("line", weather.weather_line(F.col("sky"), F.col("high"), F.col("low"), F.col("precip_in")))


# Links and boxes


@query(f"with {o.SITES} select id, latitude + 0.0145::double as top, longitude - 0.0145::double as \"left\", latitude - 0.0145::double as bottom, longitude + 0.0145::double as \"right\" from sites")
def bbox_numeric(spark, root):
    rows = tables.sites(spark, root).select("id", display.box(F.col("latitude"), F.col("longitude")).alias("b"))
    return rows.select("id", "b.*")


@query()
def bbox_url(spark, root):
    """Rows only: double to text differs between engines in the exponent range."""
    return tables.sites(spark, root).select("id", display.box_url(F.col("latitude"), F.col("longitude"), "https://maps.example/explore").alias("url"))


@query(
    "select o_orderkey as id, '/campsite/' || o_orderkey || case when o_orderstatus = 'F' then '?end=' || strftime(o_orderdate, '%Y-%m-%d') when o_orderstatus = 'O' then '?start=' || strftime(o_orderdate, '%Y-%m-%d') || '&end=' || strftime(o_orderdate, '%Y-%m-%d') else '' end as link from orders"
)
def detail_link(spark, root):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    start, end = F.when(F.col("o_orderstatus") == "O", day), F.when(F.col("o_orderstatus").isin("O", "F"), day)
    return tables.read(spark, root, "orders").select(F.col("o_orderkey").alias("id"), display.detail_link(F.col("o_orderkey"), start, end).alias("link"))


@query(
    "with n as (select c_custkey as id, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1) "
    "select id, case when n > 0 then 'https://book.example/' || id end as url, (case when n > 0 then n else 0 end)::int as num_sites from n"
)
def reservation_fields(spark, root):
    orders = tables.read(spark, root, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = tables.read(spark, root, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    made = display.reservation(F.col("c_custkey").cast("string"), F.col("n"), "https://book.example/")
    return rows.select(F.col("c_custkey").alias("id"), made.alias("r")).select("id", "r.*")


# Text


@query("select page_id, string_split(regexp_replace(url, '/+$', ''), '/')[-1] as tail from pages")
def url_tail(spark, root):
    return tables.read(spark, root, "pages").select("page_id", text.url_tail(F.col("url")).alias("tail"))


@query(r"select page_id, case when length(html) > 0 then regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^[\s\x1c-\x1f\x{85}\x{a0}\p{Z}]+', ''), '[\s\x1c-\x1f\x{85}\x{a0}\p{Z}]+$', '') end as text from pages")
def strip_html(spark, root):
    return tables.read(spark, root, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"select doc_id, regexp_replace(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') as flat from documents")
def normalize_text(spark, root):
    return tables.read(spark, root, "documents").select("doc_id", text.normalize(F.col("text")).alias("flat"))


@query(
    "select p_partkey as id, case when ends_with(lower(p_name), ' ring') then replace(lower(p_name), ' ring', '') else lower(p_name) end as name, length(p_name)::int as n, contains(p_name, 'ring') as has, trim(replace(p_name, 'small', '')) as rest from part"
)
def name_suffix(spark, root):
    n = F.col("p_name")
    return tables.read(spark, root, "part").select(
        F.col("p_partkey").alias("id"), text.normalize_name(n, " ring").alias("name"), F.length(n).alias("n"), F.contains(n, F.lit("ring")).alias("has"), text.without_label(n, "small").alias("rest")
    )


# Changes


@query(
    "with o as (select c_custkey as site, c_mktsegment as forecast, timestamp '2024-01-01 00:00:00' as last_updated from customer), "
    "n as (select o_custkey as site, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as forecast from orders group by 1 order by 1 limit 5) "
    "select o.site, coalesce(n.forecast, o.forecast) as forecast, case when n.site is not null then timestamp '2024-05-05 12:00:00' else last_updated end as last_updated from o left join n on o.site = n.site"
)
def refresh_limited(spark, root):
    """A refresh of the first five sites that have news, stamped with the time it is given."""
    old = tables.read(spark, root, "customer").select(F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("forecast"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_updated"))
    latest_orders = tables.read(spark, root, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("forecast"))
    return changes.refresh(old, latest_orders, "site", F.lit("2024-05-05 12:00:00").cast("timestamp_ntz"), limit=5)


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts, arg_max(props, (ts, event_id)) as props from events group by 1")
def upsert_latest(spark, root):
    e = tables.read(spark, root, "events").select("user_id", "event_id", "ts", "props", "event_type")
    old, new = e.where("event_type = 'click'"), e.where("event_type <> 'click'")
    return changes.upsert_latest(old.drop("event_type"), new.drop("event_type"), "user_id", ["ts", "event_id"])


@query(
    "with m as (select o_custkey, nullif(arg_max(o_orderstatus, (o_orderdate, o_orderkey)), 'P') as s, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as t from orders group by 1) "
    "select c_custkey, c_name, c_nationkey, case when o_custkey is not null then t else c_acctbal end as c_acctbal, case when o_custkey is not null then s else c_mktsegment end as c_mktsegment from customer left join m on c_custkey = o_custkey"
)
def update_from_match(spark, root):
    last = tables.read(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    matches = last.select("c_custkey", F.nullif("x.o_orderstatus", F.lit("P")).alias("c_mktsegment"), F.col("x.o_totalprice").alias("c_acctbal"))
    return changes.update_matched(tables.read(spark, root, "customer"), matches, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query(
    "with old as (select o_custkey as site, o_orderpriority as url from orders), new as (select c_custkey as site, '1-URGENT' as url from customer) "
    "select * from old union all select distinct * from new n where not exists (select 1 from old where old.site = n.site and old.url = n.url)"
)
def insert_ignore(spark, root):
    old = tables.read(spark, root, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderpriority").alias("url"))
    new = tables.read(spark, root, "customer").select(F.col("c_custkey").alias("site"), F.lit("1-URGENT").alias("url"))
    return changes.insert_ignore(old, new, ["site", "url"])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def cascade(spark, root):
    lines = tables.read(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return changes.cascade(lines, tables.read(spark, root, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("select page_id, url, string_split(regexp_replace(url, '/+$', ''), '/')[-1] as forest_name from pages")
def update_pure(spark, root):
    p = tables.read(spark, root, "pages").select("page_id", "url")
    return changes.update_column(p, "forest_name", text.url_tail(F.col("url")))


@query("select *, null::varchar as forest_name from region")
def add_column_if_missing(spark, root):
    return changes.add_column(changes.add_column(tables.read(spark, root, "region"), "forest_name"), "r_name")


_FILES = [c for c in dict.fromkeys([*changes.CSV_COLUMNS.values(), *changes.CSV_AMENITIES.values()]) if c]


@query("select " + ", ".join(f"{'null::varchar' if c is None else f'c_name || {chr(39)}/{c}{chr(39)}'} as {new}" for new, c in {**changes.CSV_COLUMNS, **changes.CSV_AMENITIES}.items()) + " from customer")
def csv_columns(spark, root):
    """All pairs of names, of the sites' table and of the amenities'."""
    files = tables.read(spark, root, "customer").select(*[F.concat("c_name", F.lit(f"/{c}")).alias(c) for c in _FILES])
    return changes.from_csv(files, {**changes.CSV_COLUMNS, **changes.CSV_AMENITIES})


@query(
    "select c_name as name, null::varchar as num_sites, c_mktsegment as address, c_name as contact_name, 'Unknown' as park from customer"
)
def csv_rename(spark, root):
    rows = tables.read(spark, root, "customer").withColumn("park_name", F.lit("Unknown"))
    return changes.from_csv(rows, {"name": "c_name", "num_sites": None, "address": "c_mktsegment", "contact_name": "c_name", "park": "park_name"})


# Nested values


@query(
    "with c as (select p_brand as site, p_partkey as pos, p_partkey::varchar as fid, p_name as fname, case when p_size % 2 = 0 then 'CA' else 'NV' end as state, p_size % 10 as activity from part), "
    "k as (select site, fid, fname, row_number() over (partition by site order by pos) as r from c where state = 'CA' and activity in (6, 8) and contains(lower(fname), 'ring')) select site, (r - 1)::int as pos, fid as facility_id, fname as facility_name from k where r <= 5"
)
def candidate_request(spark, root):
    p = tables.read(spark, root, "part")
    facility = F.struct(F.col("p_partkey").cast("string").alias("FacilityID"), F.col("p_name").alias("FacilityName"))
    table = p.select(
        F.col("p_brand").alias("site_id"), F.col("p_partkey").alias("pos"), facility.alias("facility"), F.when(F.col("p_size") % 2 == 0, "CA").otherwise("NV").alias("state"), F.array(F.col("p_size") % 10, F.lit(99)).alias("activities")
    )
    asked = resolve.candidates(table, F.lit("Ring"), state="CA", activities=[6, 8], limit=5)
    return asked.select(F.col("site_id").alias("site"), F.col("pos").cast("int").alias("pos"), F.col("facility.FacilityID").alias("facility_id"), F.col("facility.FacilityName").alias("facility_name"))


@query("select l_orderkey as id, bool_or(contains(lower(l_returnflag), 'a')) as hit, count(*) as n from lineitem group by 1")
def nested_any(spark, root):
    lines = tables.read(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("RecAreaName"))).alias("areas"))
    return lines.select("id", resolve.in_areas(F.col("areas"), F.lit("A")).alias("hit"), F.size("areas").cast("long").alias("n"))


@query("select l_orderkey as site_id, 'u' || l_linenumber as image_url, l_linestatus as description from lineitem where l_returnflag = 'N'")
def media_explode(spark, root):
    kind = F.when(F.col("l_returnflag") == "N", "Image").otherwise("Video")
    media = F.struct(kind.alias("MediaType"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("URL"), F.col("l_linestatus").alias("Title"))
    rows = tables.read(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg(F.collect_list(media).alias("MEDIA"))
    return resolve.images_of(rows.select("site_id", F.struct("MEDIA").alias("facility")))


_LISTS = ("/en/", "/fr/", "/e")


@query(" union all ".join(f"select url as slug, string_split(regexp_replace(url, '/+$', ''), '/')[-1] as name from pages where contains(url, '{part}')" for part in _LISTS))
def seed_union(spark, root):
    """Three lists of pages to fetch, one after the other: what is on two of them stays twice."""
    p = tables.read(spark, root, "pages")
    return pages.seed_rows(*[p.where(F.contains("url", F.lit(part))).select(F.col("url").alias("slug")) for part in _LISTS])


@query(
    "select event_id, json_extract_string(props, '$.k')::bigint as k, coalesce(json_extract_string(props, '$.missing'), 'UNKNOWN') as missing, event_type as kind, false as is_empty from events"
)
def json_roundtrip(spark, root):
    e = tables.read(spark, root, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    stored = e.select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("j"))
    v = F.try_parse_json("j")
    return stored.select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("UNKNOWN")).alias("missing"), F.try_variant_get(v, "$.kind", "string").alias("kind"), (F.col("j").isNull() | (F.col("j") == "{}")).alias("is_empty")
    )


@query(
    "with x as (select o_orderkey as id, case o_orderstatus when 'P' then strftime(o_orderdate, '%Y-%-m-%-d') when 'F' then strftime(o_orderdate, '%Y-%m-%d') else 'x' || strftime(o_orderdate, '%Y-%m-%d') end as t from orders), "
    "d as (select id, try_strptime(t, '%Y-%m-%d')::date as d from x) select id, d as day, coalesce(d, date '2000-01-01') as start_day, strftime(coalesce(d, date '2000-01-01'), '%Y-%m-%d') as shown, greatest(datediff('day', coalesce(d, date '2000-01-01'), coalesce(d, date '2000-01-01') - 1) + 1, 1)::int as days from d"
)
def date_parse(spark, root):
    day = F.col("o_orderdate")
    shown = F.when(F.col("o_orderstatus") == "P", F.date_format(day, "yyyy-M-d")).when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.lit("x"), F.date_format(day, "yyyy-MM-dd")))
    rows = tables.read(spark, root, "orders").select(F.col("o_orderkey").alias("id"), shown.alias("t"))
    rows = rows.withColumn("day", dates.parse(F.col("t"))).withColumn("start_day", dates.request_range(F.col("t"), F.lit(None).cast("string"), F.to_date(F.lit("2000-01-01")))["start"])
    spans = F.size(dates.days(F.col("start_day"), F.date_sub("start_day", 1), least=1))
    return rows.select("id", "day", "start_day", F.date_format("start_day", "yyyy-MM-dd").alias("shown"), spans.alias("days"))


@query(
    "with a as (select l_orderkey as id, l_partkey as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as i, row_number() over (partition by l_orderkey order by l_partkey) as r, "
    "count(*) over (partition by l_orderkey) as n from lineitem) select id, max(p) filter (where i = n) as last, (sum(p) filter (where r <= 2))::bigint as two, any_value(n)::int as n, sum(i * p)::bigint as weighted, "
    "repeat('r', any_value(n)::int) as rep from a group by id"
)
def array_ops(spark, root):
    lines = tables.read(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    p = F.transform("x", lambda s: s["l_partkey"])
    add = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda a, v: a + v)
    zipped = F.arrays_zip(p.alias("p"), F.sequence(F.lit(1), F.size("x")).alias("i"))
    return lines.select(
        "id",
        F.try_element_at(p, F.lit(-1)).alias("last"),
        add(F.slice(F.sort_array(p), 1, 2)).alias("two"),
        F.size(F.transform(p, lambda v: v + 1)).alias("n"),
        add(F.transform(zipped, lambda z: z["p"] * z["i"])).alias("weighted"),
        F.array_join(F.array_repeat(F.lit("r"), F.size("x")), "").alias("rep"),
    )


@query(f"with {o.filtered()} select count(*) as n, count(is_open) as n_status, count(*) filter (where has_water) as n_water, least(count(*), 5)::bigint as shown from rows_")
def result_counts(spark, root):
    rows = search.filtered(catalogue(spark, root))
    return rows.agg(F.count("*").alias("n"), F.count("is_open").alias("n_status"), F.count_if("has_water").alias("n_water"), F.least(F.count("*"), F.lit(5)).cast("long").alias("shown"))


# Pages


_LINKS = """m as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as l from pages),
links as (select page_id, (i - 1)::int as pos, replace(h[i], '&amp;', '&') as href, trim(replace(l[i], '&amp;', '&')) as label from (select *, unnest(range(1, len(h) + 1)) as i from m))"""


@query(f"with {_LINKS} select * from links")
def page_links(spark, root):
    return pages.extract_links(tables.read(spark, root, "pages"))


@query(f"with {_LINKS} select * from links where label like '%a%'")
def page_links_sql(spark, root):
    """The links with an a in their label, asked for in SQL text by the registered table function."""
    page_function.register(spark)
    asked = "SELECT page_id, pos, href, label FROM page_links(TABLE(SELECT page_id, html FROM {p}) PARTITION BY (page_id), 'html') WHERE label LIKE '%a%'"
    return spark.sql(asked, p=tables.read(spark, root, "pages"))


@query(
    f"with {_LINKS} select p.page_id, coalesce(bool_or(regexp_matches(lower(label), '(water)|(swimming)|(boating)|(lake)')), false) as body_of_water, arg_max(label, pos) as last, "
    "arg_min(label, pos) as first, coalesce(string_agg('- ' || label || chr(10), '' order by pos), '') as bullets from pages p left join links l on p.page_id = l.page_id group by 1"
)
def page_flags(spark, root):
    """Per page: keywords on its links and the last and first labels; pages without links have false and nulls."""
    links, every = page_links(spark, root), tables.read(spark, root, "pages").select("page_id")
    rows = every.join(links, "page_id", "left").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "label")))), lambda x: x["label"]).alias("labels"))
    wet = pages.mentions_water(F.col("labels"))
    return rows.select("page_id", wet.alias("body_of_water"), F.try_element_at("labels", F.lit(-1)).alias("last"), F.get("labels", F.lit(0)).alias("first"), text.bullet_list(F.col("labels")).alias("bullets"))


@query()
def html_extract(spark, root):
    return pages.extract_details(tables.read(spark, root, "pages"))


@query(
    "with s as (select p_brand as park_url, p_partkey as k, p_name as site_name, p_size, p_type, p_retailprice, (row_number() over (partition by p_brand order by p_partkey) - 1) as r from part), "
    "g as (select park_url, r // 5 as page_no, bool_or(p_size = 50) as last_page from s group by 1, 2), "
    "e as (select *, coalesce(bool_or(last_page) over (partition by park_url order by page_no rows between unbounded preceding and 1 preceding), false) as ended from g) "
    "select 'http://site/' || s.k as site_url, s.park_url, s.r::int // 5 as page_no, (s.r % 5)::int as place, 'Woods of ' || s.park_url as park_name, s.site_name, "
    "case when p_size < 40 then 'May to ' || p_type end as season_of_use, case when p_size < 40 then p_size::varchar end as latitude, case when p_size < 40 and p_size % 2 = 0 then 'Take road ' || p_size end as directions, "
    "case when p_size < 40 then '- ' || site_name || chr(10) || '- table' || chr(10) end as amenities, case when p_size < 40 then p_size % 3 = 0 end as body_of_water "
    "from s join e on s.park_url = e.park_url and s.r // 5 = e.page_no where not ended"
)
def collect_sites(spark, root):
    """Listing and detail pages made of the parts, taken apart and joined: five places a page, no next link behind size 50, no detail page from size 40 on."""
    part = tables.read(spark, root, "part")
    p = part.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    p = tables.spread(p.select(F.col("p_brand").alias("park_url"), F.floor(F.col("r") / 5).cast("int").alias("page_no"), "r", "p_partkey", "p_name", "p_size"), "park_url", "page_no")
    card = F.format_string("<div class='card main-view-item'><a href='/%d'><i>%s</i></a></div>", "p_partkey", "p_name")
    listings = p.groupBy("park_url", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", card.alias("c")))), lambda x: x["c"]), "").alias("cards"), F.bool_or(F.col("p_size") == 50).alias("last")
    )
    crumbs = F.format_string("<nav class='usa-breadcrumb'><li class='usa-breadcrumb__list-item'>Home<li class='usa-breadcrumb__list-item'>Woods of %s</nav>", "park_url")
    following = F.when(F.col("last"), "").otherwise("<a class='usa-pagination__next-page'>next</a>")
    listings = listings.select("park_url", "page_no", F.concat(crumbs, F.lit("<div class='rows__container'>"), "cards", F.lit("</div>"), following).alias("html"))
    body = F.format_string(
        "<h3><button>Seasons of Use</button></h3><div>May to %s</div><div class='margin-top-5'><h2>Getting There</h2><p>Latitude: %d</p>%s</div>"
        "<div class='opportunities margin-top-5'><a class='opportunity__item'>%s</a></div><div class='field--name-field-rec-general-info'><p>Amenities:</p><ul><li>%s</li><li> table </li></ul></div>",
        "p_type", "p_size", F.when(F.col("p_size") % 2 == 0, F.format_string("<p>Take road %d</p>", "p_size")).otherwise(""), F.when(F.col("p_size") % 3 == 0, "Lake fishing").otherwise("Hiking"), "p_name",
    )
    details = tables.spread(part.where("p_size < 40"), "p_partkey").select(F.format_string("http://site/%d", "p_partkey").alias("site_url"), body.alias("html"))
    rows = pages.collect_sites(listings, details, "http://site")
    return rows.select("site_url", "park_url", "page_no", "place", "park_name", "site_name", "season_of_use", "latitude", "directions", "amenities", "body_of_water")


_WOODS = "'woods/' || p_brand"


@query(
    "with s as (select p_brand as park_url, p_partkey as k, p_name as site_name, p_size, p_type, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as r from part) "
    "select 'http://site/' || k as site_url, 'May to ' || p_type as season_of_use, case when p_size % 3 = 0 then p_size || ' a night' end as fee_info, 'Call ' || p_brand as contact_info, case when p_size % 4 <> 0 then 'At ' || site_name end as info_center, "
    "k || '.5' as latitude, '-' || p_size as longitude, 'From ' || p_type as directions, case when p_size % 2 = 0 then 'Restroom: ' || p_type end as restrooms, case when p_size % 2 = 1 then 'Drinking WATER at ' || site_name end as water, "
    "'Nice ' || site_name as overview, case when p_size % 5 = 0 then p_type when p_size % 5 = 1 then '' when p_size % 5 = 2 then 'tables' when p_size % 5 = 3 then '- ' || site_name || chr(10) || '- ring' || chr(10) end as amenities, p_size % 7 = 0 as body_of_water from s"
)
def collect_details(spark, root):
    """Every field of detail pages made of the parts: all labels, both blocks, the overview, and the four ways to amenities."""
    p = tables.spread(tables.read(spark, root, "part"), "p_partkey")
    accordion = lambda words, inner, there: F.when(there, F.format_string(f"<h3><button>{words}</button></h3><div>%s</div>", inner)).otherwise("")
    size, every = F.col("p_size"), F.lit(True)
    described = F.concat(F.format_string("<p>Overview</p><p>Nice %s</p>", "p_name"), F.when(size % 5 == 0, F.format_string("<p>Amenities: %s</p>", "p_type")).otherwise(""))
    general = F.when(size % 5 == 1, "<p>Hours</p>").when(size % 5 == 2, "<p>Amenities: tables</p>").when(size % 5 == 3, F.format_string("<p>Amenities:</p><ul><li>%s</li><li> ring</li></ul>", "p_name"))
    html = F.concat(
        accordion("Seasons of Use", F.concat(F.lit("May to "), "p_type"), every),
        accordion("Fee Site and Info", F.concat(size.cast("string"), F.lit(" a night")), size % 3 == 0),
        accordion("Contact Information", F.concat(F.lit("Call "), "p_brand"), every),
        accordion("Information Center", F.concat(F.lit("At "), "p_name"), size % 4 != 0),
        F.lit("<div class='margin-top-5'><h2>Weather</h2><p>Latitude: 0</p></div>"),
        F.format_string("<div class='margin-top-5'><h2>Getting There</h2><p>Latitude: %d.5</p><p>Longitude: -%d</p><p>From %s</p></div>", "p_partkey", size, "p_type"),
        F.lit("<div class='margin-top-5'><h2>Facility and Amenity Information</h2>"),
        F.when(size % 2 == 0, F.format_string("<p>Restroom: %s</p>", "p_type")).otherwise(F.format_string("<p>Drinking WATER at %s</p>", "p_name")),
        F.lit("</div><div class='opportunities margin-top-5'><a class='opportunity__item'>Hiking</a>"),
        F.when(size % 7 == 0, "<a class='opportunity__item'>Lake <b>fishing</b></a>").otherwise(""),
        F.lit("</div><div class='rec-intro'><div class='field field--name-field-rec-description'>"), described, F.lit("</div></div>"),
        F.when(general.isNotNull(), F.concat(F.lit("<div class='field--name-field-rec-general-info'>"), general, F.lit("</div>"))).otherwise(""),
    )
    details = p.select(F.format_string("http://site/%d", "p_partkey").alias("site_url"), html.alias("html"))
    return pages.extract_details(details, "site_url")


@query(
    f"select {_WOODS} as slug, (row_number() over (partition by p_brand order by p_name, p_partkey) - 1)::varchar as _c0, p_name as site_name, p_partkey::varchar as latitude, 'a, \"' || p_type || '\"' as directions from part"
)
def collect_csv(spark, root):
    """The scraped table as a numbered file for each park, written in one job and read again."""
    p = tables.read(spark, root, "part")
    rows = p.select(F.concat(F.lit("woods/"), "p_brand").alias("slug"), F.col("p_name").alias("site_name"), F.col("p_partkey").alias("latitude"), F.concat(F.lit('a, "'), "p_type", F.lit('"')).alias("directions"))
    return changes.write_csvs(rows, new_path(spark, "csv"), "slug", ["site_name", "latitude"])


@query(
    "with s as (select p_partkey as site_id, p_retailprice % 90 as lat, p_size * (-2.5)::double as lon, date '2024-01-01' + (p_size % 20)::int as first, date '2024-01-01' + (p_size % 20 + p_partkey % 6 - 1)::int as last from part), "
    "e as (select user_id as id, ts::date as day, arg_max(props, (ts, event_id)) as forecast from events group by 1, 2) "
    "select site_id, lat, lon, count(e.id)::int as n, coalesce(string_agg(forecast, ';' order by day), '') as forecast from s left join e on s.site_id = e.id and e.day between s.first and s.last group by 1, 2, 3"
)
def weather_route(spark, root):
    """The envelopes of the weather route, for every site at once: up to five days, some none."""
    p = tables.read(spark, root, "part")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    start = F.col("p_size") % 20
    spans = p.select(F.col("p_partkey").alias("site_id"), (F.col("p_retailprice") % 90).alias("lat"), (F.col("p_size") * F.lit(-2.5)).alias("lon"), day(start).alias("first"), day(start + F.col("p_partkey") % 6 - 1).alias("last"))
    e = tables.read(spark, root, "events").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day")).agg(F.max_by("props", F.struct("ts", "event_id")).alias("forecast"))
    rows = requests.forecast_ranges(spans, e)
    return rows.select("site_id", "lat", "lon", F.size("forecast").alias("n"), F.array_join("forecast", ";").alias("forecast"))


@query("select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, arg_max(props, (ts, event_id)) as props from events group by 1")
def stream_latest(spark, root):
    return latest.stream_latest(spark, root)
