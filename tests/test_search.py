import datetime as dt

import pytest
from pyspark.sql import functions as F

from waymark.operators import mapview, resolve, search
from waymark.plans import requests


def catalogue(spark, sites, status=(), weather=(), amenities=()):
    rows = [(i, n, f, 1.0 * i, 2.0 * i) for i, n, f in sites]
    return search.Tables(
        spark.createDataFrame(rows, "id long, name string, forest_name string, latitude double, longitude double"),
        spark.createDataFrame(list(status), "campsite_id long, is_open boolean"),
        spark.createDataFrame(list(weather), "campsite_id long, forecast_json string"),
        spark.createDataFrame(list(amenities), "campsite_id long, water boolean, restrooms boolean"),
    )


def found(df):
    return [(r.id, r.score) for r in df.collect()]


def test_exact_hit_stands_alone(spark):
    t = catalogue(spark, [(1, "Pine Crest", "x"), (2, "Pine Flat", "lake"), (3, "Pine Flat", "lake")])
    assert found(search.search(t, "pineflat")) == [(2, 100.0)]


def test_exact_hit_is_blocked_by_an_exact_forest(spark):
    t = catalogue(spark, [(1, "pine", "pine forest"), (2, "oak", "pine forest")])
    assert found(search.search(t, "pine")) == [(1, 100.0)]  # a tie is no forest search


def test_spurious_exact_and_over_100(spark):
    assert found(search.search(catalogue(spark, [(1, "zzz", None), (2, "abc", None)]), "axxxxx")) == [(2, 100.0)]
    assert found(search.search(catalogue(spark, [(1, "pine", None)]), "pinecrestlake")) == [(1, 325.0)]


def test_forest_search(spark):
    t = catalogue(spark, [(1, "aaa", "West Woods"), (2, "west aaaaaaaaaaaaaaaa", "West Woods"), (3, "bbb", "East Woods"), (4, "ccc", None)])
    got = found(search.search(t, "west woods"))
    assert [i for i, _ in got] == [2, 1] and got[1][1] < 40
    tie = catalogue(spark, [(5, "x", "b woods"), (6, "y", "a woods")])
    assert [i for i, _ in found(search.search(tie, "woods"))] == [5]


def test_blank_query_takes_the_group_without_a_forest(spark):
    t = catalogue(spark, [(1, "a", "f"), (2, "b", None), (3, "c", None)])
    assert [i for i, _ in found(search.search(t, "  "))] == [2, 3]


def test_names_threshold_and_limit(spark):
    t = catalogue(spark, [(1, "pine", None), (2, "pint", None), (3, "oooo", None)])
    assert [i for i, _ in found(search.search(t, "pina"))] == [1, 2]
    assert [i for i, _ in found(search.by_name(t, "pina", limit=1))] == [1]
    assert found(search.search(t, "qqq")) == [] and found(search.search(catalogue(spark, []), "a")) == []


def test_filters_and_fan_out(spark):
    t = catalogue(spark, [(1, "b", "A_C"), (2, "a", "abc"), (3, "c", None)], [(1, True), (1, False), (2, None)], [(1, "{}")], [(1, None, True), (2, True, None)])
    assert search.search(t).count() == 4 and search.search(t, dedupe=True).count() == 3
    assert [r.id for r in search.search(t, is_open=True).collect()] == [1] and search.search(t, is_open=False).count() == 4
    assert [r.id for r in search.search(t, has_water=True).collect()] == [2] and [r.id for r in search.search(t, has_restrooms=True, dedupe=True).collect()] == [1]
    assert {r.id for r in search.search(t, forest="a_c").collect()} == {1, 2} and {r.id for r in search.search(t, forest=" ").collect()} == {1, 2}
    assert [r.id for r in search.search(t, dedupe=True).collect()] == [3, 1, 2]  # a missing forest sorts as empty text


def test_requests(spark):
    t = catalogue(spark, [(1, "pine", "f"), (2, "oak", None)], [(1, True)], [(1, '{"cloud_cover_afternoon": 10}')])
    assert requests.search_arguments({"query": "", "is_open": "True", "has_water": "true"}) == {"query": None, "is_open": None, "has_water": True, "has_restrooms": None, "forest": None}
    assert requests.search_string({"query": " a b ", "is_open": True, "forest": "", "start": "2026-01-01"}) == "query=a+b&is_open=true&start=2026-01-01"
    assert '"score":100.0' in requests.api_search(t, {"query": "pine"}).first().json
    with pytest.raises(LookupError):
        requests.api_search(t, {"query": "zzzz"})
    assert requests.api_site(t.sites, 2)["name"] == "oak"
    with pytest.raises(LookupError):
        requests.api_site(t.sites, 9)
    row = requests.results(t, {"query": "pine", "end": "2026-01-02"}).first()
    assert (row.weather_summary.sky, row.status, row.badges, row.link) == ("mostly clear", "Open", ["No amenities listed"], "/campsite/1?end=2026-01-02")
    assert requests.api_map(t.sites).count() == 2


def test_weather_range(spark):
    t = catalogue(spark, [(1, "pine", "f")])
    day = dt.date(2026, 1, 1)
    recorded = spark.createDataFrame([(1, day + dt.timedelta(k), f"d{k}") for k in (0, 1, 3)], "id long, day date, forecast string")
    ask = lambda *a: requests.weather_range(t.sites, recorded, *a, day).first().forecast
    assert ask(1, None, None) == ["d0"] and ask(1, "2026-01-01", "2026-01-04") == ["d0", "d1", "d3"] and ask(1, "2026-01-02", "2026-01-01") == []
    for bad, error in (((None, None, None), ValueError), ((1, "x", None), ValueError), ((7, None, None), LookupError)):
        with pytest.raises(error):
            requests.weather_range(t.sites, recorded, *bad, day)


def facility(i, name, areas=("Big Woods",), kind="Campground", reservable=True):
    return (str(i), name, kind, reservable, [(a,) for a in areas] if areas is not None else None, [("Image", f"u{i}", "t"), ("Video", "v", "t")])


def test_resolution(spark):
    kind = "struct<FacilityID:string,FacilityName:string,FacilityTypeDescription:string,Reservable:boolean,RECAREA:array<struct<RecAreaName:string>>,MEDIA:array<struct<MediaType:string,URL:string,Title:string>>>"
    sites = spark.createDataFrame([(1, "Pine Flat Campground", "woods"), (2, "Oak", None), (3, "abcdefghij", "woods")], "id long, name string, forest_name string")
    rows = [
        (1, 0, facility(10, "PINE FLAT", reservable=False)), (1, 1, facility(11, "PINE FLAT", kind="Trail")), (1, 2, facility(12, "PINE FLAT", areas=())), (1, 3, facility(13, "Flat Pine campground")),
        (1, 4, facility(14, "PINE FLAT")), (1, 5, facility(15, "Pine Flat")), (2, 0, facility(20, "Oaks", areas=None)), (2, 1, facility(21, "oak campground", areas=None, reservable=None)), (3, 0, facility(30, "abcdefxxxxx")),
    ]
    m = resolve.best_match(sites, spark.createDataFrame(rows, f"site_id long, pos int, facility {kind}"))
    assert {r.site_id: (r.facility.FacilityID, round(r.score, 4)) for r in m.collect()} == {1: ("13", 100.0), 2: ("20", 85.7143)}
    assert sorted(r.image_url for r in resolve.images_of(m).collect()) == ["u13", "u20"]


def test_map(spark):
    rows = [(3, "c", "B", 1.0, None), (2, "b", "A", 1.0, -2.0), (1, "a", None, 3.0, 4.0), (4, "d", "", 0.5, 0.0), (5, "e", "C", 0.0, 0.0)]
    points = mapview.map_points(spark.createDataFrame(rows, "id long, name string, forest_name string, latitude double, longitude double"))
    assert points.count() == 4 and tuple(mapview.bounds(points).first()) == (0.0, -2.0, 3.0, 4.0)
    assert {r.region: r.slot for r in mapview.palette(points).collect()} == {"Other": 0, "A": 1, "C": 2}
    assert mapview.palette(points.limit(0)).count() == 0 and points.where(F.col("id") == 3).count() == 0


def test_detail_forecast_is_all_or_nothing(spark):
    site = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "id long, latitude double, longitude double")
    day = lambda k: F.to_date(F.lit(f"2024-01-0{k}"))
    rows = [(1.0, 2.0, "2024-01-01", '{"date":"a","temp_max":3.0}'), (1.0, 2.0, "2024-01-02", "{}"), (1.0, 2.0, "2024-01-03", None), (3.0, 4.0, "2024-01-01", '{"date":"b"}')]
    stored = spark.createDataFrame(rows, "lat double, lon double, day string, forecast string").withColumn("day", F.to_date("day"))
    got = {r.site_id: [s.date for s in r.summaries] for r in requests.detail_forecast(site, stored, day(1), day(3)).collect()}
    assert got == {1: ["a"], 2: []}
    assert [len(r.summaries) for r in requests.detail_forecast(site.where("id = 2"), stored, day(1), day(1)).collect()] == [1]
