import json
from html.parser import HTMLParser

from pyspark.sql import functions as F

from waymark.operators import changes
from waymark.plans import catalogue
from waymark.sources import pages, recorded, tables
from waymark.streaming import latest

DETAIL = """<html><body>
<h3><button>Seasons of Use info</button></h3><p>no</p><div> May <b>to</b> June </div>
<div class="margin-top-5"><h2>Other</h2><p>Latitude: 9</p></div>
<div class="x margin-top-5"><h2>Getting There now</h2><p>Latitude: 1.5</p><p>Longitude: -2</p><p>From here</p><p>Take that road</p></div>
<div class="margin-top-5"><h2>Getting There</h2><p>Latitude: 7</p></div>
<div class="margin-top-5"><h2>Facility and Amenity Information</h2><p>Restroom and Water</p><p>Drinking WATER</p><br></div>
<div class="opportunities margin-top-5"><a class="opportunity__item">Lake Fishing</a></div>
<div class="rec-intro"><div class="field field--name-field-rec-description"><p>Overview</p><p>Nice place</p></div></div>
<div class="field--name-field-rec-general-info"><p>Amenities:</p><ul><li>table</li><li>ring</li></ul></div></body></html>"""
LISTING = """<nav class="usa-breadcrumb"><li class="usa-breadcrumb__list-item">Home</li><li class="usa-breadcrumb__list-item">Big <i>Woods</i></li></nav>
<div class="rows__container"><div class="main-view-item"><a href="/a">A site</a></div><div class="main-view-item">no link</div></div><a class="usa-pagination__next-page" href="?2">next</a>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, DETAIL), (2, LISTING), (3, None), (4, "<p>open <b>x")], "page_id long, html string")
    d = {r.page_id: r for r in pages.extract_details(df).collect()}
    one = d[1]
    assert (one.season_of_use, one.latitude, one.longitude, one.directions) == ("May\nto\nJune", "1.5", "-2", "Take that road")
    assert (one.restrooms, one.water, one.overview, one.amenities, one.body_of_water) == ("Restroom and Water", "Drinking WATER", "Nice place", "- table\n- ring\n", True)
    assert d[3].latitude is None and d[3].amenities is None and d[4].body_of_water is False
    assert [tuple(r) for r in pages.extract_cards(df, "http://h").collect()] == [(2, "A site", "http://h/a", "BigWoods")]
    found = {r.page_id: r for r in pages.extract_listings(df, "").collect()}
    assert found[2].has_next and not found[1].has_next and found[3].park_name == "Unknown" and found[1].cards == []
    assert [(r.page_id, r.href, r.label) for r in pages.extract_links(df).collect()] == [(1, None, None)][:0] + [(2, "/a", "A site"), (2, "?2", "next")]


def test_page_shapes(spark):
    general = '<div class="field--name-field-rec-general-info">{}</div>'
    rows = [
        (1, general.format("<p>x</p>")),
        (2, "<p>" * 1500 + "deep <a href='/x'>link</a>" + "</div>" * 5),
        (3, general.format("<p>Amenities: a</p><p>Amenities:</p><ul><li>b</li></ul>")),
        (4, general.format("<p>Amen<b>ities</b>: a</p>") + '<div class="rec-intro"><div class="field--name-field-rec-description field"><p>Overview</p><p> </p><p>Overview too</p><p>text</p><p>Amenities: inn</p></div></div>'),
        (5, '<div class="margin-top-5"><h2>Getting There</h2></div><div class="margin-top-5"><h2>Getting There</h2><p>Take it</p></div><h3><i><button>Fee Site and Info</button></i></h3><div>free</div>'),
        (6, "<a href>empty</a><a>none</a><br/></p></b>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string")
    d = {r.page_id: r for r in pages.extract_details(df).collect()}
    assert [d[k].amenities for k in (1, 2, 3, 4)] == ["", None, "a- b\n", "inn"]
    assert d[4].overview == "text" and d[5].directions is None and d[5].fee_info == "free" and d[5].season_of_use is None
    assert [(r.page_id, r.href, r.label) for r in pages.extract_links(df).collect()] == [(2, "/x", "link"), (6, "", "empty")]
    assert pages.extract_details(df.limit(0)).count() == 0


def outlined(page, html):
    page.feed(html)
    page.close()
    return [[*e[:4], list(e[4]), *e[5:]] for e in page.elements], page.strings


def test_plain_runs_of_a_page_are_read_at_once(monkeypatch):
    """The parser's own reader of start tags, which takes many steps a tag, is asked for odd tags only; what it makes is the same."""
    taken = []
    own = HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: taken.append(self.rawdata[i : i + 9]) or own(self, i))

    class Slow(pages.Outline):
        parse_starttag = HTMLParser.parse_starttag

    assert outlined(pages.Outline(), DETAIL + LISTING)[0] and taken == []
    odd = [
        "<!DOCTYPE html><P Class=X>a &amp; b<br/>c</P><p class='x'\t>d<!-- <p> -->e",
        "<script>if (a<b) '</p>'</script><p>x</p><style>p{}</style><title>a<b></title>",
        "a < b <p class='it\"s' href=\"?a=1&amp;b\">&lt;c<a href>d</a><a href=''>e</a ></>f</ g>",
        "<a\xa0href='x'>a</a><p class = 'b'>c<p class='d'id='e'>f<p class='g' class='h  i'>j<x-y>k",
        "<p class='a>b'>c<p class='not closed",
        "text &am",
        "</p><div><p>x</div></p><ul><li>a<li>b</ul>" + "\u3000 \x00<br>",
        "",
    ]
    for html in odd:
        assert outlined(pages.Outline(), html) == outlined(Slow(), html)
        assert outlined(pages.Outline(frozenset(["a"])), html) == outlined(Slow(frozenset(["a"])), html)


def test_plain_listing_pages_are_read_at_once(monkeypatch):
    taken = []
    own = HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: taken.append(i) or own(self, i))
    cards = "".join(f"<div class='card main-view-item'><a href='/{k}'><i>site {k}</i></a></div>" for k in range(3))
    page = "<nav class='usa-breadcrumb'><li class='usa-breadcrumb__list-item'>Home<li>Woods</nav><div class='rows__container'>" + cards + "</div><a class='x' href='?a&amp;b'>next</a>"
    elements, strings = outlined(pages.Outline(), page)
    assert taken == [page.index("<a class='x'")]  # the one tag with a reference
    assert strings == ["Home", "Woods", "site 0", "site 1", "site 2", "next"] and [e[5] for e in elements if e[3] == "a"] == ["/0", "/1", "/2", "?a&b"]
    assert [(e[0], e[1], e[2]) for e in elements[:4]] == [(0, 2, -1), (1, 2, 0), (2, 2, 1), (3, 12, -1)]


def test_collect_sites(spark):
    page = lambda cards, more: f'<div class="rows__container">{"".join(f"<div class=main-view-item><a href=/{c}>{c}</a></div>" for c in cards)}</div>' + ("<a class='usa-pagination__next-page'>n</a>" if more else "")
    listings = [("p", 0, page("ab", True)), ("p", 1, page("c", False)), ("p", 2, page("d", True)), ("q", 0, page("", True)), ("q", 1, page("e", False)), ("r", 0, None)]
    details = [("h/a", DETAIL), ("h/c", None), ("h/z", DETAIL)]
    out = pages.collect_sites(spark.createDataFrame(listings, "park_url string, page_no int, html string"), spark.createDataFrame(details, "site_url string, html string"), "h")
    assert sorted((r.park_url, r.page_no, r.place, r.site_name, r.latitude, r.body_of_water) for r in out.collect()) == [("p", 0, 0, "a", "1.5", True), ("p", 0, 1, "b", None, None), ("p", 1, 0, "c", None, False)]


def parsing_tasks(df):
    """The tasks of each stage of the executed query that takes pages apart."""
    df.collect()

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        own = [plan.execute().getNumPartitions()] if plan.nodeName() == "MapInArrow" else []
        children = plan.children()
        return own + [n for i in range(children.size()) for n in walk(children.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_details_of_one_file_in_many_tasks(spark):
    assert spark.read.parquet("/root/testdata/sf0.01/part.parquet").rdd.getNumPartitions() == 1
    assert parsing_tasks(catalogue.QUERIES["collect_details"](spark, "/root/testdata/sf0.01")) == [4]


def test_places_of_one_file_in_many_tasks(spark):
    assert parsing_tasks(catalogue.QUERIES["collect_sites"](spark, "/root/testdata/sf0.01")) == [4, 4]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, n int")
    m = spark.createDataFrame([(1, None, 9)], "id long, v string, n int")
    assert sorted(map(tuple, changes.update_matched(t, m, "id", ["v"]).collect())) == [(1, None, 1), (2, "b", 2)]
    new = spark.createDataFrame([(1, "z", 0), (3, "c", 3)], "id long, v string, n int")
    assert sorted(map(tuple, changes.upsert_latest(t, new, "id", ["n"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert changes.insert_ignore(t, new.unionAll(new), ["id", "v"]).count() == 4
    assert changes.add_column(changes.add_column(t, "w"), "v").columns == ["id", "v", "n", "w"]
    child = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "k int, parent long")
    assert sorted(r.k for r in changes.cascade(child, t, "parent", "id").collect()) == [1, 3]
    assert changes.from_csv(spark.createDataFrame([("n", "1", "2", "d", "i", "p", "c", "s", "f", "o")], ["site_name", "latitude", "longitude", "directions", "info_center", "park_url", "contact_info", "season_of_use", "fee_info", "overview"])).first().contact_name == "i"


def test_writers(spark, tmp_path):
    tables.create_catalogue(spark, str(tmp_path / "c"))
    assert spark.read.parquet(f"{tmp_path}/c/campsites").schema.names == tables.SITES.names
    t = spark.createDataFrame([(1, "a,b\""), (2, None)], "id long, v string")
    for _ in range(2):
        back = changes.write_csv(t, str(tmp_path / "csv"), "slug")
        assert sorted((r["_c0"], r.id, r.v) for r in back.collect()) == [("0", "1", 'a,b"'), ("1", "2", None)]
    path = str(tmp_path / "t")
    assert changes.write_version(t, path) == 0
    assert changes.write_version(changes.read_version(spark, path).where("id = 2"), path) == 1
    (tmp_path / "t" / "v2").mkdir()  # a write that never ended
    assert [r.id for r in changes.read_version(spark, path).collect()] == [2] and changes.versions(spark, path) == [0, 1]


def test_recorded_source(spark, tmp_path):
    body = {"RECDATA": [{"FacilityID": "1", "FacilityName": "A", "Reservable": True, "RECAREA": [{"RecAreaName": "x"}]}]}
    lines = [{"key": "q", "status": 200, "body": body}, {"key": "n", "status": 200, "body": {"METADATA": {"RESULTS": {"TOTAL_COUNT": 7}}}}, {"key": "e", "status": 500, "body": {}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    spark.dataSource.register(recorded.RecordedResponses)
    rows = spark.read.format("recorded").option("path", str(tmp_path)).load()
    got = {r.key: r for r in rows.select("key", recorded.facility_count(F.col("body")).alias("n"), recorded.facilities(F.col("body")).alias("f")).collect()}
    assert got["n"].n == 7 and got["e"].n is None and got["q"].f[0].FacilityName == "A" and got["e"].f == []


def test_stream_upserts_over_batches(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, t long, v string")
    rows((1, 1, "a"), (1, 3, "c"), (2, 1, "x")).write.parquet(f"{root}/in")
    stream = lambda: spark.readStream.schema("k long, t long, v string").parquet(f"{root}/in")
    latest.upsert_stream(stream(), "k", ["t"], f"{root}/out").awaitTermination()
    assert sorted(map(tuple, latest.current(spark, f"{root}/out", rows()).collect())) == [(1, 3, "c"), (2, 1, "x")]
    rows((1, 2, "late"), (2, 5, "y")).write.mode("append").parquet(f"{root}/in")
    latest.upsert_stream(stream(), "k", ["t"], f"{root}/out").awaitTermination()
    assert sorted(map(tuple, latest.current(spark, f"{root}/out", rows()).collect())) == [(1, 3, "c"), (2, 5, "y")]


def test_stream_rewrites_only_touched_buckets(spark, tmp_path):
    schema, source, target = "k long, t int, v string", tmp_path / "in", str(tmp_path / "out")
    like = spark.createDataFrame([], schema)
    rounds = [[(k, 1, "a") for k in range(40)], [(3, 2, "b"), (3, 1, "c"), (99, 5, "n")], [(3, 0, "late")]]
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        latest.upsert_stream(spark.readStream.schema(schema).parquet(str(source)), "k", ["t"], target, buckets=8).awaitTermination()
    got = {r.k: (r.t, r.v) for r in latest.current(spark, target, like).collect()}
    assert got == {**{k: (1, "a") for k in range(40)}, 3: (2, "b"), 99: (5, "n")}
    assert len(list((tmp_path / "out" / "data" / "batch=1").glob("bucket=*"))) <= 2


def test_csv_of_all_parks(spark, tmp_path):
    rows = spark.createDataFrame([("r05/a b", "y", None), ("r05/a b", "x", 'q"u,o\nte'), ("ü", "z", "")], "slug string, name string, v string")
    back = changes.write_csvs(rows, str(tmp_path / "c"), "slug", ["name"])
    got = sorted((r.slug, r._c0, r.name, r.v or "") for r in back.collect())
    assert back.columns == ["_c0", "slug", "name", "v"] and got == [("r05/a b", "0", "x", 'q"u,o\nte'), ("r05/a b", "1", "y", ""), ("ü", "0", "z", "")]
    assert all(len(list(d.glob("part-*"))) == 1 for d in (tmp_path / "c").glob("slug=*"))
    import pytest

    with pytest.raises(ValueError):
        changes.write_csvs(rows.unionAll(spark.createDataFrame([(None, "n", "v")], rows.schema)), str(tmp_path / "d"), "slug", ["name"])


def test_page_function_in_sql(spark):
    import pytest

    from waymark.sources import page_function

    page_function.register(spark)
    df = spark.createDataFrame([("k1", 5, DETAIL), ("k2", 6, LISTING), ("k2", 6, LISTING), (None, 7, None)], "key string, n int, body string")
    out = spark.sql("SELECT * FROM page_links(TABLE(SELECT * FROM {p}) PARTITION BY (key), 'body')", p=df)
    assert out.columns == ["key", "n", "pos", "href", "label"] and dict(out.dtypes)["n"] == "int"
    assert sorted((r.key, r.n, r.pos, r.href, r.label) for r in out.collect()) == sorted(2 * [("k2", 6, 0, "/a", "A site"), ("k2", 6, 1, "?2", "next")])
    with pytest.raises(Exception, match="HTML column"):
        spark.sql("SELECT * FROM page_links(TABLE(SELECT * FROM {p}) PARTITION BY (key), 'none')", p=df)
    with pytest.raises(Exception, match="columns of the result"):
        spark.sql("SELECT * FROM page_links(TABLE(SELECT *, 1 AS pos FROM {p}) PARTITION BY (key), 'body')", p=df)
