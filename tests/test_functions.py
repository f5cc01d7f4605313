import datetime as dt
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import dates, display, fuzzy, text, weather


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


WORD = st.text(alphabet="abcé ", max_size=14)


@given(WORD, WORD)
def test_similarity_properties(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    for score in (fuzzy.ratio, fuzzy.partial):
        assert 0 <= score(a, b) <= 100 and score(a, a) == 100 and abs(score(a, b) - score(b, a)) < 1e-9
    assert fuzzy.partial(a, b) >= fuzzy.ratio(a, b) - 1e-9 or not a or not b or len(a) != len(b)


@pytest.mark.parametrize("q", ["abcab", "", "c", "abcabcabcabcabc", "abcc" * 20, "é'"])
def test_native_similarity_equals_python(spark, q):
    xs = ["", "a", "abc", "cab", "abcab", "bcabc", "aabbccaabbcc", "zzz", "é'x", "abcabcabcabcabcabc"]
    got = column(spark, xs).select("x", fuzzy.ratio_to(F.col("x"), q), fuzzy.partial_to(F.col("x"), q)).collect()
    for x, r, p in got:
        assert r == pytest.approx(fuzzy.ratio(x, q), abs=1e-9) and p == pytest.approx(fuzzy.partial(x, q), abs=1e-9)


def test_token_sort(spark):
    df = spark.createDataFrame([("b  a", "a b"), ("", ""), ("", "x"), (None, "")], "a string, b string")
    assert values(df, fuzzy.token_sort_ratio(F.col("a"), F.col("b"))) == [100, 100, 0, 100]


def test_text(spark):
    xs = [None, "", "  A b\tC\x1cd ", "Foo Campground", "A campground campground", "Campground", "<p>hi <b>x</b></p> ", "a/r05/angeles", "x/angeles//"]
    df = column(spark, xs)
    x = F.col("x")
    assert values(df, text.normalize(x)) == [re.sub(r"\s+", "", (v or "").lower()) for v in xs]
    assert values(df, text.normalize_name(x))[3:6] == ["foo", "a", "campground"]
    assert values(df, text.strip_html(x))[:2] == [None, None] and values(df, text.strip_html(x))[6] == "hi x"
    assert values(df, text.url_tail(x))[1] == "" and values(df, text.url_tail(x))[7:] == ["angeles", "angeles"]
    likes = lambda p: values(column(spark, ["abc", "a%c", "x\\c", None]), F.col("x").like(text.like_pattern(p)))
    assert likes("A_c") == [True, True, False, None] and likes("  ") == [True, True, True, None] and likes("a\\%c") == [False, True, False, None] and likes("x\\c") == [False, False, False, None]
    assert values(df.limit(1), text.query_string({"a": F.lit("x y"), "b": F.lit(""), "c": F.lit("1")})) == ["a=x+y&c=1"]


def test_weather(spark):
    docs = ['{"date":"2026-01-05","temp_max":70.5,"temp_min":40,"precipitation_total":0.1,"cloud_cover_afternoon":24.9}', '[{"cloud_cover_afternoon":25}]', '{"cloud_cover_afternoon":"30"}', '{"cloud_cover_afternoon":60}',
            '{"cloud_cover_afternoon":"abc"}', '{"cloud_cover_afternoon":"NaN"}', '{"cloud_cover_afternoon":true}', "[]", "{}", '"x"', "bad", None, '{"date":"d"}']
    got = values(column(spark, docs), weather.summary(F.col("x")))
    assert tuple(got[0]) == ("2026-01-05", 70.5, 40.0, 0.1, "mostly clear")
    assert [g and g.sky for g in got] == ["mostly clear", "partly cloudy", "partly cloudy", "cloudy", None, "cloudy", "mostly clear", None, None, None, None, None, None]
    assert got[7:12] == [None] * 5 and got[12].date == "d"
    raw = values(column(spark, ['{"date":"d","precipitation":{"total":1},"temperature":{"min":2},"cloud_cover":{}}', "{}"]), weather.flatten(F.col("x")))
    assert tuple(raw[0]) == ("d", 1.0, 2.0, None, None) and tuple(raw[1]) == (None,) * 5


def test_dates(spark):
    xs = ["2026-01-05", "2026-1-5", "2026-02-30", "05.01.2026", "", None]
    assert values(column(spark, xs), dates.parse(F.col("x"))) == [dt.date(2026, 1, 5)] * 2 + [None] * 4
    day = lambda s: F.to_date(F.lit(s))
    one = column(spark, ["x"])
    assert [len(values(one, dates.days(day("2026-01-05"), day(e), n))[0]) for e, n in (("2026-01-07", 0), ("2026-01-05", 0), ("2026-01-01", 0), ("2026-01-01", 1))] == [3, 1, 0, 1]
    ask = lambda s, e: tuple(values(one, dates.request_range(F.lit(s), F.lit(e), day("2026-06-01")))[0])
    june = dt.date(2026, 6, 1)
    assert ask(None, None) == (june, june) and ask("2026-1-2", None) == (dt.date(2026, 1, 2),) * 2 and ask("bad", "2026-01-01") == (june, june)


def test_display(spark):
    df = spark.createDataFrame([(None, True, False), (False, False, False), (True, True, True)], "o boolean, w boolean, r boolean")
    assert values(df, display.status_chip(F.col("o"))) == ["Closed", "Closed", "Open"]
    assert values(df, display.badges(F.col("w"), F.col("r"))) == [["Water"], ["No amenities listed"], ["Water", "Restrooms"]]
    n = column(spark, [3, 0, -1, None], "int")
    assert [tuple(r) for r in values(n, display.reservation(F.lit("7"), F.col("x"), "u/"))] == [("u/7", 3), (None, 0), (None, 0), (None, 0)]
    assert values(n.limit(1), display.box(F.lit(None), F.lit(1.0))) == [None]
    line = weather.weather_line(F.lit("cloudy"), F.lit(2.5), F.lit(0.5), F.lit(None).cast("double"))
    assert values(n.limit(1), line) == ["cloudy · High 2.0° / Low 0.0°"]


def test_rounding_is_of_the_binary_value(spark):
    import random

    from waymark.functions import weather

    rnd = random.Random(2)
    values = [2.675, -2.675, 1.005, 0.125, 0.375, -0.125, 0.0, 1e9 + 0.005, 8.345, 0.285, 1.115, 4.35, 2.5e-3, 7.5e-3] + [rnd.randrange(-99999, 99999) / 1000 for _ in range(3000)] + [rnd.uniform(-5, 5) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.y for r in df.select(weather.round_binary(F.col("x")).alias("y")).collect()]
    assert got == [round(v, 2) for v in values]
    assert spark.createDataFrame([(None,)], "x double").select(weather.round_binary(F.col("x")).alias("y")).first().y is None
