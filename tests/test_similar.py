import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import fuzzy
from waymark.operators import resolve
from waymark.operators.similar import similar_names


def sorted_tokens(x: str | None) -> str:
    return " ".join(sorted((x or "").split()))


def brute(left, right, accept):
    a, b = {sorted_tokens(x) for x in left}, {sorted_tokens(x) for x in right}
    return {(x, y): s for x in a for y in b if (s := fuzzy.ratio(x, y)) >= accept}


def words(seed: int, n: int, alphabet: str, longest: int) -> list[str | None]:
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(longest))) for _ in range(n)]
    for x in out[: n // 2]:  # edited copies
        t = list(x)
        for _ in range(rnd.randrange(4)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice(alphabet))
            del t[rnd.randrange(len(t))]
        out.append("".join(t))
    return [*out, None, "", " "]


@pytest.mark.parametrize(("accept", "alphabet", "longest", "long"), [(70, "abcdefg hij", 14, 96), (70, "ab ", 9, 96), (90, "abcdef ", 40, 20), (40, "abcdefghij klmnop", 10, 6), (100, "ab", 4, 96), (70, "aé中😀 x", 12, 8), (85, "abcdefghijklm ", 150, 96)])
def test_equals_all_pairs(spark, accept, alphabet, longest, long):
    left, right = words(1, 60, alphabet, longest), words(2, 60, alphabet, longest) + words(1, 20, alphabet, longest)
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "x string")
    got = similar_names(frame(left + left), frame(right), "x", "x", accept, long).collect()
    want = brute(left, right, accept)
    assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == pytest.approx(want)


def test_plan_and_bounds(spark):
    df = spark.createDataFrame([("small ring",)], "x string")
    plan = similar_names(df, df, "x", "x")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert similar_names(df.limit(0), df, "x", "x").count() == 0
    for accept in (0, -1, 101):
        with pytest.raises(ValueError):
            similar_names(df, df, "x", "x", accept)


def test_match_unlisted(spark):
    sites = spark.createDataFrame([(1, "Pine Flat Campground", "Sierra"), (2, "pine flat", None), (3, "Nothing", None), (4, None, None), (5, "Flat Pine", "Inyo")], "id long, name string, forest_name string")
    kind = "struct<FacilityID:string,FacilityName:string,FacilityTypeDescription:string,Reservable:boolean,RECAREA:array<struct<RecAreaName:string>>>"
    rows = [
        (7, ("a", "PINE FLATS", "Campground", True, [("x sierra y",)])),
        (3, ("b", "flat pine", "Campground", True, [("Inyo",)])),
        (9, ("c", "Flat Pine campground", "Campground", True, None)),
        (1, ("d", "pine flat", "Trail", True, [("Sierra",)])),
        (2, ("e", "pine flat", "Campground", None, [("Sierra",)])),
        (8, ("f", "Pine Flats", "Campground", True, [("x sierra y",)])),
    ]
    facilities = spark.createDataFrame(rows, f"pos int, facility {kind}")
    got = {r.site_id: (r.facility.FacilityID, round(r.score, 3)) for r in resolve.match_unlisted(sites, facilities).collect()}
    assert got == {1: ("a", 94.737), 2: ("b", 100.0), 5: ("b", 100.0)}


def test_sql_ratio_column(spark):
    df = spark.createDataFrame([("ab", "abc"), ("", "")], "a string, b string")
    assert [r.s for r in df.select(fuzzy.ratio_of(F.col("a"), F.col("b")).alias("s")).collect()] == pytest.approx([80.0, 100.0])
