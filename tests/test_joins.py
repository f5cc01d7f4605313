import datetime as dt
import math
import random

import pytest

from waymark.operators import asof, near
from waymark.plans import joins

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def brute(left, right, most=None):
    out = []
    for i, k, t in left:
        known = [(u, tie, v) for kk, u, tie, v in right if k is not None and t is not None and kk == k and u is not None and u <= t]
        u, _, v = max(known, default=(None, None, None))
        out.append((i, None if u is None or (most and u < t - most) else v))
    return sorted(out)


@pytest.mark.parametrize(("width", "most"), [(86_400, None), (60, None), (600, 45), (7, 45)])
def test_asof_equals_brute_force(spark, width, most):
    rnd = random.Random(width)
    key = lambda: rnd.choice([1, 1, 1, 2, 3, None])  # noqa: E731  one key has half of all rows
    left = [(i, key(), rnd.choice([*range(-100, 500), None])) for i in range(300)] + [(i, 1, 77) for i in range(300, 305)]
    right = [(key(), rnd.choice([*range(0, 400, 9), None]), j, f"v{j}") for j in range(200)]
    a = spark.createDataFrame([(i, k, at(t), "x") for i, k, t in left], "i int, k int, t timestamp, tie string")
    b = spark.createDataFrame([(k, at(t), j, v) for k, t, j, v in right], "k int, t timestamp, j int, v string")
    got = asof.asof_join(a, b, "k", "t", ["v"], ["j"], width=width, at_most=most and f"{most} minutes")
    assert got.columns == ["i", "k", "t", "tie", "v"]
    assert sorted((r.i, r.v) for r in got.collect()) == brute(left, right, most)


def test_asof_empty_and_clash(spark):
    a = spark.createDataFrame([(1, T0)], "k int, t timestamp")
    b = spark.createDataFrame([], "k int, t timestamp, v string")
    assert [r.v for r in asof.asof_join(a, b, "k", "t", ["v"], []).collect()] == [None]
    assert asof.asof_join(a.limit(0), b, "k", "t", ["v"], []).count() == 0
    with pytest.raises(ValueError):
        asof.asof_join(a.withColumnRenamed("k", "v"), b, "v", "t", ["v"], [])


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * near.RADIUS * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("reach", [5, 300, 2500, 6000])
def test_distance_equals_all_pairs(spark, reach):
    rnd = random.Random(reach)
    spot = lambda: (rnd.choice([rnd.uniform(-90, 90), rnd.uniform(88, 90), rnd.uniform(-90, -89.9), rnd.gauss(0, 0.05), 90.0, -90.0]), rnd.choice([rnd.uniform(-180, 180), rnd.uniform(179.9, 180), rnd.uniform(-180, -179.9), 180.0, -180.0, 0.0]))
    p, q = [spot() for _ in range(120)], [spot() for _ in range(150)]
    frame = lambda rows, c: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(-1, None, 1.0), (-2, 1.0, None), (-3, 91.0, 0.0), (-4, float("nan"), 0.0)], f"{c} int, latitude double, longitude double")
    got = [(r.a, r.b) for r in near.within_distance(frame(p, "a"), frame(q, "b"), reach).collect()]
    d = {(i, j): km(x, y) for i, x in enumerate(p) for j, y in enumerate(q)}
    assert len(got) == len(set(got))
    assert set(got) ^ {k for k, v in d.items() if v <= reach} <= {k for k, v in d.items() if abs(v - reach) < 1e-6}


def join_rows(df):
    """The most rows that a join of the executed query made."""
    df.collect()

    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
        children = plan.children()
        return own + [n for i in range(children.size()) for n in walk(children.apply(i))]

    return max(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("list_rows", [1, 7, 1024])
def test_distance_of_crowded_places(spark, list_rows):
    p = [(i, 10.0, [20.0, 380.0, -340.0][i % 3]) for i in range(60)] + [(60, 10.1, 20.0), (61, 10.1, 20.0)]
    q = [(i, 10.05, 20.0) for i in range(50)] + [(50, 10.6, 20.0), (51, 10.0, 20.0)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} int, latitude double, longitude double")
    got = near.within_distance(frame(p, "a"), frame(q, "b"), 60, {"metres": near.F.round(near.F.col("km_apart") * 1000).cast("long")}, list_rows=list_rows)
    assert got.columns == ["a", "b", "km_apart", "metres"]
    want = [(i, j, round(1000 * d)) for i, *x in p for j, *y in q if (d := km(x, y)) <= 60]
    assert len(want) == 62 * 51 + 2 and sorted((r.a, r.b, r.metres) for r in got.collect()) == want


def test_distance_is_worked_out_for_places(spark):
    p = spark.range(300).selectExpr("id as a", "10.0d as latitude", "20.0d as longitude")
    q = spark.range(400).selectExpr("id as b", "10.0d as latitude", "20.0d as longitude")
    pairs = near.within_distance(p, q, 60)
    assert pairs.count() == 300 * 400 and join_rows(pairs) <= 2 * (300 + 400)


@pytest.mark.parametrize("cell", [0.3, 5.0, 400.0])
def test_boxes_equal_all_pairs(spark, cell):
    rnd = random.Random(3)
    points = [(i, rnd.choice([rnd.uniform(-5, 5), 1.0]), rnd.choice([rnd.uniform(-180, 180), 180.0, -180.0, 2.0])) for i in range(200)] + [(900, None, 1.0)]
    boxes = [(j, b, rnd.uniform(-180, 180), b + rnd.uniform(0, 3), rnd.uniform(-180, 180)) for j in range(12) for b in [rnd.uniform(-5, 5)]] + [(50, 1.0, 2.0, 1.0, 2.0), (51, 3.0, 1.0, 2.0, 1.0), (52, None, 1.0, 2.0, 1.0)]
    got = near.inside_boxes(spark.createDataFrame(points, "i int, latitude double, longitude double"), spark.createDataFrame(boxes, "j int, bottom double, left double, top double, right double"), cell)
    inside = lambda p, b: p[1] is not None and b[1] is not None and b[1] <= p[1] <= b[3] and (b[2] <= p[2] <= b[4] if b[2] <= b[4] else p[2] >= b[2] or p[2] <= b[4])
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((p[0], b[0]) for p in points for b in boxes if inside(p, b))


def test_totals_in_boxes(spark):
    rnd = random.Random(4)
    points = [(i, rnd.choice([1.0, 1.5, -0.0, 0.0, None]), rnd.choice([2.0, 179.9, -180.0, float("nan")])) for i in range(300)]
    boxes = [(j, *rnd.choice([(0.0, 1.0, 1.2, 3.0), (-0.0, 1.0, 1.2, 3.0), (0.0, 179.0, 2.0, -179.0), (5.0, 1.0, 6.0, 3.0), (None, 1.0, 1.2, 3.0), (1.0, 2.0, 1.0, 2.0)])) for j in range(90)]
    a, b = spark.createDataFrame(points, "id int, latitude double, longitude double"), spark.createDataFrame(boxes, "j int, bottom double, left double, top double, right double")
    pairs = near.inside_boxes(a, b, 1.5).groupBy("j").agg(near.F.count("*"), near.F.min("id"))
    got = near.totals_in_boxes(a, b, 1.5).select("j", "n", "first_id")
    assert got.count() > 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    assert got.schema["n"].dataType.simpleString() == "bigint"


def test_sites_in_box_makes_no_pairs(spark, tmp_path):
    spark.range(500).selectExpr("id as p_partkey", "'x' as p_name", "'y' as p_type", "2 as p_size", "900.0d as p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(400).selectExpr("id * 1800 as c_custkey", "1 as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    found = joins.sites_in_box(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1800 * i, 500, 0) for i in range(400)] and join_rows(found) <= 400


def test_arguments(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "a int, latitude double, longitude double")
    for wrong in (0, -1, 7000):
        with pytest.raises(ValueError):
            near.within_distance(a, a.withColumnRenamed("a", "b"), wrong)
    with pytest.raises(ValueError):
        near.within_distance(a, a, 5)


@pytest.mark.parametrize("name", ["fuzzy_join", "resolve_unlisted", "forecast_before", "sites_near", "sites_in_box"])
def test_plans_have_no_nested_loops(spark, name):
    plan = getattr(joins, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
