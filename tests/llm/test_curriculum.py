import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import curriculum as c


def water_fill(sizes, weights, cap=3):
    """Shares by weight; what is over a cap is shared again until nothing is."""
    total, target, free, rest = sum(sizes), [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free and rest > 1e-9:
        w = sum(weights[i] for i in free)
        give = {i: target[i] + rest * weights[i] / w for i in free}
        rest = sum(max(0.0, g - cap * sizes[i]) for i, g in give.items())
        for i, g in give.items():
            target[i] = min(g, cap * sizes[i])
        free = {i for i in free if target[i] < cap * sizes[i] - 1e-12}
    assert abs(sum(target) - total) < 1e-6 * max(1, total)
    return target


@pytest.mark.parametrize("sizes", [[10, 100, 1000], [1, 1, 1000], [0, 5, 5, 0, 90], [7], [3, 0], [100, 1, 1, 1, 100, 1, 50]])
def test_targets(spark, sizes):
    rows = [(f"s{k:02}" if k < len(sizes) - 1 else None, n) for k, n in enumerate(sizes)]
    got = c.source_targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy(F.col("source").asc_nulls_last()).collect()
    want = water_fill(sizes, [c.WEIGHTS[k % 3] for k in range(len(sizes))])
    assert np.allclose([r.target for r in got], want)


def test_position_inverts_the_integral(spark):
    for knots in (*c.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))):
        t = np.linspace(0, 1, 20001)
        rate = np.interp(t, *zip(*knots, strict=True))
        cumulative = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(t))])
        shares = np.linspace(0.01, 0.99, 37)
        got = [r[0] for r in spark.createDataFrame([(float(s),) for s in shares], "s double").select(c.position(F.col("s"), knots)).collect()]
        assert np.allclose(np.interp(got, t, cumulative / cumulative[-1]), shares, atol=1e-6)


def docs_of(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", None, "hot"][min(3, k % 7)], k) for k in range(600)]
    rows += [(7000, None, "a", 0), (7001, "", "b", 0), (None, "x y", "a", 1), (5, rows[5][1], rows[5][2], 5), (8000, "big " * 3000, "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


def test_plan(spark):
    docs = docs_of(spark)
    rows = c.plan_mix(docs).collect()
    assert len(rows) == docs.count() and sum(r.size for r in rows) == sum(len((r.text or "").split()) for r in docs.collect())
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(x.taken for x in r.reads)
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(v) == int(t + 0.5) for (_, t), v in by.items())
    first = [r.position for r in rows if r.position is not None]
    assert first == sorted(first) and all(r.position is not None for r in rows[: len(first)])
    assert sorted(map(str, c.plan_mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert c.plan_mix(docs.limit(0)).count() == 0


def test_mix(spark):
    docs = docs_of(spark)
    plan, out = c.plan_mix(docs).collect(), c.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    assert all((r.doc_id, r.text) in whole for r in rows)  # texts stay whole
    want = sorted((x.position, str(r.doc_id)) for r in plan for x in r.reads if 2 * x.taken >= r.size)
    # One slice, so rows come in the order of their positions; equal positions by id.
    assert [str(r.doc_id) for r in rows] == [i for _, i in want]
    got = {}
    for r in rows:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    largest = max(r.size for r in plan)
    targets = {r.source: r.target for r in c.source_targets(docs.groupBy("source").agg(F.sum(c.words(F.col("text"))).alias("source_size"))).collect()}
    assert all(abs(got.get(s, 0) - t) <= largest / 2 + 1 for s, t in targets.items())
    assert c.mix(docs.limit(0)).count() == 0


def test_mix_is_in_order_over_slices_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(c, "SLICE_WORDS", 900)
    docs = docs_of(spark)
    position = {}
    for r in c.plan_mix(docs).collect():
        position.setdefault(str(r.doc_id), set()).update(x.position for x in r.reads)
    first = c.mix(docs)
    assert first.rdd.getNumPartitions() > 5
    rows = [(str(r.doc_id), r.text) for r in first.collect()]
    at = -1.0
    for i, _ in rows:  # each read's position is one of its document's, and none goes back
        at = min(p for p in position[i] if p >= at - 1e-12)
    assert rows == [(str(r.doc_id), r.text) for r in c.mix(docs.repartition(7)).collect()]


def test_null_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, f"text number {k}", "a") for k in range(300)], "doc_id long, text string, source string")
    assert c._sized(docs, "text", "doc_id", "source").select(f"{c.P}bucket").distinct().count() > 200


def test_main_path_is_native(spark):
    plan = c.mix(docs_of(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_mix_moves_texts_once_and_keeps_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "SLICE_WORDS", 900)
    rows = [(3, "one row " * 4, "a")] * 500 + [(k, f"w{k} " * (k % 9), "bc"[k % 2]) for k in range(400)] + [(None, "no id", None)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = {}, {}
    for r in c.plan_mix(docs).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + sum(2 * x.taken >= r.size for x in r.reads)
    for sent in (500_000, 0):  # segments sent to the tasks, or joined by bucket
        monkeypatch.setattr(c, "SENT_SEGMENTS", sent)
        out, got = c.mix(docs), {}
        moves = out._jdf.queryExecution().executedPlan().toString().count("Exchange")
        if sent:
            assert moves == 2  # the segments' broadcast and the texts' shuffle
        for r in out.collect():
            got[r.doc_id, len(r.text.split())] = got.get((r.doc_id, len(r.text.split())), 0) + 1
        assert got == {k: n for k, n in want.items() if n}
