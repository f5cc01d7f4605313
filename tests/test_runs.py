"""Sources, sinks and streams that keep something between runs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import changes
from waymark.sources import recorded
from waymark.sources.recorded import _Poll, _Reader
from waymark.streaming import latest, stale

T0 = dt.datetime(2024, 1, 1)


def write_lines(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, lines)))


def test_only_files_of_wanted_keys_are_read(spark, tmp_path):
    answers = [{"status": 200, "body": {"v": 1}}, {"status": 500, "body": {"v": 2}}, {"status": 200, "body": None}]
    for k in ["a", "b", "c d", "e=f", "ü", "07"]:
        spark.createDataFrame([(k, json.dumps(r)) for r in answers] + [(k, "no json"), (k, "")], "key string, value string").coalesce(1).write.mode("append").partitionBy("key").text(str(tmp_path / "t"))
    rows = recorded.keyed(spark, str(tmp_path / "t"))
    assert rows.count() == 24 and {r.key for r in rows.collect()} == {"a", "b", "c d", "e=f", "ü", "07"}
    got = rows.where(F.col("key") == "c d")
    assert sorted((r.key, r.status or 0, r.body or "") for r in got.collect()) == sorted([("c d", 0, ""), ("c d", 200, '{"v":1}'), ("c d", 200, "null"), ("c d", 500, "")])
    assert "PartitionFilters: [isnotnull(key" in got._jdf.queryExecution().executedPlan().toString()
    # What is opened: the file of another key can be gone.
    next((tmp_path / "t" / "key=b").glob("part-*")).unlink()
    wanted = rows.where(F.col("key").isin("e=f", "ü", "nowhere"))
    assert sorted(r.key for r in wanted.collect()) == ["e=f"] * 4 + ["ü"] * 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound"):
        rows.where("key = 'b'").collect()


def test_files_without_folders_of_keys(spark, tmp_path):
    write_lines(tmp_path / "x.jsonl", [{"key": "a", "status": 200, "body": 1}, {"key": "b", "status": 200, "body": 2}])
    (tmp_path / "empty.jsonl").write_text("")
    spark.dataSource.register(recorded.RecordedResponses)
    rows = spark.read.format("recorded").option("path", f"file://{tmp_path}").load()
    assert [r.body for r in rows.where("key = 'b'").collect()] == ["2"]
    assert [len(p.paths) for p in _Reader(str(tmp_path), 1).partitions()] == [1] and [len(p.paths) for p in _Reader(str(tmp_path), 1000).partitions()] == [1]
    (tmp_path / "none").mkdir()
    assert spark.read.format("recorded").option("path", str(tmp_path / "none")).load().count() == 0


def test_poll_restarts_where_it_was(spark, tmp_path):
    """Killed within its second batch, the stream goes on to the table of one batch run over all polls."""
    rnd, source, like = random.Random(4), tmp_path / "polls", spark.createDataFrame([], "k long, t long, v string")
    polls = [[{"key": str(k), "status": rnd.choice([200, 200, 500]), "body": {"k": k, "t": rnd.randrange(50), "v": f"{p}-{k}"}} for k in rnd.sample(range(30), 12)] for p in range(4)]
    spark.dataSource.register(recorded.RecordedResponses)

    def run(target, fail=False):
        rows = spark.readStream.format("recorded").option("path", str(source)).load().where("status = 200")
        rows = rows.select(F.from_json("body", "struct<k: bigint, t: bigint, v: string>").alias("b")).select("b.*")
        if fail:
            rows = rows.where(F.raise_error(F.lit("lost")).isNull())
        latest.upsert_stream(rows, "k", ["t", "v"], str(target), buckets=4).awaitTermination()

    target = tmp_path / "table"
    write_lines(source / "0001.jsonl", polls[0])
    run(target)
    write_lines(source / "0002.jsonl", polls[1])
    write_lines(source / "0003.jsonl", polls[2])
    with pytest.raises(Exception, match="lost"):
        run(target, fail=True)
    write_lines(source / "0004.jsonl", polls[3])  # the batch that failed must not take it
    run(target)
    assert {r.v[0] for r in latest.current(spark, str(target), like).collect()} <= {"0", "1", "2"}
    run(target)
    got = {r.k: (r.t, r.v) for r in latest.current(spark, str(target), like).collect()}
    want: dict = {}
    for r in (r["body"] for p in polls for r in p if r["status"] == 200):
        want[r["k"]] = max(want.get(r["k"], (-1, "")), (r["t"], r["v"]))
    assert got == want
    reader = _Poll(str(source))
    assert reader.initialOffset() == {"last": ""} and len(reader.partitions({"last": ""}, reader.latestOffset())) == 4
    assert len(reader.partitions(reader.latestOffset(), reader.latestOffset())) == 0


def test_number_of_buckets_is_kept(spark, tmp_path):
    schema, source, target = "k long, t int, v string", tmp_path / "in", str(tmp_path / "out")
    like = spark.createDataFrame([], schema)
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    table = lambda at: sorted((r.k, r.v) for r in latest.current(spark, at, like).collect())
    spark.createDataFrame([(k, 1, "a") for k in range(40)], schema).write.parquet(str(source))
    latest.upsert_stream(stream(), "k", ["t"], target, buckets=8).awaitTermination()
    spark.createDataFrame([(k, 2, "b") for k in range(5)], schema).write.mode("append").parquet(str(source))
    with pytest.raises(ValueError, match="8 buckets"):
        latest.upsert_stream(stream(), "k", ["t"], target, buckets=5)
    latest.upsert_stream(stream(), "k", ["t"], target).awaitTermination()
    want = [(k, "b" if k < 5 else "a") for k in range(40)]
    assert table(target) == want
    moved = str(tmp_path / "moved")
    latest.rebucket(spark, target, moved, like, "k", 5)
    assert table(moved) == want
    spark.createDataFrame([(39, 3, "c")], schema).write.mode("append").parquet(str(source))
    latest.upsert_stream(stream(), "k", ["t"], moved, buckets=5).awaitTermination()
    assert table(moved) == want[:-1] + [(39, "c")]
    with pytest.raises(ValueError):
        latest.rebucket(spark, target, moved, like, "k", 5)


def test_versions(spark, tmp_path):
    path, t = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert changes.write_version(t, path) == 0
    # A task that fails leaves the version before, and no trace.
    with pytest.raises(Exception, match="broken"):
        changes.write_version(t.withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v"))), path)
    assert changes.versions(spark, path) == [0] and changes.read_version(spark, path).count() == 2
    # Two writers from version 0: the second is refused while the first is at work, and after it has ended.
    (tmp_path / "t" / "_claims" / "v1").touch()
    with pytest.raises(changes.ConcurrentWrite):
        changes.write_version(t, path, base=0)
    assert changes.release(spark, path) == [1]
    assert changes.write_version(changes.read_version(spark, path).where("id = 2"), path, base=0) == 1
    with pytest.raises(changes.ConcurrentWrite):
        changes.write_version(t, path, base=0)
    assert [r.id for r in changes.read_version(spark, path).collect()] == [2] and changes.release(spark, path) == []


def test_entities_are_whole(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "c"), (None, "d"), (3, None), (3, None)], "k long, url string")
    good, bad = changes.whole_entities(rows, "k", F.when(F.col("url").isNull(), "no url"))
    assert sorted(map(tuple, good.collect())) == [(2, "b"), (2, "c")]
    assert {(r.k, tuple(r.faults), r.n_faults) for r in bad.collect()} == {(1, ("no url",), 1), (3, ("no url",), 2), (None, ("no key",), 1)}


def stream_of(spark, path, batches):
    """Runs of one stream, a file a run."""
    schema = "site long, ts timestamp, report long"
    for rows in batches:
        spark.createDataFrame([(s, None if m is None else T0 + dt.timedelta(minutes=m), r) for s, m, r in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        events = spark.readStream.schema(schema).parquet(f"{path}/in")
        stale.write_stale(stale.stale_reports(events, "site", "ts", "report", 3600, "30 minutes"), f"{path}/out").awaitTermination()
    return sorted((r.site, r.report, round((r.ts - T0).total_seconds() / 60), round((r.stale_at - r.ts).total_seconds())) for r in stale.read_stale(spark, f"{path}/out").collect())


def test_expiry(spark, tmp_path):
    batches = [
        [(1, 0, 10), (1, 50, 11), (2, 5, 20), (3, 100, 30), (None, 1, 1), (4, None, 1)],  # 2 is silent from 65 on
        [(1, 109, 12), (3, 80, 31), (2, 200, 21)],  # 31 comes out of order but in time
        [(1, 400, 13), (1, 100, 99)],  # 12 went stale at 169; report 99 is too late
        [(5, 1000, 50)],
    ]
    assert stream_of(spark, tmp_path, batches) == sorted([(2, 20, 5, 3600), (3, 30, 100, 3600), (1, 12, 109, 3600), (2, 21, 200, 3600), (1, 13, 400, 3600)])


def test_expiry_of_many_batches_is_that_of_one(spark, tmp_path):
    rnd = random.Random(5)
    rows = sorted(((rnd.randrange(6), m, m) for m in rnd.sample(range(5000), 120)), key=lambda r: r[1])
    one = stream_of(spark, tmp_path / "one", [rows])
    many = stream_of(spark, tmp_path / "many", [rows[k : k + 30] for k in range(0, 120, 30)])
    want = []
    for s in range(6):
        own = [r for r in rows if r[0] == s]
        for a, b in zip(own, [*own[1:], None], strict=True):
            if (b[1] if b else rows[-1][1] - 30) - a[1] > 60:
                want.append((s, a[2], a[1], 3600))
    assert one == many == sorted(want)


def test_expiry_of_odd_rows(spark, tmp_path):
    batches = [
        [(1, 10, 10), (1, 10, 10), (1, 10, 12), (1, 10, 11), (1, 70, 13), (1, 131, 14), (1, 131, 14)],  # repeated, at one time, exactly and just over an hour apart
        [(2, 101, 20), (2, 100, 21), (1, 131, 9), (1, 120, 15), (None, None, None)],  # the run before has ended at the watermark 101, so 20 is too late; what comes before a site's last report changes nothing
        [(3, 400, 30)],
        [(1, 370, 16), (1, 369, 17), (4, 371, 40)],  # the watermark is at 370
    ]
    assert stream_of(spark, tmp_path, batches) == sorted([(1, 13, 70, 3600), (1, 14, 131, 3600)])


def test_expiry_sends_numbers_alone(spark, tmp_path):
    """No timestamp goes to Python, and a site's rows cost one read and one write of its state."""
    events = spark.readStream.schema("site long, ts timestamp, report long").parquet(str(tmp_path))
    plan = stale.stale_reports(events, "site", "ts", "report", 3600)._jdf.queryExecution().analyzed()
    while not plan.nodeName().startswith("TransformWithState"):
        plan = plan.children().apply(0)
    sent = plan.children().apply(0).schema()
    assert {(sent.apply(i).name(), sent.apply(i).dataType().typeName()) for i in range(sent.length())} == {("key", "long"), ("at", "long"), ("report", "long")}

    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

        def getValueState(self, *a):
            return self

    p = stale._Expiry(3600_000_000)
    p.init(Handle())
    watermark = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 1000})()
    rows = [(7, 4_000_000_000, 3), (7, 999_999, 1), (7, 1_000_000, 2)]
    assert [tuple(r) for r in p.handleInputRows((7,), iter(rows), watermark)] == [(7, 1_000_000, 2)]
    assert calls == ["get", "update", "registerTimer"]


def test_windows_over_batches_are_those_of_a_table(spark, tmp_path):
    """Rows out of order within the watermark count; a later one is dropped and counted."""
    from waymark.streaming import windows

    schema = "site long, ts timestamp, v long"
    batches = [[(1, 5, 1), (1, 65, 2), (2, 10, 3), (None, 1, 9)], [(1, 50, 4), (2, 200, 5)], [(1, 20, 6), (2, 190, 7)], [(3, 900, 8)]]
    dropped = {"sliding": 0, "sessions": 0}
    for rows in batches:
        spark.createDataFrame([(s, T0 + dt.timedelta(minutes=m), v) for s, m, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for kind, rule in (("sliding", lambda d: windows.sliding(d, "site", "ts", "60 minutes", "30 minutes", "30 minutes", [F.sum("v").alias("v")])), ("sessions", lambda d: windows.sessions(d, "site", "ts", "30 minutes", "30 minutes", [F.sum("v").alias("v")]))):
            run = windows.write_windows(rule(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/{kind}")
            run.awaitTermination()
            dropped[kind] += windows.late_rows(run)
    kept = [(s, m, v) for rows in batches[:3] for s, m, v in rows if s is not None and (s, m) != (1, 20)]
    minutes = lambda t: round((t - T0).total_seconds() / 60)
    told = lambda kind: sorted((r.site, minutes(r.start), minutes(r.end), r.v) for r in spark.read.parquet(f"{tmp_path}/{kind}/data").collect())
    want: dict = {}
    for s, m, v in kept:
        for start in (m // 30 * 30, m // 30 * 30 - 30):
            want[s, start, start + 60] = want.get((s, start, start + 60), 0) + v
    assert told("sliding") == sorted((*k, v) for k, v in want.items()) and dropped["sliding"] >= 1
    assert told("sessions") == [(1, 5, 35, 1), (1, 50, 95, 6), (2, 10, 40, 3), (2, 190, 230, 12)] and dropped["sessions"] == 1


def test_sketches(spark):
    from waymark.operators import sketches

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rnd = random.Random(1)
    rows = [(day(rnd.randrange(20)), rnd.randrange(3000)) for _ in range(20_000)] + [(day(3), None), (None, 5)]
    df = spark.createDataFrame(rows, "d date, site long")
    stored = sketches.daily(df, F.col("d"), F.col("site"))
    ranges = [("a", day(0), day(19)), ("b", day(4), day(4)), ("c", day(3), day(9)), ("d", day(50), day(60)), ("e", day(9), day(3)), ("f", day(15), day(30))]
    got = {r.k: (r.n, r.ids) for r in sketches.over_ranges(stored, spark.createDataFrame(ranges, "k string, first date, last date")).collect()}
    for k, a, b in ranges:
        inside = [s for d, s in rows if d is not None and a <= d <= b]
        exact = len({s for s in inside if s is not None})
        assert got[k][0] == len(inside) and abs(got[k][1] - exact) <= 0.05 * exact
    again = sketches.daily(df.where(F.col("d") == day(4)).limit(7), F.col("d"), F.col("site"))
    assert {r.day: r.n for r in sketches.replace_days(stored, again).collect()}[day(4)] == 7
    assert sketches.daily(df.limit(0), F.col("d"), F.col("site")).count() == 0
