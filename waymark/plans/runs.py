"""Registered queries of jobs that keep something between runs: recorded responses, polls, state with expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import changes, sketches
from waymark.plans.registry import query
from waymark.sources import recorded, tables
from waymark.sources.shared import new_path
from waymark.streaming import latest, stale, windows


def _responses(spark: SparkSession, root: str) -> DataFrame:
    """Events as the answers of a service: key, status and the report as body; errors have none."""
    e = tables.read(spark, root, "events")
    body = F.struct(F.col("event_id"), F.col("user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value")
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return e.select("event_id", (F.col("user_id") % 20).cast("string").alias("key"), status.alias("status"), body.alias("body"))


_BODY = "struct<event_id: bigint, user_id: bigint, ts: timestamp_ntz, value: double>"


@query("select event_id, user_id, value from events where event_type <> 'error' and user_id % 20 in (3, 17)")
def recorded_lookup(spark, root):
    """The answers under two keys, from a folder for each key: other folders aren't opened."""
    path = new_path(spark, "recorded")
    line = F.to_json(F.struct("status", "body"))
    _responses(spark, root).select("key", line.alias("value")).write.partitionBy("key").text(path)
    rows = recorded.keyed(spark, path).where(F.col("key").isin("3", "17") & (F.col("status") == 200))
    return rows.select(F.from_json("body", _BODY).alias("b")).select("b.event_id", "b.user_id", "b.value")


@query("select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events where event_type <> 'error' group by 1")
def polled_latest(spark, root):
    """The latest report of each site, from the files that polls have left, as a stream into a table."""
    polls, target = new_path(spark, "polls"), new_path(spark, "polled")
    line = F.to_json(F.struct("key", "status", "body"))
    _responses(spark, root).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(polls)
    spark.dataSource.register(recorded.RecordedResponses)
    rows = spark.readStream.format("recorded").option("path", polls).load().where("status = 200")
    rows = rows.select(F.from_json("body", _BODY).alias("b")).select("b.user_id", "b.ts", "b.event_id", "b.value")
    latest.upsert_stream(rows, "user_id", ["ts", "event_id"], target).awaitTermination()
    return latest.current(spark, target, spark.createDataFrame([], rows.schema))


@query(
    "with n as (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as later, max(ts) over () as last from events) "
    "select user_id, event_id, ts, ts + interval 6 hour as stale_at from n where coalesce(later, last) > ts + interval 6 hour"
)
def stale_forecasts(spark, root):
    """Reports that none followed within six hours, by state with timers over a stream of the events."""
    schema = tables.read(spark, root, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    target = new_path(spark, "stale")
    stale.write_stale(stale.stale_reports(events, "user_id", "ts", "event_id", 21_600), target).awaitTermination()
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return stale.read_stale(spark, target).select("user_id", "event_id", local("ts"), local("stale_at"))


def _stream_of_events(spark: SparkSession, root: str) -> DataFrame:
    schema = tables.read(spark, root, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)


def _told(spark: SparkSession, told: DataFrame, label: str) -> DataFrame:
    target = new_path(spark, label)
    windows.write_windows(told, target).awaitTermination()
    rows = spark.read.parquet(f"{target}/data")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "with e as (select user_id, value, ts, unnest(range(0, 6)) as i from events), w as (select user_id, date_trunc('hour', ts) - to_hours(i::int) as start, value from e) "
    "select user_id, start, start + interval 6 hour as \"end\", count(*) as n, max(value) as top from w where start + interval 6 hour <= (select max(ts) - interval 10 minute from events) group by 1, 2"
)
def sliding_windows(spark, root):
    """Six hours every hour for each site, those that are closed at the end of the stream."""
    rows = windows.sliding(_stream_of_events(spark, root), "user_id", "ts", "6 hours", "1 hour", "10 minutes", [F.count("*").alias("n"), F.max("value").alias("top")])
    return _told(spark, rows, "sliding")


@query(
    "with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 4 hour then 1 else 0 end as cut from events), "
    "s as (select user_id, ts, sum(cut) over (partition by user_id order by ts) as session from e) "
    "select user_id, min(ts) as start, max(ts) + interval 4 hour as \"end\", count(*) as n from s group by user_id, session having max(ts) + interval 4 hour <= (select max(ts) - interval 10 minute from events)"
)
def session_windows(spark, root):
    """Visits to each site: runs of reports less than four hours apart."""
    return _told(spark, windows.sessions(_stream_of_events(spark, root), "user_id", "ts", "4 hours", "10 minutes", [F.count("*").alias("n")]), "sessions")


@query(
    "with d as (select distinct ts::date as last from events) select last, count(*) as n, count(distinct user_id) as exact, true as near from d join events on ts::date between last - 6 and last group by 1"
)
def weekly_sites(spark, root):
    """Sites with a report in the week up to each day, from stored daily sketches: the estimate is within 5 % of the exact number."""
    e = tables.read(spark, root, "events").withColumn("day", F.to_date("ts"))
    path = new_path(spark, "sketches")
    changes.write_version(sketches.daily(e, F.col("day"), F.col("user_id")), path)
    stored = changes.read_version(spark, path)
    weeks = stored.select(F.date_sub("day", 6).alias("first"), F.col("day").alias("last"))
    told = sketches.over_ranges(stored, weeks)
    week = e.select("user_id", F.explode(F.sequence("day", F.date_add("day", 6))).alias("last")).groupBy("last").agg(F.countDistinct("user_id").alias("exact"))
    return told.join(week, "last").select("last", "n", "exact", (F.abs(F.col("ids") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))
