"""The latest observation for each key as a stream: the poll-and-refresh job without the poll."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.changes import upsert_latest
from waymark.sources.shared import new_path

BUCKETS = 64


def latest_by_key(stream: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Running state: one row a key with the largest version. Works on streams (update mode) and tables."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert_stream(stream: DataFrame, key: str, version: list[str], target: str, buckets: int | None = None):
    """Start an upsert of every available row into ``target``; returns the running query.

    The table is cut into buckets by a hash of the key. Their number is written beside the state before the first batch
    and kept; another one is refused later (``ValueError``), and ``rebucket`` makes a table of another number. A batch writes
    only the buckets that it touches, whole, into a folder of its own; ``current`` reads each bucket's last finished
    folder. A batch that runs again reads only what earlier ones wrote and overwrites its own folder.
    """
    held = _held_buckets(stream.sparkSession, target, buckets or BUCKETS)
    if buckets not in (None, held):
        raise ValueError(f"{target} has {held} buckets, not {buckets}")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", _bucket(key, held))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most as many numbers as buckets
        if not touched:
            return
        places = {b: at for b, at in _places(spark, target, batch_id).items() if b in touched}
        old = _read(spark, target, places, new)
        upsert_latest(old, new, key, version).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/batch={batch_id}")

    writer = latest_by_key(stream, key, version).writeStream.outputMode("update").foreachBatch(apply)
    return writer.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()


def _held_buckets(spark: SparkSession, target: str, wanted: int) -> int:
    """The number of buckets that a table was begun with; of a new one it is set to ``wanted``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{target}/buckets")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()) for f in fs.globStatus(path(f"{target}/buckets/[0-9]*")) or []]
    if not found:
        if fs.globStatus(path(f"{target}/data/batch=*")):  # a table from before numbers were kept
            raise ValueError(f"the number of buckets of {target} is not known: write the one it has as an empty file {target}/buckets/<number>")
        fs.mkdirs(folder)
        fs.createNewFile(path(f"{target}/buckets/{wanted}"))
        found = [wanted]
    return found[0]


def rebucket(spark: SparkSession, target: str, to: str, like: DataFrame, key: str, buckets: int) -> None:
    """The table of ``target`` as the first batch of a new one with another number of buckets, when no stream runs.

    A batch rewrites the buckets that it touches, so their number should grow with the table: at some 100 MB a bucket a
    small batch of scattered keys costs at most that much for each key.
    """
    if _held_buckets(spark, to, buckets) != buckets or _places(spark, to):
        raise ValueError(f"{to} is in use")
    rows = current(spark, target, like).withColumn("bucket", _bucket(key, buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/data/batch=-1")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The last finished batch that wrote each bucket, of those below ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda pattern: [f.getPath().toString() for f in fs.globStatus(path(f"{target}/data/{pattern}")) or []]
    done = {int(re.search(r"batch=(-?\d+)", p)[1]) for p in listed("batch=*/_SUCCESS")}
    out: dict[int, int] = {}
    for p in listed("batch=*/bucket=*"):
        batch, bucket = map(int, re.search(r"batch=(-?\d+)/bucket=(\d+)", p).groups())
        if batch in done and (before is None or batch < before):
            out[bucket] = max(batch, out.get(bucket, batch))
    return out


def _read(spark: SparkSession, target: str, places: dict[int, int], like: DataFrame) -> DataFrame:
    if not places:
        return spark.createDataFrame([], like.schema)
    paths = [f"{target}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(places.items())]
    rows = spark.read.schema(like.drop("bucket").schema).parquet(*paths)
    inner = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int")
    return rows.withColumn("bucket", inner).select(*like.columns)


def current(spark: SparkSession, target: str, like: DataFrame) -> DataFrame:
    """The table as the last finished batch left it; ``like`` gives its columns."""
    return _read(spark, target, _places(spark, target), like)


def stream_latest(spark: SparkSession, root: str) -> DataFrame:
    """The latest event of each user, through a stream over the events table."""
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    rows = events.select("user_id", "ts", "event_id", "event_type", "value", "props")
    target = new_path(spark, "stream-latest")
    upsert_stream(rows, "user_id", ["ts", "event_id"], target).awaitTermination()
    return current(spark, target, latest_by_key(spark.createDataFrame([], rows.schema), "user_id", ["ts", "event_id"]))
