"""Windows of event time over a stream: sliding ones and sessions, each told once, when it can't change any more.

The late-row rule: the watermark is the greatest time of earlier batches less ``late``. A window is told when its end
isn't after the watermark; a row all of whose windows have been told is dropped and counted (``late_rows``). Rows that come
out of order within ``late`` count like others, so with ``late`` long enough a stream gives what a table of the same
rows gives. Rows without key or time are in no window. State is one row for each open window of a key, summed up before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _windowed(rows: DataFrame, key: str, time: str, window: Column, late: str, aggregates: list[Column]) -> DataFrame:
    known = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    told = known.withWatermark(time, late).groupBy(window.alias("_w"), key).agg(*aggregates)
    return told.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in told.columns if c not in ("_w", key)])


def sliding(rows: DataFrame, key: str, time: str, length: str, slide: str, late: str, aggregates: list[Column]) -> DataFrame:
    """``key, start, end`` and the aggregates of each window of ``length`` that begins at a multiple of ``slide``."""
    return _windowed(rows, key, time, F.window(F.col(time), length, slide), late, aggregates)


def sessions(rows: DataFrame, key: str, time: str, gap: str, late: str, aggregates: list[Column]) -> DataFrame:
    """The same for runs of rows that are less than ``gap`` apart; a session ends ``gap`` after its last row."""
    return _windowed(rows, key, time, F.session_window(F.col(time), gap), late, aggregates)


def write_windows(windows: DataFrame, target: str) -> StreamingQuery:
    """Start the run over all that is there; told windows are appended to ``target/data``, and a later run goes on from ``target/state``."""
    return windows.writeStream.format("parquet").option("path", f"{target}/data").option("checkpointLocation", f"{target}/state").outputMode("append").trigger(availableNow=True).start()


def late_rows(run: StreamingQuery) -> int:
    """How many rows a run has dropped, as combined by key and window before they reached the state."""
    return sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)
