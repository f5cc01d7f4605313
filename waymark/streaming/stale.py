"""State for each site with expiry: a forecast goes stale when no report has come for some time of the reports' own clock."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOLD = Row("key", "at", "report")


class _Expiry(StatefulProcessor):
    """Keeps the latest report of a site, in microseconds. A report beyond its term, or a timer, says that it had gone stale."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, report long")

    def _timer(self, last: tuple[int, int]) -> int:
        """The first millisecond that is beyond the term."""
        return (last[0] + self.micros) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        at, report = array("q"), array("q")
        for _, t, r in rows:
            if t >= late:
                at.append(t)
                report.append(r)
        first = last = self.last.get()
        order = np.lexsort((report, at))
        for now in zip(np.asarray(at)[order].tolist(), np.asarray(report)[order].tolist(), strict=True):
            if last is None or now > last:
                if last is not None and now[0] > last[0] + self.micros:
                    yield _TOLD(key[0], *last)
                last = now
        if last != first:
            if first is not None:
                self.handle.deleteTimer(self._timer(first))
            self.last.update(last)
            self.handle.registerTimer(self._timer(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()
        if last is not None:
            self.last.clear()  # a silent site holds no state
            yield _TOLD(key[0], *last)

    def close(self) -> None:
        pass


def stale_reports(stream: DataFrame, key: str, time: str, report: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """``key, report, time, stale_at`` for every report that none followed within ``seconds``.

    ``key`` and ``report`` are long, ``time`` a timestamp; of reports at one time the greatest counts. Rows before the watermark
    (the greatest time of earlier batches less ``late``) come too late and change nothing, so a site that was
    found stale isn't found twice; what arrives within ``late`` is put in order. The last report of a site is told
    when the watermark has passed its term. Rows without key, time or report take no part. A site's state is two numbers,
    and none while it is stale; its reports of one batch are sorted in memory, 16 bytes each. Rows go to Python one by one,
    not as a frame for each site. A run whose state was begun with frames (transformWithStateInPandas) is refused by Spark:
    give it a new target.
    """
    given = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(report).isNotNull())
    timed = given.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(report).cast("long").alias("report")).withWatermark("time", late)
    # Python gets the time as a number alone. The mark as the column of the watermark goes with it, so the state operator still drops late rows.
    at = F.unix_micros("time").alias("at", metadata=timed.schema["time"].metadata)
    rows = timed.select("key", at, "report").groupBy("key")
    found = rows.transformWithState(statefulProcessor=_Expiry(seconds * 1_000_000), outputStructType="key long, at long, report long", outputMode="Append", timeMode="EventTime")
    return found.select(F.col("key").alias(key), F.col("report").alias(report), F.timestamp_micros("at").alias(time), F.timestamp_micros(F.col("at") + seconds * 1_000_000).alias("stale_at"))


def write_stale(stale: DataFrame, target: str) -> StreamingQuery:
    """Start the run over all that is there; rows are appended to ``target/data``, and a later run goes on from ``target/state``."""
    conf = stale.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # a query keeps the provider that it has begun with
    try:
        writer = stale.writeStream.format("parquet").option("path", f"{target}/data").option("checkpointLocation", f"{target}/state")
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)


def read_stale(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/data")
