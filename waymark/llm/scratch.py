"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.sources.shared import new_path


#: Spark's setting by which a query removes its shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the files, so a lost executor costs a reread and not a recomputation.

    Files lie under ``<shared folder>/<application id>/``; that folder can go when the application has ended. Shuffle
    files of the write go with its end, so a job of many rounds holds those of one.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch on the way to a Python worker and back.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches of this session hold ``BATCH_BYTES`` at most: whole texts can be long, and workers share a machine."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
