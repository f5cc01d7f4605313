from pyspark.sql import functions as F

from waymark.llm.bloom import Bloom


def test_holds_all_keys_and_few_others(spark):
    keys = spark.range(0, 4000).select((F.col("id") * 3).alias("a"), F.col("id").cast("string").alias("b")).unionAll(spark.createDataFrame([(None, "x"), (5, None)], "a long, b string"))
    bloom = Bloom(keys, ["a", "b"])
    assert keys.where(~bloom.maybe("a", "b")).count() == 0
    others = spark.range(100_000, 140_000).select(F.col("id").alias("a"), F.lit("y").alias("b"))
    assert others.where(bloom.maybe("a", "b")).count() < 800


def test_full_and_empty(spark):
    keys = spark.range(0, 1000).withColumnRenamed("id", "a")
    small = Bloom(keys, ["a"], max_bits=64)  # lets everything pass, and loses nothing
    assert keys.where(small.maybe("a")).count() == 1000
    assert keys.where(Bloom(keys.limit(0), ["a"]).maybe("a")).count() == 0
