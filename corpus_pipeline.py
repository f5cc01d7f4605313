"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Every stage reads what the one before it wrote. The first three keep or drop whole documents, the fourth
repeats documents by their source's target weight, the last cuts token ids into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import circulant, compress_lang, curriculum, packing, toxic_crf
from waymark.llm.bloom import Bloom
from waymark.llm.folds import held_out
from waymark.llm.scratch import bounded_batches, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the model learns from the labelled ones here."""
    model = toxic_crf.fit_toxicity(docs, bounded_batches(spark).read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return toxic_crf.score_toxicity(docs, model).where("toxic_pred = 0").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the compressed sizes tell a language; those without letters or a margin go."""
    bounded_batches(spark)
    model = compress_lang.fit_languages(docs, ~held_out())
    return compress_lang.classify(docs, model).where("not lang_rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8), whatever their ids.

    Rows are told apart by id and text, so a repeated id drops no other text and rows without an id take part. Of a
    group the row with the smallest hash of both stays, of rows that repeat id and text any one; rows without words
    are like no other row.
    """
    bounded_batches(spark)
    row = F.xxhash64(F.col("doc_id"), F.col("text"))
    groups = circulant.near_duplicates(docs.select(row.alias("row"), "text"), id_col="row")
    groups = write_table(groups.select(F.col("doc_id").alias("row"), "kept"), "rows")
    repeated = groups.where("kept").groupBy("row").count().where("count > 1").select("row", F.lit(True).alias("again"))
    listed = write_table(groups.where("not kept").select("row", F.lit(False).alias("again")).distinct().unionAll(repeated), "listed")
    # Only rows that may be on the list are shuffled; all others stay where they are.
    whole = docs.select(F.struct(*docs.columns).alias("doc"), row.alias("at"))
    maybe = Bloom(listed, ["row"]).maybe("at")
    asked = whole.where(maybe).join(listed, F.col("at") == F.col("row"), "left")
    once = asked.where("again").dropDuplicates(["at"])
    return whole.where(~maybe).select("doc.*").unionAll(asked.where("again is null").select("doc.*")).unionAll(once.select("doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets, in training order."""
    return curriculum.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids; sequence ids follow the training order in which the mix is stored."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), stored_order=packing.is_stored(docs), memo_bytes=40 << 20)  # workers hold what earlier stages left


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A random field, compression and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
