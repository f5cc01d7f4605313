"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

1. Each document's size is its number of words; each source's size is the sum.
2. Targets share the size of the whole corpus by weight, stop at ``max_repeats`` times a source's size, and
   hand what is over to the others by weight: the water level that fits is found from the sources in order of
   cap over weight.
3. A source's documents stand in a fixed pseudo-random order (md5 of the id). A document at words [c, c + n)
   of its source of S words is read in every epoch e whose [e S + c, e S + c + n) lies below the target; of the
   one document that a target cuts, ``plan_mix`` takes so many words that the source meets its target exactly, and
   ``mix``, whose texts stay whole, takes it if that is nearer to the target than leaving it out.
4. Each weight class has a schedule: a piecewise-linear rate over training time 0 to 1. Its integral, scaled
   to the target, is the source's cumulative token demand; inverting it at the middle of a read gives the
   read's training position. Documents are range-sorted by position, ``mix`` over fixed slices of the time, so
   that two runs write the same files.

The sum over a source runs in two steps, over 4096 hash buckets of the source and within each, so a source
that holds a third of all rows is spread over thousands of groups. The tables of sources, and of the buckets
of a source, are small at any size of the corpus.

Rows: null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
rows with a null ``doc_id`` are ordered by their text; a very long text is a document like the others; equal rows each count; sources of size 0 have target 0; an empty
table gives no rows; extra columns, whatever their names, are carried by ``mix`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.scratch import write_table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: For each weight the rate at training time 0, 1/2 and 1: heavy sources fade, light ones come late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source: three hexadecimal digits.
BUCKET_DIGITS = 3
#: The operator's own columns; a prefix keeps them apart from any column of the input.
P = "_mix_"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, class, target`` from ``source, source_size``. One row for each source, in one task."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(in_order) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", (rank % len(weights)).cast("int").alias("class"), w.alias("w"))
    rows = rows.withColumn("cap", (max_repeats * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy(F.lit(1))
    fullest = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("capped_w"),
    )
    # The level if just the sources before this one are full; the first source that it leaves below its cap decides.
    level = (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("capped_w"))
    whole = fullest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", F.first(F.when(level <= F.col("ratio"), level), ignorenulls=True).over(whole))
    return rows.select("source", "source_size", "class", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def position(share: Column, knots) -> Column:
    """The time by which a schedule has asked for ``share`` (0 to 1) of its whole."""
    pieces = list(zip(knots, knots[1:], strict=False))
    whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in pieces)
    asked, out = 0.0, None
    for (t0, a), (t1, b) in pieces:
        area = F.greatest(share * whole - asked, F.lit(0.0))
        slope = (b - a) / (t1 - t0)
        # a x + slope x^2 / 2 = area, in the form that holds for a slope of 0
        root = F.sqrt(F.greatest(a * a + 2 * slope * area, F.lit(0.0)))
        at = F.lit(t0) + F.coalesce(F.try_divide(2 * area, a + root), F.lit(0.0))
        asked += (t1 - t0) * (a + b) / 2
        here = F.least(at, F.lit(t1))
        out = here if out is None else F.when(share * whole <= asked - (t1 - t0) * (a + b) / 2, out).otherwise(here)
    return out


def _sized(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> DataFrame:
    """``docs`` with size, source, order key, id and hash bucket. Of null ids the text decides order and bucket."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = docs.withColumns({f"{P}size": words(F.col(text_col)), f"{P}source": F.col(source_col), f"{P}key": F.md5(name.cast("binary")), f"{P}id": F.col(id_col)})
    return rows.withColumn(f"{P}bucket", F.substring(f"{P}key", 1, BUCKET_DIGITS))


def _bucket_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(f"{P}source", f"{P}bucket").agg(F.sum(f"{P}size").alias("bucket_size"))


def _facts(buckets: DataFrame, weights, max_repeats: int) -> DataFrame:
    """For each bucket ``b`` of a source ``s``: the words before it, and its source's size, target and class."""
    targets = source_targets(buckets.groupBy(F.col(f"{P}source").alias("source")).agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    earlier = Window.partitionBy(f"{P}source").orderBy(f"{P}bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(f"{P}source", f"{P}bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias(f"{P}before"))
    same = F.col(f"{P}source").eqNullSafe(F.col("source"))
    return starts.join(targets, same).select(
        F.col(f"{P}source").alias("s"), F.col(f"{P}bucket").alias("b"), f"{P}before", F.col("source_size").alias(f"{P}source_size"), F.col("target").alias(f"{P}target"), F.col("class").alias(f"{P}class")
    )


def _of_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    return rows.join(facts, F.col(f"{P}source").eqNullSafe(F.col("s")) & (F.col(f"{P}bucket") == F.col("b"))).drop("s", "b")


def _read(start: Column, epoch, schedules) -> Column:
    """Words taken of a document that begins ``start`` words into its source, and its position, in an epoch."""
    at = start + epoch * F.col(f"{P}source_size")
    taken = F.greatest(F.lit(0), F.least(F.col(f"{P}size"), F.floor(F.col(f"{P}target") + 0.5) - at)).cast("long")
    share = F.coalesce(F.try_divide(at + taken / 2, F.col(f"{P}target")), F.lit(0.0))
    when = F.lit(None).cast("double")
    for c, knots in enumerate(schedules):
        when = F.when(F.col(f"{P}class") % len(schedules) == c, position(share, knots)).otherwise(when)
    return F.struct(taken.alias("taken"), when.alias("position"))


def _planned(rows: DataFrame, buckets: DataFrame, weights, schedules, max_repeats: int) -> DataFrame:
    """``rows`` of ``_sized`` with the operator's columns: source_size, target, and ``reads`` (taken, position)."""
    rows = _of_bucket(rows, _facts(buckets, weights, max_repeats))
    within = Window.partitionBy(f"{P}source", f"{P}bucket").orderBy(f"{P}key", f"{P}id", f"{P}size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(f"{P}before") + F.coalesce(F.sum(f"{P}size").over(within), F.lit(0))
    rows = rows.withColumn(f"{P}start", start)
    reads = [_read(F.col(f"{P}start"), epoch, schedules) for epoch in range(max_repeats)]
    return rows.withColumn(f"{P}reads", F.filter(F.array(*reads), lambda r: r["taken"] > 0))


def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row for each document, range-sorted by the position of its first read; documents not read come last.

    ``doc_id, size, source_size, target, taken, position, reads``. Texts are counted and dropped in the scan.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = _sized(narrow, "text", "doc_id", "source")
    rows = _planned(sized, _bucket_sizes(sized), weights, schedules, max_repeats).select(
        "doc_id",
        F.col(f"{P}size").alias("size"),
        F.col(f"{P}source_size").alias("source_size"),
        F.col(f"{P}target").alias("target"),
        F.aggregate(f"{P}reads", F.lit(0).cast("long"), lambda a, r: a + r["taken"]).alias("taken"),
        F.get(f"{P}reads", F.lit(0))["position"].alias("position"),
        F.col(f"{P}reads").alias("reads"),
    )
    order = [F.col("position").asc_nulls_last(), "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


#: ``mix`` writes slices of about so many words, and at most so many slices (parameters; beyond that slices get larger).
SLICE_WORDS, MOST_SLICES = 2_000_000, 100_000
#: Up to so many segments, of some 200 bytes, are sent to every task; more are joined by bucket, which moves texts once more.
SENT_SEGMENTS = 500_000


def _whole(read: Column) -> Column:
    """Whether ``mix`` takes the document of a read: at least half of it lies below the target."""
    return (read["taken"] > 0) & (2 * read["taken"] >= F.col(f"{P}size"))


def _segments(sizes: DataFrame, facts: DataFrame, slices: int, schedules, max_repeats: int) -> DataFrame:
    """For each bucket its facts and ``segments``: (epoch, slice, words before, first and last key and size).

    A segment is what one epoch reads of a bucket in one slice of the time. Rows of one key and size can't be told
    apart, so all go to the slice of the first. First and last are null where a segment is the whole bucket.
    """
    bucket = [f"{P}source", f"{P}bucket"]
    rows = _of_bucket(sizes.where(F.col(f"{P}size") > 0), facts)
    place = Window.partitionBy(*bucket).orderBy(f"{P}key", f"{P}size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col(f"{P}before") + F.coalesce(F.sum(f"{P}size").over(place), F.lit(0)))
    rows = rows.withColumns({"head": F.min("start").over(Window.partitionBy(*bucket, f"{P}key", f"{P}size")), "n": F.count("*").over(Window.partitionBy(*bucket))})
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    at = _read(F.col("head"), F.col("epoch"), schedules)["position"]
    rows = rows.where(_whole(_read(F.col("start"), F.col("epoch"), schedules))).withColumn("slice", F.least(F.floor(at * slices), F.lit(slices - 1)).cast("int"))
    mark, whole, carried = F.struct(f"{P}key", f"{P}size"), F.count("*") == F.first("n"), [f"{P}source_size", f"{P}target", f"{P}class"]
    cut = rows.groupBy(*bucket, *carried, "epoch", "slice").agg(
        F.min("start").alias("start"), F.when(~whole, F.min(mark)).alias("first"), F.when(~whole, F.max(mark)).alias("last")
    )
    parts = F.collect_list(F.struct("epoch", "slice", "start", "first", "last")).alias(f"{P}segments")
    return cut.groupBy(F.col(f"{P}source").alias("s"), F.col(f"{P}bucket").alias("b"), *carried).agg(parts)


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", slice_words: int | None = None, most_slices: int | None = None) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row of a whole text for each read, range-sorted by training position.

    Sizes and keys are written first, without texts; slices of equal length in time follow from their total, and from the
    rows' places the segments: which keys of a bucket an epoch reads in which slice. So a text goes
    straight from the scan to the slices of its reads, in one shuffle, and gets its exact position there. Rows that
    repeat an id and a size follow each other in the slice of the first of them.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sizes = write_table(_sized(narrow, "text", "id", "source").select(f"{P}source", f"{P}bucket", f"{P}key", f"{P}size"), "sizes")
    buckets = write_table(_bucket_sizes(sizes), "buckets")
    total = buckets.agg(F.sum("bucket_size")).first()[0] or 0
    slices = min(most_slices or MOST_SLICES, max(1, -(-total // (slice_words or SLICE_WORDS))))
    segments = write_table(_segments(sizes, _facts(buckets, weights, max_repeats), slices, schedules, max_repeats), "segments")
    if (segments.agg(F.sum(F.size(f"{P}segments"))).first()[0] or 0) <= SENT_SEGMENTS:
        segments = F.broadcast(segments)
    # Rows of size 0 go too and fall out with the others that aren't taken: a filter here would count words a second time.
    rows = _of_bucket(_sized(docs, text_col, id_col, source_col), segments)
    here = F.struct(f"{P}key", f"{P}size")
    mine = F.filter(f"{P}segments", lambda s: s["first"].isNull() | ((s["first"] <= here) & (here <= s["last"])))
    rows = rows.withColumn(f"{P}segment", F.explode(mine)).drop(f"{P}segments")
    rows = rows.withColumns({f"{P}{name}": F.col(f"{P}segment")[name] for name in ("epoch", "slice", "start")}).drop(f"{P}segment")
    rows = rows.repartitionById(slices, F.col(f"{P}slice"))
    place = Window.partitionBy(f"{P}slice", f"{P}source", f"{P}bucket", f"{P}epoch").orderBy(f"{P}key", f"{P}size", text_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{P}at", F.col(f"{P}start") + F.coalesce(F.sum(f"{P}size").over(place), F.lit(0)))
    rows = rows.withColumn(f"{P}read", _read(F.col(f"{P}at"), F.col(f"{P}epoch"), schedules)).where(_whole(F.col(f"{P}read")))
    return rows.sortWithinPartitions(F.col(f"{P}read")["position"], f"{P}id", f"{P}key").select(*docs.columns)
