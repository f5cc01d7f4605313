"""Changes of tables as new tables: updates, upserts, inserts, cascades, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def update_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A keyed update whose value is a function of the row."""
    return add_column(df, name).withColumn(name, value)


def add_column(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def update_matched(df: DataFrame, matches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of matched rows taken from ``matches`` (unique by ``key``); a null there overwrites."""
    new = matches.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = df.join(new, key, "left")
    return rows.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """One row a key, the one with the largest version; combined before the shuffle."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r"))
    return latest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*both.columns)


def refresh(old: DataFrame, news: DataFrame, key: str, now: Column, limit: int | None = None, stamp: str = "last_updated") -> DataFrame:
    """``old`` with the rows of ``news`` (unique by ``key``) in place of its own, stamped ``now``; new keys are added.

    ``limit``: only the news of so many keys, the smallest ones, as a run that must stay short.
    """
    if limit is not None:
        news = news.orderBy(key).limit(limit)
    both = old.withColumn("_new", F.lit(0)).unionByName(news.withColumns({stamp: now, "_new": F.lit(1)}), allowMissingColumns=True)
    return upsert_latest(both.limit(0), both, key, ["_new"]).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, of one key the smallest by its other columns; null keys count as equal."""
    same, rest = None, [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.distinct()
    fresh = one.select(*new.columns).alias("n")
    known = old.select(*key).distinct().alias("o")
    for k in key:
        one = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        same = one if same is None else same & one
    return old.unionByName(fresh.join(known, same, "left_anti"))


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent survives, and those without one (a null key refers to nothing)."""
    kept = child.alias("c").join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_semi")
    return kept.unionByName(child.where(F.col(child_key).isNull()))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a table at ``path``: Spark marks a folder when all of its files are there."""
    jvm, root = spark._jvm, path.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


class ConcurrentWrite(RuntimeError):
    """Another writer has the next version of a table, or has finished it."""


def _store(spark: SparkSession, path: str):
    """The file system of a path, and how to name files of it."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark._jsc.hadoopConfiguration()), name


def write_version(df: DataFrame, path: str, base: int | None = None) -> int:
    """Write ``df``, which may read the table itself, as the version after ``base``; until that is whole readers get the one before.

    ``base``: the version that ``df`` was made from (-1: there was none); by default the last one. The next number is claimed by a file that
    only one writer can create, so of two writers with one base the second gets ``ConcurrentWrite``, as does a writer
    whose base is no longer the last version: no change gets lost. If the write fails its files and claim go, and the error is
    raised. The claim of a writer that died stays until ``release`` takes it.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    last = max(versions(spark, root), default=-1)
    base = last if base is None else base
    if base != last:
        raise ConcurrentWrite(f"made from version {base}, but {root} is at version {last}")
    store, name = _store(spark, root)
    claim, target = name(f"{root}/_claims/v{base + 1}"), f"{root}/v{base + 1}"
    if not store.createNewFile(claim):
        raise ConcurrentWrite(f"version {base + 1} of {root} has a writer")
    try:
        df.write.mode("overwrite").parquet(target)
    except BaseException:
        store.delete(name(target), True)
        store.delete(claim, False)
        raise
    return base + 1


def release(spark: SparkSession, path: str) -> list[int]:
    """Take back the claims of versions that were never finished, and their files; only when no writer is at work."""
    root = path.rstrip("/")
    store, name = _store(spark, root)
    claimed = {int(f.getPath().getName()[1:]) for f in store.globStatus(name(f"{root}/_claims/v*")) or []}
    dead = sorted(claimed - set(versions(spark, root)))
    for v in dead:
        store.delete(name(f"{root}/v{v}"), True)
        store.delete(name(f"{root}/_claims/v{v}"), False)
    return dead


def whole_entities(rows: DataFrame, key: str, fault: Column) -> tuple[DataFrame, DataFrame]:
    """An entity's rows are taken together or not at all: ``(rows of entities without fault, key and faults of the others)``.

    ``fault``: a text for a row that can't be taken, null for one that can. Rows without a key belong to no entity and
    are refused one by one. Keys with a fault are the short side of a join, and are combined before the shuffle.
    """
    marked = rows.withColumn("_fault", F.when(F.col(key).isNull(), F.coalesce(fault, F.lit("no key"))).otherwise(fault))
    bad = marked.where("_fault is not null").groupBy(key).agg(F.sort_array(F.collect_set("_fault")).alias("faults"), F.count("*").alias("n_faults"))
    good = rows.where(F.col(key).isNotNull()).join(bad.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return good, bad


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The last finished version of a table; ``LookupError`` if there is none."""
    found = versions(spark, path)
    if not found:
        raise LookupError(f"no finished version under {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/v{found[-1]}")


def write_csv(df: DataFrame, path: str, slug: str, order: list[str] | None = None) -> DataFrame:
    """The rows of one slug as CSV with a header under ``path/slug``, replacing what is there; returns what was read back.

    The leading column without a name numbers the rows in ``order`` (of all columns), from 0. ``OSError`` if what was
    written holds another number of rows. A park's file is small, as its list of places is; it is one partition.
    """
    target, columns = f"{path.rstrip('/')}/{slug}", order or df.columns
    numbered = df.withColumn("_c0", F.row_number().over(Window.orderBy(*columns)) - 1).select("_c0", *df.columns).orderBy("_c0")
    head = [" ", *df.columns]
    numbered.toDF(*head).write.mode("overwrite").option("header", True).option("escape", '"').csv(target)
    back = df.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True).csv(target)
    if back.count() != df.count():
        raise OSError(f"rows are missing in {target}")
    return back.toDF("_c0", *df.columns)


def write_csvs(df: DataFrame, path: str, slug_col: str, order: list[str]) -> DataFrame:
    """``write_csv`` of all slugs in one job: a folder ``<slug_col>=<slug>`` with one file for each; returns what was read back.

    Rows are numbered from 0 in ``order`` within their slug. Rows without a slug go to no file and are refused
    (``ValueError``), as is a slug whose file holds another number of rows (``OSError``): both name at most ten.
    """
    if not df.where(F.col(slug_col).isNull()).isEmpty():
        raise ValueError(f"rows without {slug_col}")
    rest = [c for c in df.columns if c != slug_col]
    numbered = df.withColumn("_c0", F.row_number().over(Window.partitionBy(slug_col).orderBy(*order)) - 1)
    head = numbered.select(slug_col, F.col("_c0").alias(" "), *rest)
    # Numbering has brought each slug's rows together, in order, so each folder gets one file.
    head.write.mode("overwrite").partitionBy(slug_col).option("header", True).option("escape", '"').csv(path)
    schema = ", ".join(["` ` string", *(f"`{c}` string" for c in rest), f"`{slug_col}` string"])
    back = df.sparkSession.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    counts = [x.groupBy(F.col(slug_col).cast("string").alias("slug")).agg(F.count("*").alias(n)) for x, n in ((df, "n"), (back, "m"))]
    wrong = counts[0].join(counts[1], "slug", "full").where(~F.col("n").eqNullSafe(F.col("m"))).limit(10).collect()
    if wrong:
        raise OSError(f"rows are missing in {path}: {[r.slug for r in wrong]}")
    return back.withColumnRenamed(" ", "_c0").select("_c0", *df.columns)


#: Columns of the scraped files and of the table they go to; None: not in the files (fixed values).
CSV_COLUMNS = {
    "name": "site_name",
    "latitude": "latitude",
    "longitude": "longitude",
    "address": "directions",
    "managing_unit": "info_center",
    "reservation_type": None,
    "fs_usda_url": "park_url",
    "reservation_url": None,
    "contact_name": "info_center",
    "contact_phone": "contact_info",
    "seasons_of_use": "season_of_use",
    "num_sites": None,
    "fee": "fee_info",
    "overview": "overview",
}
CSV_AMENITIES = {"restrooms": "restrooms", "water": "water", "amenities": "amenities", "body_of_water": "body_of_water"}


def from_csv(df: DataFrame, columns: dict[str, str | None] = CSV_COLUMNS) -> DataFrame:
    return df.select(*[(F.lit(None).cast("string") if old is None else F.col(old)).alias(new) for new, old in columns.items()])
