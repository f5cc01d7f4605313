"""Join of names by similarity, without a list of candidates and without comparing all with all.

Two names match if the ratio of their sorted tokens reaches ``accept``. Then their longest common subsequence has at
least ``accept * (n + m) / 200`` characters, and at least as many character occurrences (the second ``e`` of a name is
another one than the first) are in both. Names are sets of such occurrences, in one order for all names with the rarest
first. Of two sets that share at least s members, the beginnings without the last s - 2 share two: so only names that have a
pair of rare occurrences in common meet, by an equi-join on pairs. The length of a name alone bounds s from below, as a
partner can't be shorter than the ratio allows. Each two names are compared once, at their first common pair, and only if
their lengths and the size of the intersection allow the ratio; it is computed last. Nothing that matches is lost.

Long names would have many pairs; from ``LONG`` characters on single occurrences are the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import fuzzy

LONG = 96
#: Occurrences that are put in order by their frequency; all others are rarer and come before them.
RANKED = 400
_GAP = "\x01"
#: Members that every set has, behind all others, so that also names of one character have pairs. No occurrence is that short.
_COMMON = ("", "-")
_EPS = 1e-9


def occurrences(x: Column) -> Column:
    """The characters of a text, each with its number among the equal ones: ``e1``, ``e2``."""
    chars = F.array_sort(F.filter(F.split(x, ""), lambda c: c != ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 2).cast("string")))


def _names(df: DataFrame, name: str) -> DataFrame:
    rows = df.select(fuzzy.sorted_tokens(F.col(name)).alias("s")).distinct()
    return rows.select("s", F.length("s").alias("n"), occurrences(F.col("s")).alias("members"))


def _least(n: Column, m: Column, accept: float) -> Column:
    """The fewest common characters of names of these lengths that match."""
    return F.ceil((n + m) * (accept / 200) - _EPS).cast("int")


def _keyed(names: DataFrame, ranks: Column | None, accept: float, long: int) -> DataFrame:
    rank = (lambda t: F.coalesce(F.try_element_at(ranks, t), F.lit(0))) if ranks is not None else (lambda t: F.lit(0))
    ordered = F.transform(F.array_sort(F.transform("members", lambda t: F.struct(rank(t).alias("r"), t.alias("t")))), lambda x: x["t"])
    rows = names.select("s", "n", F.concat(ordered, F.array(*map(F.lit, _COMMON))).alias("members"))
    shortest = F.ceil(F.col("n") * (accept / (200 - accept)) - _EPS)
    rows = rows.withColumn("spare", F.col("n") - _least(F.col("n"), shortest, accept))
    begin = lambda k: F.slice("members", F.lit(1), F.col("spare") + k)
    two = F.flatten(F.transform(begin(2), lambda a, i: F.transform(F.slice(begin(2), i + 2, F.greatest(F.col("spare") + 1 - i, F.lit(0))), lambda b: F.concat(a, F.lit(_GAP), b))))
    none = F.array().cast("array<string>")
    keys = F.concat(F.when(F.col("n") <= long, two).otherwise(none), F.when(F.col("n") * ((200 - accept) / accept) > long, begin(1)).otherwise(none))
    return rows.select("s", "n", "members", "spare", F.explode(keys).alias("key"))


def similar_names(left: DataFrame, right: DataFrame, left_on: str, right_on: str, accept: float = 70.0, long: int = LONG) -> DataFrame:
    """``a, b, score``: the distinct names of both sides, as sorted tokens, whose ratio is at least ``accept`` (over 0, at most 100).

    A null name is empty; an empty name matches empty ones only. Names are distinct, so copies cost nothing; join rows
    back by ``fuzzy.sorted_tokens``. ``long`` decides which keys are used, not what is found.
    """
    if not 0 < accept <= 100:
        raise ValueError("accept must be over 0 and at most 100: at 0 all names match")
    a, b = _names(left, left_on), _names(right, right_on)
    counts = a.unionAll(b).select(F.explode("members").alias("t")).groupBy("t").count()
    # A bounded report; it only decides how many candidates there are.
    frequent = [r.t for r in counts.orderBy(F.desc("count"), "t").limit(RANKED).collect()]
    ranks = F.create_map(*[F.lit(v) for k, t in enumerate(reversed(frequent)) for v in (t, k + 1)]) if frequent else None
    l, r = (_keyed(x, ranks, accept, long).alias(n) for x, n in ((a, "l"), (b, "r")))  # noqa: E741
    n, m = F.col("l.n"), F.col("r.n")
    pairs = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.least(n, m) * 200 >= (n + m) * accept - _EPS))
    single = F.greatest(n, m) > long
    k = F.when(single, 1).otherwise(2)
    first = F.array_intersect(F.slice("l.members", F.lit(1), F.col("l.spare") + k), F.slice("r.members", F.lit(1), F.col("r.spare") + k))
    once = F.col("l.key") == F.when(single, F.get(first, F.lit(0))).otherwise(F.concat(F.get(first, F.lit(0)), F.lit(_GAP), F.get(first, F.lit(1))))
    enough = F.size(F.array_intersect("l.members", "r.members")) - len(_COMMON) >= _least(n, m, accept)
    found = pairs.where(once).where(enough).select(F.col("l.s").alias("a"), F.col("r.s").alias("b"))
    return found.withColumn("score", fuzzy.ratio_of(F.col("a"), F.col("b"))).where(F.col("score") >= accept)
