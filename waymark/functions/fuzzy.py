"""String similarity, 0 to 100, as native columns where one side is a constant.

The longest common subsequence runs bit-parallel: a character is the mask of its places in the constant, the
state is one integer, and a step is ``(v + (v & m)) | (v - (v & m))``; zero bits at the end are matches. So a
comparison is an ``aggregate`` over an array of longs, and windows of the constant are shifts of the masks.
Constants over 62 characters, and pairs of columns, go through a vectorised Python function instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 62


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else (1 - (n - 2 * lcs(a, b)) / n) * 100


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length, a shorter beginning or a shorter end."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    s, long = sorted((a, b), key=len)

    def best(s: str, long: str) -> float:
        windows = (long[max(i, 0) : i + len(s)] for i in range(1 - len(s), len(long)))
        return max(ratio(s, w) for w in windows)

    out = best(s, long)
    return max(out, best(long, s)) if len(a) == len(b) else out


def sorted_tokens(x: Column) -> Column:
    """Tokens between white space, sorted, joined by a blank."""
    tokens = F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def _vectorised(score, *args) -> Column:
    """Pairs are scored once in each Arrow batch."""

    def run(*columns: pd.Series) -> pd.Series:
        frame = pd.concat([c.reset_index(drop=True) for c in columns], axis=1)
        keys = pd.Series(list(frame.itertuples(index=False, name=None)))
        known = {k: score(*(x or "" for x in k)) for k in keys.unique()}
        return keys.map(known).astype(float)

    @F.pandas_udf("double")
    def one(a: pd.Series) -> pd.Series:
        return run(a)

    @F.pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return (one if len(args) == 1 else two)(*args)


def _masks(x: Column, q: str) -> Column:
    """Each character of ``x`` as the mask of its places in ``q``."""
    places: dict[str, int] = {}
    for k, c in enumerate(q):
        places[c] = places.get(c, 0) | 1 << k
    table = F.create_map(*[F.lit(v) for c, m in places.items() for v in (c, m)])
    chars = F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)).cast("long"))


def _matches(masks: Column, size: Column, shift: Column | None = None) -> Column:
    """Common subsequence of the texts behind ``masks`` with ``size`` places of the constant from ``shift`` on."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size.cast("int")) - 1

    def step(v: Column, m: Column) -> Column:
        if shift is not None:
            m = F.call_function("shiftright", m, shift.cast("int"))
        u = v.bitwiseAND(m)
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(masks, full, step))


def _share(matches: Column, a: Column, b: Column) -> Column:
    n = a + b
    return F.when(n == 0, F.lit(100.0)).otherwise((1 - (n - 2 * matches) / n) * 100)


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, also where lambdas below use it many times."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def ratio_to(x: Column, q: str) -> Column:
    """``ratio`` of a column with a constant."""
    if len(q) > LONGEST:
        return _vectorised(lambda a: ratio(a, q), x)
    if not q:
        return F.when(F.length(x) == 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return _share(_matches(_masks(x, q), F.lit(len(q))), F.lit(len(q)), F.length(x))


def partial_to(x: Column, q: str) -> Column:
    """``partial`` of a column with a constant."""
    if len(q) > LONGEST:
        return _vectorised(lambda a: partial(a, q), x)
    if not q:
        return F.when(F.length(x) == 0, F.lit(100.0)).otherwise(F.lit(0.0))
    k = len(q)

    def windows(short: Column, long: Column, score) -> Column:
        """The best score over windows [max(i, 0), min(i + short, long)) of the longer side."""

        def one(i: Column) -> Column:
            start = F.greatest(i, F.lit(0))
            return score(start, F.least(i + short, long) - start)

        return F.array_max(F.transform(F.sequence(1 - short, long - 1), one))

    def best(masks: Column) -> Column:
        n = F.size(masks)
        of_column = windows(F.lit(k), n, lambda start, size: _share(_matches(F.slice(masks, start + 1, size), F.lit(k)), F.lit(k), size))
        of_constant = windows(n, F.lit(k), lambda start, size: _share(_matches(masks, size, start), size, n))
        return F.when(n == 0, F.lit(0.0)).when(n > k, of_column).when(n < k, of_constant).otherwise(F.greatest(of_column, of_constant))

    return _once(_masks(x, q), best)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Ratio of the sorted tokens of two columns."""
    return _vectorised(ratio, sorted_tokens(a), sorted_tokens(b))


def ratio_of(a: Column, b: Column) -> Column:
    """``ratio`` of two columns."""
    return _vectorised(ratio, a, b)
