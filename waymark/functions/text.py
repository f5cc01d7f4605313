"""Native string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, with the four separators that Unicode leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize(x: Column) -> Column:
    """Lower case without any white space; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), SPACE, "")


def strip(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def normalize_name(x: Column, suffix: str = " campground") -> Column:
    """Lower case, stripped; a name that ends in the suffix loses it everywhere."""
    s = strip(F.lower(F.coalesce(x, F.lit(""))))
    return F.when(F.endswith(s, F.lit(suffix)), F.replace(s, F.lit(suffix), F.lit(""))).otherwise(s)


def strip_html(x: Column) -> Column:
    """Text without tags, stripped; null and empty give null."""
    return F.when(F.length(x) > 0, strip(F.regexp_replace(x, "<[^>]+>", "")))


def url_tail(x: Column) -> Column:
    """The last path segment after closing slashes are gone."""
    return F.element_at(F.split(F.regexp_replace(x, "/+$", ""), "/"), -1)


def like_pattern(needle: str) -> str:
    """A contains-pattern in which ``%`` and ``_`` of the needle stay wildcards and a backslash escapes what follows it."""
    body, out, k = needle.strip().lower(), [], 0
    while k < len(body):
        if body[k] == "\\":
            k += 1
            after = body[k] if k < len(body) else "\\"
            out.append("\\" + after if after in "%_\\" else after)
        else:
            out.append(body[k])
        k += 1
    return f"%{''.join(out)}%"


def without_label(x: Column, label: str) -> Column:
    return strip(F.replace(x, F.lit(label), F.lit("")))


def bullet_list(items: Column) -> Column:
    """``- item`` lines, each ended; empty for an empty list."""
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), "")


def query_string(pairs: dict[str, Column]) -> Column:
    """``a=1&b=2`` of the pairs whose value is neither null nor empty, values escaped."""
    return F.concat_ws("&", *[F.when(F.length(v) > 0, F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in pairs.items()])
