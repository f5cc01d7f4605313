"""The fixed split of documents into rows to learn from and rows held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4. A null id has no text and is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
