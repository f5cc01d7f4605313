"""Pages from SQL text: a table function over any table that has an HTML column.

After ``register(spark)``:

    SELECT * FROM page_links(TABLE(SELECT page_id, html FROM pages) PARTITION BY (page_id), 'html')

The rows keep the type of the partition columns, whatever they are; Spark deals the pages by them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from waymark.sources.pages import HREF, S0, S1, Outline


class PageLinks:
    """``pos, href, label`` of every link with an address, behind the columns of the page's row but the HTML."""

    @staticmethod
    def analyze(table: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or html.value not in table.dataType.names:
            raise ValueError("page_links takes a table and the name of its HTML column")
        kept = [f for f in table.dataType.fields if f.name != html.value]
        if clash := {f.name for f in kept} & {"pos", "href", "label"}:
            raise ValueError(f"columns of the result are in the table: {sorted(clash)}")
        return AnalyzeResult(StructType(kept).add("pos", IntegerType()).add("href", StringType()).add("label", StringType()))

    def eval(self, row: Row, html: str) -> Iterator[tuple]:
        page = Outline(frozenset(["a"]))
        page.feed(row[html] or "")
        page.close()
        own, links = tuple(row[c] for c in row.__fields__ if c != html), [e for e in page.elements if e[HREF] is not None]
        for pos, e in enumerate(links):
            yield (*own, pos, e[HREF], "".join(s.strip() for s in page.strings[e[S0] : e[S1]]))


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("page_links", udtf(PageLinks))
