"""Language identification by compression.

For each learned language a zstandard raw-content dictionary holds some of its labelled texts. A text is
reduced to lower-case letter runs, cut into chunks of 1 KiB (all of them; small chunks keep the dictionary and
not the text's own past in charge) and compressed with every dictionary; the language with the smallest sum
wins, ties going to the language with more labelled documents. ``margin`` is how much larger the second
smallest is, as a share of the smallest; below ``MIN_MARGIN`` the answer is rejected.

Rows: a null text or one without a letter gives ``und``, score 0, margin 0, rejected; so does every text where
nothing was learned (empty table, or no labelled row); repeated rows stay; a null ``doc_id`` is carried; a very long text is
compressed whole, chunk by chunk; rows with a null language are not learned from; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the fit for a language: labelled documents drawn, and bytes of the dictionary. Documents of at most
#: ``DOC_BYTES`` come first, so that a dictionary holds many of them.
SAMPLE_DOCS, DICTIONARY_BYTES, DOC_BYTES = 300, 120_000, 4_000
LEVEL = 6
CHUNK_BYTES = 1024
MIN_MARGIN = 0.002
#: How fast the score falls with a rival's relative size.
SHARPNESS = 40.0
NO_LETTERS = re.compile(r"[\W\d_]+")
SALT = 4


def letters(text: str) -> bytes:
    """What is compressed: lower-case runs of letters, one blank between them."""
    return NO_LETTERS.sub(" ", text.lower()).strip().encode()


def fit_languages(
    docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, doc_bytes: int = DOC_BYTES
) -> dict[str, tuple[int, bytes]]:
    """``language: (labelled documents, dictionary)`` from the rows where ``learn`` holds.

    The counts cover all labelled rows. A dictionary holds whole texts, of the documents with the smallest hashes of
    id and text, those of up to ``doc_bytes`` first, as long as they fit into ``dictionary_bytes`` (the first always
    does). The driver gets no more than these texts.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(learn & F.col(lang_col).isNotNull() & text.isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # A hash below its language's threshold: about one and a half times the sample, cut to size afterwards.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * sample_docs / n))])
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(SALT)), F.lit(1 << 30))
    # Rows that repeat id and text become one in the scan's tasks.
    picked = rows.where(order < share[F.col(lang_col)] * F.lit(1 << 30)).select(F.col(lang_col).alias("lang"), order.alias("o"), text.alias("s")).distinct()
    in_order = Window.partitionBy("lang").orderBy(F.octet_length("s") > doc_bytes, "o", "s")
    picked = picked.withColumns({"r": F.row_number().over(in_order), "bytes": F.sum(F.octet_length("s") + 1).over(in_order)})
    held = picked.where((F.col("r") <= sample_docs) & ((F.col("bytes") <= dictionary_bytes) | (F.col("r") == 1))).select("lang", "r", "s").collect()
    texts: dict[str, list] = {lang: [] for lang in counts}
    for r in sorted(held, key=lambda r: r["r"]):
        texts[r["lang"]].append(letters(r["s"]))
    return {lang: (n, b" ".join(texts[lang])) for lang, n in sorted(counts.items())}


class Classifier:
    def __init__(self, model: dict[str, tuple[int, bytes]]):
        import zstandard as z

        self.langs = sorted(model, key=lambda k: (-model[k][0], k))
        self.compressors = []
        for lang in self.langs:
            content = model[lang][1] or b" "
            args = {"source_size": CHUNK_BYTES, "dict_size": len(content), "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            params = z.ZstdCompressionParameters.from_level(LEVEL, **args)
            self.compressors.append(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params))

    def __call__(self, text: str) -> tuple[str, float, float]:
        body = letters(text)
        parts = [body[k : k + CHUNK_BYTES] for k in range(0, len(body), CHUNK_BYTES)] or [b""]
        sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], float)
        ratio = sizes / sizes.min() - 1
        best = int(np.argmin(sizes))
        margin = float(np.partition(ratio, 1)[1]) if len(sizes) > 1 else 1.0
        return self.langs[best], float(1 / np.exp(-SHARPNESS * ratio).sum()), margin


def classify(docs: DataFrame, model: dict[str, tuple[int, bytes]], min_margin: float = MIN_MARGIN, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred, lang_score, lang_margin, lang_rejected`` for every row; no shuffle.

    ``keep`` names the columns of ``docs`` to carry (all); those of the added names are replaced. The dictionaries (bounded, about 120 KB each) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "lang_score", "lang_margin", "lang_rejected"]
    carried = docs.select(*(c for c in (docs.columns if keep is None else keep) if c not in added))
    schema = T.StructType([*carried.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])
    names = [f.name for f in schema.fields]
    readable = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Classifier(shared.value) if shared.value else None
        for batch in it:
            texts = batch.column(batch.num_columns - 2).to_pylist()
            reads = batch.column(batch.num_columns - 1).to_pylist()
            rows = [label(t) if ok and label else ("und", 0.0, 0.0) for t, ok in zip(texts, reads, strict=True)]
            cols = [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[0] == "und" or r[2] < min_margin for r in rows], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *cols], names=names)

    rows = docs.select(*carried.columns, F.col(text_col).cast("string").alias("_lang_text"), readable.alias("_lang_readable"))
    return rows.mapInArrow(run, schema)
