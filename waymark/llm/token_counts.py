"""Token counts with a whole-token shortcut.

Before counting, on the driver, every vocabulary string is put through the file's own BPE model: those that come
back as one token are proven to be one token wherever they stand as a pre-token. The proof is bounded by the
vocabulary and is broadcast. A pre-token of that set counts 1 without any merging; only the rest is merged, by the
model itself, and remembered. Texts are cut into pre-tokens in batches and each distinct one is looked up once.

Rows: null text counts as empty (0 bytes, 0 tokens); an empty table gives no rows; repeated rows stay; extra
columns are not looked at; a null ``doc_id`` is carried. Special strings inside a text are one token each, as
the library takes them by default. A very long text is counted whole, in a batch of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pretokens import CERTAIN, ODD_SPACE, WITH_BLANK, Memo, Merger, batches, byte_alphabet, cut, keeps_blank, whole_ids
from waymark.llm.wordids import load


@lru_cache(maxsize=4)
def prove_whole_tokens(path: str) -> frozenset[bytes]:
    """Vocabulary strings, as UTF-8, that are one pre-token and that the model encodes as exactly one token."""
    tokenizer, back = load(path), {c: b for b, c in byte_alphabet().items()}
    pretokens, tokenize, proven = regex.compile(WITH_BLANK), tokenizer.model.tokenize, set()
    for entry in tokenizer.get_vocab(with_added_tokens=False) if keeps_blank(path) else ():
        try:
            raw = bytes(back[c] for c in entry)
            text = raw.decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if pretokens.findall(text) == [text] and len(tokenize(entry)) == 1:
            proven.add(raw)
    return frozenset(proven)


class TokenCounter:
    """Counts the tokens of batches of UTF-8 texts."""

    def __init__(self, path: str, whole: frozenset[bytes], memo: Memo | None = None):
        self.tokenizer, self.whole, self.memo = load(path), whole, memo or Memo()
        self.by_piece, self.merge = keeps_blank(path), Merger(self.tokenizer, CERTAIN)
        specials = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials, self.special = specials, re.compile(b"|".join(map(re.escape, specials)))

    def _merged(self, pieces: list[bytes]) -> list[int]:
        return list(map(len, self.merge(pieces)))

    def _whole(self, texts: list[bytes]) -> list[int]:
        return list(map(len, whole_ids(self.tokenizer, texts)))

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.by_piece:
            return self._whole(texts)
        extra, owner, parts, odd = np.zeros(len(texts), np.int64), [], [], []
        for k, t in enumerate(texts):
            if ODD_SPACE(t):
                odd.append(k)
                continue
            # A special string is one token; what lies between is counted apart, as the library does.
            between = self.special.split(t) if self.specials and any(s in t for s in self.specials) else [t]
            extra[k] = len(between) - 1
            owner += [k] * len(between)
            parts += between
        pieces, bounds = cut(parts, with_blank=True)
        coded = pieces.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        counts = np.ones(len(keys), np.int64)
        rest = [j for j, p in enumerate(keys) if p not in self.whole]
        counts[rest] = self.memo.look_up([keys[j] for j in rest], self._merged)
        ends = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy()])])[bounds]
        np.add.at(extra, owner, np.diff(ends))
        if odd:
            extra[odd] = self._whole([texts[k] for k in odd])
        return extra.tolist()


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; the scan's partitions, no shuffle.

    ``path`` is a byte-level BPE file that the tokenizers library reads, at the same place on every machine.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, shared.value)
        for batch in it:
            texts = batch.column(1).to_pylist()
            counts = [n for a, b in batches(texts) for n in counter.count(texts[a:b])]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
