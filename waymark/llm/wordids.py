"""Whole-text token ids from a tokenizers file, each distinct pre-token of a batch encoded once.

Texts of a batch are cut into pre-tokens together, dictionary-encoded in Arrow, and the ids of the distinct ones are
gathered to their places in numpy; only pre-tokens that no earlier batch had go to the library. That is for files
that cut as ``pretokens.drops_space`` says; with other files, and for texts that hold a special string, the library
gets whole texts.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np

from waymark.llm.pretokens import CERTAIN_LOWER, Memo, Merger, cut, drops_space, whole_ids


def load(path: str):
    """The tokenizer of a file. Spark's tasks are the parallelism, so the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Encodes batches of UTF-8 texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, memo: Memo | None = None):
        self.tokenizer, self.memo = load(path), memo or Memo()
        self.by_piece, self.merge = drops_space(path), Merger(self.tokenizer, CERTAIN_LOWER)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in whole_ids(self.tokenizer, texts)]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in self.merge(pieces)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each whole text, as bytes."""
        if not self.by_piece:
            return self.whole(texts)
        # ASCII capitals only: the file lower-cases anyway, but a capitalised special string is no special token
        low = [t.lower() for t in texts]
        odd = [k for k, t in enumerate(low) if b"<|" in t or any(s in t for s in self.special)]
        for k in odd:
            low[k] = b""
        pieces, bounds = cut(low, with_blank=False)
        coded = pieces.dictionary_encode()
        values = self.memo.look_up(coded.dictionary.to_pylist(), self._merged)
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begins[which] - ends[:-1], counts) + np.arange(ends[-1])]
        at = ends[bounds].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        if odd:
            for k, v in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
                out[k] = v
        return out


@lru_cache(maxsize=2)
def encoder(path: str, memo_bytes: int = 80 << 20) -> WordIds:
    """One encoder for each file in a worker process, kept across its tasks; it remembers twice ``memo_bytes`` of pre-tokens."""
    return WordIds(path, Memo(memo_bytes))
