"""Byte-level BPE over a file of ranks, many pre-tokens at a time in padded numpy matrices, and back to bytes.

``load_ranks`` turns the file into three tables: ids of single bytes, the bytes of each id, and a hash table of pairs.
Since an id is the rank of its bytes, the pair (a, b) has the rank of a's bytes followed by b's; every split of
every vocabulary string into two others is entered once (open addressing, linear probing, at most a quarter full).

Texts are cut by the published pattern in batches (``pretokens.cut``). A pre-token that is a vocabulary string is that
one id. The others go by length into buckets of one matrix width, padded by a mark that no pair has. In each round
every row of a matrix merges its leftmost pair of smallest rank; rows without a pair leave, and as all others lose
exactly one place the matrix is compacted to one column less. A pre-token longer than ``WIDEST`` bytes has a vector
of its own, where all places of the smallest rank are merged in one round unless one of the pairs that this makes
has a smaller rank still, when only the leftmost is: so the order of merges is the same, in fewer rounds.

Rows: a null text is empty and has no ids; null ids decode to no bytes; an empty table gives no rows; repeated rows and
null ids of documents are carried; other columns are not looked at. Special strings are ordinary text. Bytes of a text
that is no UTF-8 can't come from a string column. Very long texts and pre-tokens are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pretokens import CERTAIN, ODD_SPACE, WITH_BLANK, Memo, batches, cut

#: Rank of a pair that is no vocabulary string, and the id that pads rows.
NONE = np.int32(2**31 - 1)
#: Widths of matrices; longer pre-tokens go one by one.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64)
WIDEST = WIDTHS[-1]
#: Places of one matrix, and bytes of texts that are cut at a time: a worker's memory, however many texts a batch has.
PLACES, TEXT_BYTES = 1 << 19, 2_000_000
#: Bytes of a generation of remembered pre-tokens in a worker.
MEMO_BYTES = 40 << 20


class PairTable:
    """Ranks of pairs of ids by open addressing: a slot holds ``first << 32 | second`` and the rank."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            self.keys[slots[free]] = keys[free]  # of several at one slot the last stays
            won = free[self.keys[slots[free]] == keys[free]]
            self.ranks[slots[won]] = ranks[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def look_up(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where there is none."""
        keys = (first.astype(np.int64) << 32) | second
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NONE)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.last
            found = self.keys[slots[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.ranks[slots[rest[same]]]
            rest = rest[~same & (found != -1)]
        return out


class ByteBpe:
    """Encodes batches of UTF-8 texts by a vocabulary ``{bytes: rank}``."""

    def __init__(self, ranks: dict[bytes, int], memo: Memo | None = None):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks, self.memo, self.pretokens = ranks, memo or Memo(), regex.compile(WITH_BLANK)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(splits, np.int64).reshape(-1, 2).T
        self.pairs = PairTable(keys, values.astype(np.int32))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, four bytes each."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = np.int32(whole).tobytes()
            elif len(p) > WIDEST:
                out[k] = self._long(p)
            elif p:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(p)), []).append(k)
            else:
                out[k] = b""
        for width, rows in by_width.items():
            step = max(1, PLACES // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], NONE)
        ranks = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(rows):
            # argmin gives the first of equal ranks, which is the leftmost pair.
            place = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), place] if ranks.shape[1] else np.full(len(rows), NONE)
            settled = best == NONE
            for row, left in zip(rows[settled].tolist(), ids[settled], strict=True):
                out[row] = left[: sizes[row]].tobytes()
            keep = ~settled
            rows, ids, ranks, place, best = rows[keep], ids[keep], ranks[keep], place[keep], best[keep]
            if not len(rows):
                break
            n, w = ids.shape
            line = np.arange(n)
            ids[line, place] = best
            stay = np.ones((n, w), bool)
            stay[line, place + 1] = False
            ids = ids[stay].reshape(n, w - 1)
            # The merged pair's own rank goes; those to its left and right are of new pairs.
            stay = np.ones((n, w - 1), bool)
            stay[line, place] = False
            ranks = ranks[stay].reshape(n, w - 2)
            sizes[rows] -= 1
            left = np.flatnonzero(place > 0)
            ranks[left, place[left] - 1] = self.pairs.look_up(ids[left, place[left] - 1], best[left])
            right = np.flatnonzero(place < w - 2)
            ranks[right, place[right]] = self.pairs.look_up(best[right], ids[right, place[right] + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.look_up(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            places = np.flatnonzero(ranks == best)
            # Of overlapping places (as in a run of one byte) every second one, from the left.
            begins = np.concatenate([[True], np.diff(places) > 1])
            offset = np.arange(len(places)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            places = places[offset % 2 == 0]
            merged = np.delete(np.where(np.isin(np.arange(len(ids)), places), best, ids), places + 1)
            now = places - np.arange(len(places))
            before = self.pairs.look_up(merged[np.maximum(now - 1, 0)], np.full(len(now), best))[now > 0]
            after = self.pairs.look_up(np.full(len(places), best), ids[np.minimum(places + 2, len(ids) - 1)])[places + 2 < len(ids)]
            if len(places) > 1 and min(before.min(initial=NONE), after.min(initial=NONE)) < best:
                merged = np.delete(ids, places[0] + 1)
                merged[places[0]] = best
                now = places[:1]
            ranks = np.delete(ranks, now + np.arange(len(now)))
            for at in (now - 1, now):
                at = at[(at >= 0) & (at < len(ranks))]
                ranks[at] = self.pairs.look_up(merged[at], merged[at + 1])
            ids = merged
        return ids.tobytes()

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of ``cut``: those that aren't one pre-token for certain are cut by the pattern itself."""
        parts = [[p] if CERTAIN(p) else self.split(p) for p in pieces]
        ids = iter(self.merge(list(chain.from_iterable(parts))))
        return [next(ids) if len(p) == 1 else b"".join(next(ids) for _ in p) for p in parts]

    def split(self, text: bytes) -> list[bytes]:
        return [p.encode() for p in self.pretokens.findall(text.decode("utf-8", "replace"))]

    def encode(self, texts: list[bytes]) -> pa.ListArray:
        """The ids of each whole text."""
        odd = [k for k, t in enumerate(texts) if ODD_SPACE(t)]
        plain = texts if not odd else [b"" if ODD_SPACE(t) else t for t in texts]
        pieces, bounds = cut(plain, with_blank=True)
        coded = pieces.dictionary_encode()
        which, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if odd:  # white space that ``cut`` doesn't know: the pattern cuts the whole text
            places = {p: j for j, p in enumerate(keys)}
            runs = np.split(which, bounds[1:-1])
            for k in odd:
                runs[k] = np.array([places.setdefault(p, len(places)) for p in self.split(texts[k])], which.dtype)
            which, keys = np.concatenate(runs), list(places)
            bounds = np.cumsum([0, *map(len, runs)])
        values = self.memo.look_up(keys, self._pieces)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        flat = np.frombuffer(b"".join(values), np.int32)
        begins, counts = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(begins[which] - ends[:-1], counts) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids, pa.int32()))


class Decoder:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            by_id[r] = t
        self.strings = pa.array(by_id, pa.binary())
        self.known = np.array([bool(t) for t in by_id])

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids, one after the other; ``ValueError`` for an id that the vocabulary lacks."""
        flat = ids.flatten()
        plain = flat.to_numpy(zero_copy_only=False)
        if len(plain) and (flat.null_count or plain.min() < 0 or plain.max() >= len(self.known) or not self.known[plain].all()):
            raise ValueError("ids outside the vocabulary")
        strings = self.strings.take(flat)
        edges = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
        at = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4) if len(strings) else np.zeros(1, np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(at[edges])), strings.buffers()[2]])


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: on each line the bytes in base 64 and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    """One coder for each file in a worker process, kept across its tasks."""
    return ByteBpe(load_ranks(path), Memo(MEMO_BYTES))


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int) for every row of ``docs``; the scan's partitions, no shuffle.

    ``path`` is a file of ranks at the same place on every machine; it cuts texts by ``pretokens.WITH_BLANK``.
    ``decoded``: also the bytes that the ids decode to, in the same worker, as ``decode_ids`` gives them.
    """
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts, TEXT_BYTES):
                ids = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, *([decoder(path).decode(ids)] if decoded else [])], names=names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` (binary) for rows as ``encode_texts`` gives them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(batch.column(1))], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
