"""Packing documents into training windows by the sum-of-squares rule.

Each task keeps an array ``level[f]``: how many open windows are filled up to ``f`` tokens. A piece of ``s``
tokens goes to the fill level that makes the sum of squared counts smallest (a new window is level 0; full
windows leave the array), so no fill level piles up and windows tend to close exactly full. Documents longer
than a window give full windows first; only their rest is placed.

Windows that are still open at the end of a task, or when ``MAX_OPEN`` of them are, are made whole: pieces
of the emptiest windows are cut to fill the fullest. The last one is split by powers of two, which need no padding.
So only documents at these seams are cut, and no task holds more than ``MAX_OPEN`` open windows.

Rows: a null text is an empty one (the end id alone); a null ``doc_id`` is carried; repeated rows are packed
each; a very long text is cut into full windows, however many; an empty table gives no pieces; other columns are not
looked at. Two runs over the same files with the same settings give the same pieces. Sequence ids are the task's number
times 2^36 plus a counter, so a task that runs again gives the same ones. With ``stored_order`` a task's number
tells nothing about the order of its rows (scans deal splits by size), so every split of a file is packed on its own
and its ids begin with the place of the split in the list of all (path, start), which a scan of no columns makes first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pretokens import batches
from waymark.llm.wordids import encoder

MAX_OPEN = 4096
#: With ``stored_order``: bits of the counter within a split, and of the split's place above them; more is an error.
COUNTER_BITS, PLACE_BITS = 38, 24


class Packer:
    """Sum-of-squares packing of byte strings of 32-bit ids. ``done`` gets (key, start, ids, total, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int, max_open: int = MAX_OPEN, most: int = 1 << 36):
        self.window, self.next, self.max_open, self.last = window, first_sequence, max_open, first_sequence + most
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # by fill; each window a list of pieces
        self.n_open, self.done = 0, []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.done.append((key, start, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1
        if self.next > self.last:
            raise ValueError("more sequences than ids in one split")

    def add(self, key, ids: bytes) -> None:
        total, w = len(ids) // 4, 4 * self.window
        full = len(ids) // w * w
        for a in range(0, full, w):
            self._emit([(key, a // 4, ids[a : a + w], total)])
        if full < len(ids):
            self._place((key, full // 4, ids[full:], total), total - full // 4)

    def _place(self, piece: tuple, size: int) -> None:
        fill = self.window - size  # the fullest level that takes it
        gain = 2 * self.level[size : self.window + 1] + 1  # of the level it makes: the square grows by 2 n + 1
        gain[-1] = 0  # a full window leaves the array
        gain[1:] -= 2 * self.level[1 : fill + 1] - 1
        gain[1:][self.level[1 : fill + 1] == 0] = np.iinfo(np.int64).max
        best = int(fill - np.argmin(gain[::-1]))  # the fullest of equals
        if best:
            pieces = self.open[best].pop()
            self.level[best] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if best + size == self.window:
            self._emit(pieces)
            return
        self.open[best + size].append(pieces)
        self.level[best + size] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            self.settle(last=False)

    def settle(self, last: bool = True) -> None:
        """Fill up open windows, fullest first, from the emptiest; ``last``: split the one that is left as well."""
        windows = [w for fill in range(self.window, 0, -1) for w in self.open[fill]]
        sizes = [fill for fill in range(self.window, 0, -1) for _ in self.open[fill]]
        self.level[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        lo, hi = 0, len(windows) - 1
        while lo < hi:
            room = self.window - sizes[lo]
            key, start, ids, total = windows[hi].pop()
            n = len(ids) // 4
            take = min(room, n)
            if take < n:  # its end fills the gap, its beginning stays
                windows[hi].append((key, start, ids[: 4 * (n - take)], total))
                start, ids = start + n - take, ids[4 * (n - take) :]
            windows[lo].append((key, start, ids, total))
            sizes[lo] += take
            sizes[hi] -= take
            if sizes[lo] == self.window:
                self._emit(windows[lo])
                lo += 1
            if not sizes[hi]:
                hi -= 1
        if lo == hi and not last:
            self.open[sizes[lo]].append(windows[lo])
            self.level[sizes[lo]] += 1
            self.n_open = 1
        elif lo == hi:
            self._powers(windows[lo], sizes[lo])

    def _powers(self, pieces: list[tuple], size: int) -> None:
        rest = list(pieces)
        for bit in range(size.bit_length() - 1, -1, -1):
            if not size >> bit & 1:
                continue
            room, into = 1 << bit, []
            while room:
                key, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // 4)
                into.append((key, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (key, start + n, ids[4 * n :], total))
                room -= n
            self._emit(into)


def is_stored(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files as read, so that rows have a file and a place in it."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _split_order(docs: DataFrame) -> dict[tuple[str, int], int]:
    """The place of each split, by path (numbers in it as numbers) and first byte. One entry a split, whatever its rows."""
    splits = docs.select("_metadata.file_path", "_metadata.file_block_start").distinct().collect()
    by_number = lambda x: ([(1, int(n), "") if n.isdigit() else (0, 0, n) for n in re.split(r"(\d+)", x[0])], x[1])
    if len(splits) >> PLACE_BITS:
        raise ValueError(f"{len(splits)} splits are more than {1 << PLACE_BITS}: read the table in larger ones")
    return {s: k for k, s in enumerate(sorted(map(tuple, splits), key=by_number))}


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True, max_open: int = MAX_OPEN, text_col: str = "text", id_col: str = "doc_id", stored_order: bool = False, memo_bytes: int = 80 << 20) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and the ids.

    ``ids`` (little-endian unsigned 32-bit) is null without ``with_ids``. Every task packs the documents of
    its own input split, so nothing is shuffled and no source, however large, meets in one task.
    ``stored_order``: ``docs`` is a stored table, and sequence ids follow the order of its part files.
    ``max_open`` bounds a task's memory: with fewer open windows more documents are cut at their seams.
    ``memo_bytes``: what a worker remembers of pre-tokens, twice; less takes more time.
    """
    place = docs.sparkSession.sparkContext.broadcast(_split_order(docs)) if stored_order else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, split = encoder(path, memo_bytes), Packer(window, TaskContext.get().partitionId() << 36, max_open), None
        tail = np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            cols = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
                pa.array([r[5] for r in rows], pa.int64()),
                pa.array([r[2] if with_ids else None for r in rows], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        def by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple | None, pa.RecordBatch]]:
            if not stored_order:
                yield None, batch
                return
            keys, a = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a]:
                    yield keys[a], batch.slice(a, b - a)
                    a = b

        for key, batch in (x for whole in it for x in by_split(whole)):
            if key != split:
                packer.settle()
                if packer.done:
                    yield flush()
                split = key
                packer = Packer(window, place.value[key] << COUNTER_BITS, max_open, 1 << COUNTER_BITS)
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                for d, ids in zip(doc_ids[a:b], encode.encode(texts[a:b]), strict=True):
                    packer.add(d, ids + tail)
                if packer.done:
                    yield flush()
        packer.settle()
        if packer.done:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *([F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if stored_order else []))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
