"""Token ids in Simple-8b files: 64-bit words whose top four bits say how many ids of which width follow.

A segment is one binary value: a fixed header, the first word of every block of ``BLOCK`` ids, the words, and
the escapes (values too wide for the widest selector, which a selector-0 word points to). Blocks start on a
word of their own, so any of them can be decoded alone; decoding a segment is one numpy pass per selector.

Segments lie in a Parquet table in ascending ``doc_id`` order, whole documents only, so that Spark writes and
reads them on any store. ``part`` is the range partition, ``seq`` the segment in it; the ids before a part
follow from the parts' totals.

Rows: a null text is an empty one (only the end id); a null ``doc_id`` sorts first; repeated rows are stored
each, in any order among equals; an empty table gives an empty store; other columns are not looked at. A very
long document makes a long segment: a document is encoded in memory anyway.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.pretokens import batches
from waymark.llm.scratch import write_table
from waymark.llm.wordids import encoder

#: Ids per word and bits per id of selectors 1 to 14; selector 0 is an escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 128
SEGMENT_IDS = 65_536
HEADER = struct.Struct("<4sIIIII")
STORE_SCHEMA = "part int, seq int, start_in_part long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"


def pack(values: np.ndarray) -> bytes:
    """A segment of non-negative integers below 2^64. All blocks are packed side by side, word by word."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = values
    wide = grid >= np.uint64(1 << 60)
    escapes = grid[wide]
    grid[wide] = np.arange(len(escapes), dtype=np.uint64)
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.int16)
    exact = np.maximum(bits - 1, 0).astype(np.uint64)
    bits = np.where((bits > 0) & (grid >> np.minimum(exact, np.uint64(63)) == 0), bits - 1, bits)  # a double may round up
    bits[wide] = 61
    selector = np.zeros(blocks * BLOCK, np.int64)  # of a word that starts at the id
    left = np.minimum(BLOCK - np.arange(blocks * BLOCK) % BLOCK, np.maximum(n - np.arange(blocks * BLOCK), 0))
    most = {1: bits}  # the widest of the next 1, 2, 4 ... ids
    for k in (2, 4, 8, 16, 32):
        half = most[k // 2]
        most[k] = np.maximum(half, np.concatenate([half[k // 2 :], np.zeros(min(k // 2, len(half)), half.dtype)])[: len(half)])
    for s in range(len(COUNTS) - 1, 0, -1):
        count = int(COUNTS[s])
        power = 1 << (count.bit_length() - 1)
        widest = most[power]
        if count > power:
            shift = count - power
            widest = np.maximum(widest, np.concatenate([widest[shift:], np.zeros(min(shift, len(widest)), widest.dtype)])[: len(widest)])
        selector[(widest <= WIDTHS[s]) & (left >= count)] = s
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    starts, owners, block = [], [], np.arange(blocks)
    while len(at):
        starts.append(at)
        owners.append(block)
        at = at + COUNTS[selector[at]]
        on = at < end[block]
        at, block = at[on], block[on]
    if starts:
        starts_, owners_ = np.concatenate(starts), np.concatenate(owners)
        order = np.argsort(starts_, kind="stable")
        first, of_block = starts_[order], owners_[order]
    else:
        first, of_block = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = selector[first]
    words = kind.astype(np.uint64) << np.uint64(60)
    words[kind == 0] |= grid[first[kind == 0]]
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(kind == s)
        for j in range(int(COUNTS[s])) if len(rows) else ():
            words[rows] |= grid[first[rows] + j] << np.uint64(j * int(WIDTHS[s]))
    offsets = np.searchsorted(of_block, np.arange(blocks)).astype("<u4")
    return HEADER.pack(b"S8B1", n, BLOCK, blocks, len(words), len(escapes)) + offsets.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def unpack(segment: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The integers of a segment, or of its blocks ``first_block`` up to ``last_block`` (not included)."""
    magic, n, size, blocks, n_words, n_escapes = HEADER.unpack_from(segment)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    at = HEADER.size
    offsets = np.frombuffer(segment, "<u4", blocks, at)
    words = np.frombuffer(segment, "<u8", n_words, at + 4 * blocks)
    escapes = np.frombuffer(segment, "<u8", n_escapes, at + 4 * blocks + 8 * n_words)
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    words = words[offsets[first_block] : offsets[last_block] if last_block < blocks else n_words]
    kind = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[kind]
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == s)
        body = words[rows] & np.uint64((1 << 60) - 1)
        if s == 0:
            out[place[rows]] = escapes[body.astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[place[rows] + j] = body >> np.uint64(j * int(WIDTHS[s])) & mask
    return out


def write_ids(docs: DataFrame, path: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode ``docs`` with the tokenizers file at ``path`` and return the written table of segments.

    Texts are dealt by ranges of ``doc_id`` (one shuffle of the raw text, which is smaller than its ids), so
    encoding and writing are spread evenly whatever the sources look like.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        seq = before = held = 0
        names: list = []
        parts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            lengths = [len(p) // 4 for p in parts]
            payload = pack(np.frombuffer(b"".join(parts), "<u4"))
            cols = [[part], [seq], [before], [names], [lengths], [held], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "seq", "start_in_part", "doc_ids", "lengths", "n_ids", "payload"])

        for batch in it:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                for d, ids in zip(doc_ids[a:b], encode.encode(texts[a:b]), strict=True):
                    names.append(d)
                    parts.append(ids + tail)
                    held += len(ids) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield segment()
                        seq, before, held, names, parts = seq + 1, before + held, 0, [], []
        if parts:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    # The hash spreads rows that repeat an id, or have none, over ranges of their own.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return write_table(ordered.mapInArrow(run, STORE_SCHEMA), "ids")


def read_ids(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every stored document."""
    return _read(store, lambda ids, a, b: ids[a:b].tobytes(), pa.binary(), "ids binary")


def read_digests(store: DataFrame) -> DataFrame:
    """As ``read_ids``, with ``ids_crc32``, the unsigned CRC-32 of those bytes, in the place of the ids."""
    return _read(store, lambda ids, a, b: zlib.crc32(ids[a:b].tobytes()), pa.int64(), "ids_crc32 long")


def _read(store: DataFrame, of, kind: pa.DataType, column: str) -> DataFrame:
    # What lies before a part is the sum of the parts below it. One row for each task that wrote, 16 bytes: with a
    # million tasks still a small broadcast, and the segments are not shuffled for it.
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("part_ids").over(below), F.lit(0)).alias("base"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                cols = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + (row["start_in_part"] + row["base"]), pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([of(ids, a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], kind),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", column.split()[0]])

    return store.join(F.broadcast(bases), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
