"""PNG media columns: lossless 8-bit grey images of byte payloads, and perceptual hashes of what is read back.

Encoding filters every row (None, Sub or Up, by the least sum of absolute differences), deflates the rows and
frames them as IHDR, IDAT and IEND chunks with CRC-32. Decoding walks the chunks, tests signature, order,
every checksum and the inflated size, and undoes the filters in numpy: Sub is a running sum along the row, Up a
running sum down the rows since the last row that stands alone, and only Average and Paeth go byte by byte.

The hash: the image is averaged to 32 x 32 cells, its two-dimensional cosine transform is taken, and each of
the 64 lowest frequencies but the constant one gives a bit: above the median or not.

Rows: a null payload counts as empty; an empty one becomes one row of zeros; equal payloads give equal images
and hashes; repeated rows stay; a null ``doc_id`` is carried; other columns, whatever their names, are not looked
at; a very long text is one image, many rows high; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pretokens import batches
from waymark.llm.scratch import write_table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of one IDAT chunk; longer streams are split, as writers do.
IDAT_BYTES = 1 << 16
CELLS = 32
LOW = 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(payload: bytes, multiple: int = WIDTH) -> bytes:
    """The payload with zero bytes up to a positive multiple."""
    return payload.ljust(max(multiple, -(-len(payload) // multiple) * multiple), b"\0")


def filter_rows(rows: np.ndarray) -> np.ndarray:
    """Each row behind its filter byte: 0 None, 1 Sub, 2 Up; the one with the least sum of absolute values."""
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [np.minimum(x, 0 - x).sum(1, dtype=np.int64) for x in (rows, sub, up)]
    kind = np.argmin(cost, axis=0).astype(np.uint8)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], sub, up))
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, whose length is a positive multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    stream = zlib.compress(filter_rows(rows).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = [_chunk(b"IDAT", stream[k : k + IDAT_BYTES]) for k in range(0, len(stream), IDAT_BYTES)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(body) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a file as (kind, body). ``ValueError`` on a wrong signature, length or checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("PNG chunk is cut off")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png):
            raise ValueError("PNG chunk is cut off")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in PNG chunk {kind!r}")
        yield kind, body
        at += 12 + size


def unfilter(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows. One byte is one sample here."""
    if kind.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    out = rows.copy()
    sub = kind == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    if kind.max(initial=0) <= 2:
        up = kind == 2
        up[:1] = False  # above the first row there are zeros
        base = np.maximum.accumulate(np.where(up, 0, np.arange(len(kind))))
        run = np.cumsum(np.where(up[:, None], rows, 0), axis=0, dtype=np.uint8)
        return np.where(up[:, None], out[base] + run - run[base], out)
    above = np.zeros(rows.shape[1], np.uint8)
    for r, k in enumerate(kind.tolist()):
        if k == 2:
            out[r] = rows[r] + above
        elif k >= 3:
            left, row = 0, rows[r].tolist()
            for x, (value, b) in enumerate(zip(row, above.tolist(), strict=True)):
                c = int(above[x - 1]) if x else 0
                if k == 3:
                    guess = (left + b) // 2
                else:
                    near = [(abs(left + b - c - v), n, v) for n, v in enumerate((left, b, c))]
                    guess = min(near)[2]
                left = row[x] = (value + guess) & 255
            out[r] = row
        above = out[r]
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples (rows x width) of an 8-bit grey PNG without interlacing."""
    head, stream, ended = None, [], False
    for kind, body in chunks(png):
        if ended or (head is None) != (kind == b"IHDR"):
            raise ValueError("PNG chunks are out of order")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"PNG chunk {kind!r} isn't supported")
    if not ended:
        raise ValueError("PNG file has no end")
    width, height, *rest = head
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit grey PNG without interlacing is supported")
    flat = zlib.decompress(b"".join(stream))
    if len(flat) != height * (width + 1):
        raise ValueError("PNG has too few or too many samples")
    rows = np.frombuffer(flat, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines() -> np.ndarray:
    """The ``LOW`` lowest cosine-transform rows over ``CELLS`` samples."""
    x = (np.arange(CELLS) + 0.5) * np.pi / CELLS
    return np.cos(np.arange(LOW)[:, None] * x)


COSINES = _cosines()


def _shares(n: int) -> np.ndarray:
    """Borders of ``CELLS`` cells over ``n`` samples, as positions in a running sum with linear parts."""
    return np.arange(CELLS + 1) * (n / CELLS)


def _cells(samples: np.ndarray) -> np.ndarray:
    """Means over 32 x 32 cells of equal area; borders may lie inside a sample."""
    for _ in range(2):
        n = len(samples)
        sums = np.zeros((n + 1, samples.shape[1]))
        np.cumsum(samples, axis=0, out=sums[1:])
        at = _shares(n)
        low = np.minimum(at.astype(np.int64), n - 1)
        edge = sums[low] + (at - low)[:, None] * (sums[low + 1] - sums[low])
        samples = (np.diff(edge, axis=0) * (CELLS / n)).T
    return samples


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits as 8 bytes: which low frequencies lie above the median. The constant's bit is 0."""
    low = np.round(COSINES @ _cells(samples) @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def to_media(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, media``: every text, as UTF-8 with zeros up to a multiple of 64, as a PNG."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                media = [encode_png(pad(t)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_media(media: DataFrame) -> DataFrame:
    """Write a media column to the shared folder and return the table that reads it."""
    return write_table(media, "png")


def media_features(stored: DataFrame) -> DataFrame:
    """Decode the media column: payload facts, ``hash`` (8 bytes) and its hexadecimal form ``feature``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for png in batch.column(2).to_pylist():
                samples = decode_png(png)
                payload, bits = samples.tobytes(), cosine_hash(samples)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), bits.hex(), bits))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
