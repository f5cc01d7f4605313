import struct
import zlib

import numpy as np
import pytest

from waymark.llm import png_media as m


def test_round_trip_and_rows(spark):
    texts = ["", None, "a" * 64, "wörter " * 999, "a" * 64, "\n"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in m.media_features(m.store_media(m.to_media(docs))).collect()}
    assert len(rows) == 6 and rows[2].feature == rows[4].feature and rows[2].media_sha256 == rows[4].media_sha256
    for k, t in enumerate(texts):
        b = (t or "").encode()
        assert rows[k].n_bytes == len(b) and rows[k].payload_bytes == max(64, -(-len(b) // 64) * 64)
        assert m.decode_png(m.encode_png(m.pad(b))).tobytes().rstrip(b"\0") == b.rstrip(b"\0")
    assert m.to_media(docs.limit(0)).count() == 0


def by_hand(kind, rows):
    """The five filters undone byte by byte."""
    out = np.zeros_like(rows)
    for r in range(len(rows)):
        for x in range(rows.shape[1]):
            a = int(out[r, x - 1]) if x else 0
            b = int(out[r - 1, x]) if r else 0
            c = int(out[r - 1, x - 1]) if r and x else 0
            p = a + b - c
            paeth = min(((abs(p - v), n, v) for n, v in enumerate((a, b, c))))[2]
            out[r, x] = (int(rows[r, x]) + (0, a, b, (a + b) // 2, paeth)[kind[r]]) % 256
    return out


@pytest.mark.parametrize("kinds", [3, 5])
def test_unfilter(kinds):
    rng = np.random.default_rng(kinds)
    kind, rows = rng.integers(0, kinds, 40).astype(np.uint8), rng.integers(0, 256, (40, 16)).astype(np.uint8)
    assert (m.unfilter(kind, rows) == by_hand(kind, rows)).all()


def test_filter_is_undone():
    rows = np.frombuffer(bytes(range(256)) * 4 + b"text and more text " * 100 + bytes(20), np.uint8)[: 64 * 40].reshape(40, 64)
    f = m.filter_rows(rows)
    assert len(set(f[:, 0])) > 1 and (m.unfilter(f[:, 0], f[:, 1:]) == rows).all()


def test_damage_is_found():
    png = m.encode_png(m.pad(b"some text " * 200))
    for at in (3, 20, len(png) // 2, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            m.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        m.decode_png(png[:-12])
    with pytest.raises(ValueError):
        m.decode_png(png[:-5])


def test_chunks_are_split_and_checked():
    payload = np.random.default_rng(0).integers(0, 256, 64 * 3000).astype(np.uint8).tobytes()
    png = m.encode_png(payload)
    kinds = [k for k, _ in m.chunks(png)]
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and kinds.count(b"IDAT") > 1
    assert struct.unpack(">II", dict(m.chunks(png))[b"IHDR"][:8]) == (64, 3000)
    assert m.decode_png(png).tobytes() == payload and zlib.crc32(payload) == zlib.crc32(m.decode_png(png).tobytes())


def test_hash_is_low_frequency():
    rng = np.random.default_rng(1)
    smooth = np.clip(128 + 60 * np.add.outer(np.sin(np.arange(96) / 15), np.cos(np.arange(64) / 11)), 0, 255)
    bits = lambda x: np.unpackbits(np.frombuffer(m.cosine_hash(x), np.uint8))
    a, b, c = bits(smooth), bits(smooth * 0.5 + 10), bits(rng.integers(0, 256, (96, 64)))
    assert (a != b).sum() <= 4 < (a != c).sum() and a[0] == 0
    mean = np.arange(6.0).reshape(3, 2)
    assert np.isclose(m._cells(mean).mean(), mean.mean()) and m._cells(mean).shape == (32, 32)


def test_odd_rows_of_the_columns(spark):
    """Null ids, names of the operator's own columns, repeated rows and a long text."""
    long = "long text " * 300_000
    rows = [(None, "x", "p", 1, None), (None, "y", "p", 1, None), (5, long, "p", 2, "f"), (5, long, "p", 2, "f"), (6, "x", None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload_sha256 string, n_bytes int, feature string")
    got = m.media_features(m.store_media(m.to_media(docs))).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[5, len(long)].payload_bytes == -(-len(long) // 64) * 64 and by[6, 1].feature == by[None, 1].feature or by[6, 1].n_bytes == 1
    assert len({r.media_sha256 for r in got if r.doc_id == 5}) == 1 and len({r.media_sha256 for r in got}) == 3
