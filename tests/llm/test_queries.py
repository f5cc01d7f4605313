"""The registered queries themselves, on the smallest tables: against their SQL, the libraries or plain Python."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm.test_neighbours import brute
from waymark.llm import compress_lang, entry, png_media, toxic_crf
from waymark.llm.folds import held_out

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(ROOT):
        c.execute(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    return c


@pytest.mark.parametrize("name", list(entry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.QUERIES[name](spark, ROOT)
    want = con.execute(entry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{ROOT}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in t}


def ids_of(docs):
    tok = Tokenizer.from_file(public_tokenizers.path(entry.WORD_BPE))
    return {d: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for d, r in docs.items()}


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path(entry.BYTE_BPE))
    rows = entry.QUERIES["op1_token_counts"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]["text"] or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_token_ids(spark, docs):
    start, ids = 0, ids_of(docs)
    rows = sorted(entry.QUERIES["op2_token_ids"](spark, ROOT).collect())
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens


def test_packing(spark, docs):
    ids, held, filled = ids_of(docs), {}, {}
    for r in sorted(entry.QUERIES["op8_pack"](spark, ROOT).collect(), key=lambda r: (r.sequence_id, r.offset)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
        held.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, pieces in held.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(held) == set(docs) and all(n == 2048 or n & (n - 1) == 0 for n in filled.values())


def plain_hash(samples):
    """Cell means by weighted sums and the transform by its definition."""
    def means(x):
        n, out = len(x), []
        for c in range(32):
            lo, hi = c * n / 32, (c + 1) * n / 32
            w = np.maximum(0, np.minimum(np.arange(n) + 1, hi) - np.maximum(np.arange(n), lo))
            out.append((w[:, None] * x).sum(0) / (n / 32))
        return np.array(out)

    cells = means(means(samples.astype(float)).T).T
    low = np.array([[sum(cells[y, x] * math.cos(math.pi * u * (y + 0.5) / 32) * math.cos(math.pi * v * (x + 0.5) / 32) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    return low


def test_media(spark, docs):
    rows = entry.QUERIES["op9_media"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    for k, r in enumerate(rows):
        raw = (docs[r.doc_id]["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        png = png_media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        if k < 4:
            low = plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64)).ravel()
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8))
            clear = np.abs(low - np.median(low[1:])) > 1e-3
            clear[0] = False
            assert bits[0] == 0 and (bits == (low > np.median(low[1:])))[clear].all()


def test_near_duplicates(spark, docs):
    want = brute([(d, r["text"]) for d, r in docs.items()], 3, (85, 100))
    rows = entry.QUERIES["op10_near_duplicates"](spark, ROOT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_language(spark, docs):
    """Every answer from the dictionaries by one plain compression after the other."""
    import zstandard

    model = compress_lang.fit_languages(spark.read.parquet(f"{ROOT}/documents.parquet"), ~held_out())
    learned = [r for r in docs.values() if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    assert {k: n for k, (n, _) in model.items()} == {k: sum(r["lang"] == k for r in learned) for k in {r["lang"] for r in learned}}
    params = lambda d: zstandard.ZstdCompressionParameters.from_level(compress_lang.LEVEL, source_size=1024, dict_size=len(d), write_content_size=False, write_checksum=False, write_dict_id=False)
    coders = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params(d)) for k, (_, d) in model.items()}
    rows = entry.QUERIES["op4_language"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]["text"]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
            continue
        body = compress_lang.letters(text)
        sizes = {k: sum(len(c.compress(body[a : a + 1024])) for a in range(0, len(body), 1024)) for k, c in coders.items()}
        least = min(sizes.values())
        assert sizes[r.lang_pred] == least and math.isclose(r.score, 1 / sum(math.exp(-compress_lang.SHARPNESS * (s / least - 1)) for s in sizes.values()), rel_tol=1e-9)


def test_toxicity(spark, docs):
    """Scores from forward and backward passes over one document after the other, token by token."""
    model = toxic_crf.fit_toxicity(spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet"), ~held_out())
    rows = entry.QUERIES["op6_toxicity"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    (a00, a01, a10, a11), (s0, s1) = model.chain, model.start
    for r in rows:
        odds = [math.exp(max(-30, min(30, model.bias + sum(model.weights.get(f, 0.0) for f in toxic_crf.features(w))))) for w in toxic_crf.TOKEN.findall(docs[r.doc_id]["text"] or "")]
        ahead, behind = [], []
        for k, e in enumerate(odds):
            x, y = (s0, s1 * e) if not k else (ahead[-1][0] * a00 + ahead[-1][1] * a10, (ahead[-1][0] * a01 + ahead[-1][1] * a11) * e)
            ahead.append((x / (x + y), y / (x + y)))
        for e in [1.0, *odds[:0:-1]] if odds else []:
            x, y = behind[-1] if behind else (1.0, 1.0)
            x, y = (x, y) if not behind else (a00 * x + a01 * e * y, a10 * x + a11 * e * y)
            behind.append((x / (x + y), y / (x + y)))
        p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(ahead, behind[::-1], strict=True)]
        z = model.curve[0] + model.curve[1] * float(toxic_crf.evidence(sum(v * v for v in p)))
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-7) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
