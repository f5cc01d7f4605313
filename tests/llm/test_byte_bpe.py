import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import byte_bpe
from waymark.llm.byte_bpe import ByteBpe, coder, decoder, load_ranks
from waymark.llm.entry import QUERIES
from waymark.llm.pretokens import WITH_BLANK

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def ids_of(texts):
    return coder(PATH).encode([t.encode() for t in texts]).to_pylist()


def brute(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(piece) > 1 and piece not in ranks:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]


def test_pattern_is_the_files():
    assert WITH_BLANK == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab ea'stredvlm\n\t 12.é中\x85\x1c　<|>"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=5))
def test_ids_and_bytes(texts):
    ids = coder(PATH).encode([t.encode() for t in texts])
    assert ids.to_pylist() == [LIBRARY.encode_ordinary(t) for t in texts]
    assert decoder(PATH).decode(ids).to_pylist() == [t.encode() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=5), max_size=30, unique=True), st.lists(st.text(alphabet="abc", max_size=200), max_size=4))
def test_any_ranks_whatever_their_order(words, texts):
    """Vocabularies in which a merge can make a pair of smaller rank than its own, in matrices and in long vectors."""
    ranks = {bytes([b]): b for b in range(256)}
    for w in words:
        ranks.setdefault(w.encode(), len(ranks))
    got = ByteBpe(ranks).merge([t.encode() for t in texts])
    assert [np.frombuffer(ids, np.int32).tolist() for ids in got] == [brute(t.encode(), ranks) for t in texts]


def test_long_and_odd():
    texts = ["a" * 50_000, "ab" * 20_000, "etaoin" * 9000 + "x", "", " " * 3000, "\n" * 70, "中" * 400, "<|endoftext|> x", "word " * 50_000]
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_unknown_ids_and_missing_bytes():
    with pytest.raises(ValueError):
        decoder(PATH).decode(pa.array([[60_000]], pa.list_(pa.int32())))
    with pytest.raises(ValueError):
        ByteBpe({b"a": 0})
    assert decoder(PATH).decode(pa.array([None, [], [64]], pa.list_(pa.int32()))).to_pylist()[:2] == [b"", b""]


def test_rows(spark):
    schema = "doc_id long, ids string, text string, decoded int"
    docs = spark.createDataFrame([(1, "a", None, 1), (None, "b", "two", 2), (2, None, "x" * 30_000, 3), (2, None, "x" * 30_000, 3), (3, "", "", 4)], schema)
    got = sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in byte_bpe.decode_ids(byte_bpe.encode_texts(docs, PATH), PATH).collect())
    want = sorted((r.doc_id or 0, LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert got == want
    assert byte_bpe.encode_texts(docs.limit(0), PATH).count() == 0


def test_query_equals_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
