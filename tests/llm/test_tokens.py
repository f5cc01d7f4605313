import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import packing, token_counts, token_store
from waymark.llm.pretokens import Memo, drops_space, keeps_blank
from waymark.llm.wordids import WordIds, load

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a  b", "a \nb", "a\n b", "\n\n x", "x \n\n", "  lead", "trail ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "<|STARTOFTEXT|>", "ΣΑΣ. Σ", "İstanbul é é",
    "日本語 テスト", "👍🏽 hi", "a\xa0b", "a b c", "don't I'll 's 'S we'VE", "a\x1cb \x1d c", "x\r\n y\tz", "12 345 a1b2", "!!! ?.. ,.", "\x00 a", "ª º ² ½", "ﬁ ſt", "a.b,c d.", "foo... bar?!", "x" * 5000,
]


@pytest.fixture(scope="module")
def words():
    return WordIds(WORD, Memo(15_000))  # generations change all the time


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(BYTE, token_counts.prove_whole_tokens(BYTE), Memo(15_000))


def test_words_equal_library(words):
    assert drops_space(WORD) and not drops_space(BYTE) and keeps_blank(BYTE) and not keeps_blank(WORD)
    raw = [t.encode() for t in ODD]
    assert words.encode(raw) == words.whole(raw) and words.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_equals_library(words, counter, text):
    both = [text.encode(), ODD[len(text) % len(ODD)].encode()]
    assert words.encode(both) == words.whole(both)
    assert counter.count([text.encode()]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_whole_tokens_are_proven(counter):
    some = sorted(counter.whole)[:: len(counter.whole) // 500]
    assert all(len(e.ids) == 1 for e in counter.tokenizer.encode_batch([t.decode() for t in some], add_special_tokens=False))
    assert counter.count([t.encode() for t in ODD]) == [len(e.ids) for e in counter.tokenizer.encode_batch(ODD, add_special_tokens=False)]


PARTS = ["'s", "'", "'re", "it's", "ll", "L'ÉTÉ", " ", "  ", "\n", "\t ", "a", "Zz", "7", "42", "!?", "é", "İ", "ŉſ", "×", "e\u0301", "\x07", "日本", "\xa0", "<|", "<|endoftext|>", "…"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_batches_equal_library(words, counter, texts):
    raw = [t.encode() for t in texts]
    assert words.encode(raw) == words.whole(raw)
    assert counter.count(raw) == [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_megabytes_without_a_blank(words, counter):
    for text in ("abcdefghij" * 500_000, "0123456789+/" * 400_000, "日本語" * 100_000):
        raw = text.encode()
        assert words.encode([b"a", raw, b"b"])[1] == words.whole([raw])[0]
        assert counter.count([raw]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]
    assert all(len(k) <= Memo.LONGEST for m in (words.memo, counter.memo) for k in (*m.young, *m.old))


def test_memo_is_bounded():
    memo, seen = Memo(3 * (Memo.ENTRY + 1)), []
    twice = lambda ks: seen.extend(ks) or [2 * k for k in ks]
    for keys in (["a", "b"], ["a", "c"], ["d", "e", "a"], ["b", "a"], ["x" * 65], ["x" * 65]):
        assert memo.look_up(keys, twice) == [2 * k for k in keys]
        assert len(memo.young) <= 3 and len(memo.old) <= 3
    assert seen.count("x" * 65) == 2 and seen.count("a") == 1


def test_count_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y"), (4, "word " * 600, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(map(tuple, token_counts.count_tokens(docs, BYTE).collect()), key=str)
    assert out == sorted([(1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (None, 0, 0, False), (4, 3000, 601, True)], key=str)
    assert token_counts.count_tokens(docs.limit(0), BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0) | st.integers(2**59, 2**60 + 1), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    segment = token_store.pack(v)
    assert (token_store.unpack(segment) == v).all()
    assert (token_store.unpack(segment, 1, 2) == v[token_store.BLOCK : 2 * token_store.BLOCK]).all()


def test_store_rows(spark):
    tok = load(WORD)
    texts = {7: "some words here.", 3: None, 5: "", 9: "Ünï " * 40_000, -2: "again and again"}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, ids string").repartition(3)
    store = token_store.write_ids(docs, WORD)
    got, start = sorted(token_store.read_digests(store).collect()), 0
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: len(r.ids) // 4 for r in token_store.read_ids(store).collect()} == {r.doc_id: r.n_tokens for r in got}
    assert token_store.read_digests(token_store.write_ids(docs.limit(0), WORD)).count() == 0
    twice = token_store.read_digests(token_store.write_ids(docs.where("doc_id = 7").unionAll(docs.where("doc_id = 7")).unionAll(docs.selectExpr("null", "text", "ids").limit(1)), WORD))
    assert [r.doc_id for r in sorted(twice.collect(), key=lambda r: r.start)] == [None, 7, 7]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=120), st.sampled_from([64, 100]), st.sampled_from([4, 4096]))
def test_packer(sizes, window, max_open):
    rng = np.random.default_rng(len(sizes))
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in sizes]
    packer = packing.Packer(window, 100, max_open)
    for k, d in enumerate(docs):
        packer.add(k, d)
        assert packer.n_open <= max_open
    packer.settle()
    back, fill = {}, {}
    for key, start, ids, total, sequence, offset in packer.done:
        assert fill.get(sequence, 0) == offset and total == sizes[key]
        fill[sequence] = offset + len(ids) // 4
        back.setdefault(key, {})[start] = ids
    assert all(b"".join(v for _, v in sorted(back[k].items())) == d for k, d in enumerate(docs))
    assert all(n == window or n & (n - 1) == 0 for n in fill.values())  # no padding at all


def test_sum_of_squares_choice():
    """Against the rule itself: the level whose counts' squares sum to the least after the move."""
    rng, window = np.random.default_rng(3), 50
    packer = packing.Packer(window, 0)
    for k in range(300):
        size = int(rng.integers(1, 49))
        before = packer.level.copy()
        packer.add(k, bytes(4 * size))
        costs = {}
        for h in range(window - size + 1):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < window
                costs[h] = int((after**2).sum())
        assert int((packer.level**2).sum()) == min(costs.values())


def test_pack_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, None, 2), (None, "", 3), (4, "many words " * 3000, 4), (4, "x", 5)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, WORD).collect()
    tok = load(WORD)
    whole = np.array([*tok.encode("many words " * 3000, add_special_tokens=False).ids, 1], "<u4").tobytes()
    pieces = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 4 and r.doc_tokens > 10)
    assert b"".join(p for _, p in pieces) == whole and all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == len(whole) // 4 + 4 + 1 + 1 + 2
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def numbered(spark, n, longest):
    return spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(1 + i * 7 % longest)), i % 3) for i in range(n)], "doc_id long, text string, source int")


def sequences(pieces, window=2048):
    """Checks that every sequence is whole and every document covered; the documents of each sequence by its id."""
    by, covered = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        own = by.setdefault(p.sequence_id, [])
        assert p.offset == sum(x.length for x in own)
        own.append(p)
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    for own in by.values():
        size = sum(p.length for p in own)
        assert size == window or (size < window and size & (size - 1) == 0)
    return {s: [p.doc_id for p in own] for s, own in by.items()}, covered


def test_stored_order_of_folders(spark, tmp_path):
    """A table by folders has files of one name in each."""
    numbered(spark, 300, 400).coalesce(2).write.partitionBy("source").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert len({f.rsplit("/", 1)[-1] for f in stored.inputFiles()}) < len(stored.inputFiles())
    pieces = packing.pack_documents(stored, WORD, stored_order=True).collect()
    by, covered = sequences(pieces)
    assert covered == {p.doc_id: p.doc_tokens for p in pieces} and len(covered) == 300
    source = [max(d % 3 for d in by[s]) for s in sorted(by)]
    assert source == sorted(source)


def test_stored_order_of_small_splits(spark, tmp_path):
    """Splits under a MB of one file, repeated rows and null ids."""
    docs = numbered(spark, 900, 900).repartition(1).sortWithinPartitions("doc_id")
    docs = docs.unionAll(docs.where("doc_id < 5")).unionAll(docs.limit(3).selectExpr("cast(null as long)", "text", "source")).coalesce(1)
    docs.write.option("parquet.block.size", 40_000).option("parquet.page.size", 5_000).option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        stored = spark.read.parquet(f"{tmp_path}/t")
        assert stored.select("_metadata.file_block_start").distinct().count() > 5
        rows = packing.pack_documents(stored, WORD, stored_order=True)
        pieces = rows.collect()
        again = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by, covered = sequences(pieces)
    assert sorted(map(str, pieces)) == sorted(map(str, again))
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(covered[d] == n * (2 if d is not None and d < 5 else 1) for d, n in total.items() if d is not None) and None in covered
    means = [sum(d or 0 for d in by[s]) / len(by[s]) for s in sorted(by)]
    assert sum(b < a - 300 for a, b in zip(means, means[1:], strict=False)) <= 3


def test_too_many_sequences():
    packer = packing.Packer(4, 0, most=1)
    packer.add(1, bytes(16))
    with pytest.raises(ValueError):
        packer.add(2, bytes(16))
