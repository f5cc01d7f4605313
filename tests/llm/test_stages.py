"""Stages of the pipeline against brute force, on documents with planted copies and odd rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from waymark.llm.entry import ORACLE_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, at int, doc string"


def planted(spark):
    """Documents with near copies, exact copies, repeated and null ids, empty texts, a long one, and clashing names."""
    rnd = random.Random(8)
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows = list(base)
    for k, (_, text, lang, source, n) in enumerate(rnd.sample([r for r in base if r[1] and len(r[1].split()) > 60], 12)):
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        rows += [(1000 + k, " ".join(words), lang, source, n), (2000 + k, text.upper(), lang, source, n)]
    rows += [rows[3], rows[3], (None, rows[5][1], "en", None, 1), (None, rows[5][1], "en", None, 1), (7, "the same id with another text " * 9, "en", "a", 1)]
    rows += [(3000, None, None, "a", 0), (3001, "", "en", "a", 0), (3002, " \n", "en", None, 0), (3003, "word " * 40_000, "en", "a", 0), (3004, "few words", "en", "a", 0), (3005, "FEW words", "en", "b", 0)]
    rnd.shuffle(rows)
    return spark.createDataFrame([(*r, "r", 1, "d") for r in rows], SCHEMA).repartition(3)


def stored(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_duplicates_leave_one_of_each_group(spark, tmp_path):
    docs = stored(spark, planted(spark), tmp_path / "docs")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    keys = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=str)
    sets, up = [shingles(t) for _, t in keys], list(range(len(keys)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups: dict[int, set] = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), set()).add(k)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(set(got)) == len(groups) and len(groups) < len(keys) - 20
    assert all(len(g & set(got)) == 1 for g in groups.values())
    assert {(r._row, r.at, r.doc) for r in out.collect()} == {("r", 1, "d")}


def test_mix_takes_what_the_sql_says(spark, tmp_path):
    docs = stored(spark, planted(spark).where("doc_id <> 3003 or doc_id is null").dropDuplicates(["doc_id"]).where("doc_id is not null"), tmp_path / "docs")
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/docs/*.parquet'")
    want = {}
    for doc_id, size, taken in duckdb.sql(f"select doc_id, size, taken from ({ORACLE_SQL['op3_mix_sources']})").fetchall():
        if size:
            want[doc_id] = taken // size + (2 * (taken % size) >= size)
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}


def test_packing_holds_the_librarys_ids(spark, tmp_path):
    docs = stored(spark, planted(spark).dropDuplicates(["doc_id"]), tmp_path / "docs")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces, at, filled = corpus_pipeline.pack(spark, docs, SF).collect(), {}, {}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.doc_tokens == len(whole[p.doc_id])
        ids = [int.from_bytes(bytes(p.ids)[k : k + 4], "little") for k in range(0, len(p.ids), 4)]
        assert ids == whole[p.doc_id][p.start : p.start + p.length]
        at[p.doc_id] = p.start + p.length
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert at == {d: len(ids) for d, ids in whole.items()}
    for own in filled.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_unknown_language])
def test_filters_keep_rows_as_they_are(spark, tmp_path, stage):
    """Every row that stays is one of the input, as often as there; odd rows have their defined result."""
    docs = stored(spark, planted(spark), tmp_path / "docs")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    count = lambda df: {str(r): r["n"] for r in df.groupBy(*docs.columns).agg(F.count("*").alias("n")).collect()}
    given, kept = count(docs), count(out)
    assert set(kept) <= set(given) and len(kept) > 0.85 * len(given)
    ids = {r.doc_id for r in out.collect()}
    if stage is corpus_pipeline.drop_toxic:
        assert {3000, 3001, 3002, 3004} <= ids  # texts without a toxic token are clean
    else:
        assert not {3000, 3001, 3002} & ids  # nothing tells their language
