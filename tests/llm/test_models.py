import itertools

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import compress_lang, toxic_crf
from waymark.llm.folds import held_out

ROOT = "/root/testdata/sf0.01"


def test_held_out(spark):
    import zlib

    ids = [0, 1, 2, 3, 10**12, -5, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out()).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    model = compress_lang.fit_languages(docs, ~held_out())
    assert sorted(model) == ["de", "en", "es", "fr"] and all(1000 < len(d) <= compress_lang.DICTIONARY_BYTES for _, d in model.values())
    rows = compress_lang.classify(docs, model).where(held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.96 and all(0 <= r.lang_score <= 1 for r in rows)
    assert np.mean([r.lang_rejected for r in rows]) < 0.02


def test_language_rows(spark):
    docs = spark.createDataFrame([(1, "der die und", "de", 1), (2, None, "de", 2), (3, "12 !!", None, 3), (None, "the of and", "en", 4), (5, "", "en", 5), (1, "der die und", "de", 6)], "doc_id long, text string, lang string, lang_pred int")
    model = compress_lang.fit_languages(docs, F.lit(True))
    rows = {r.doc_id: r for r in compress_lang.classify(docs, model).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[5].lang_pred == "und" and rows[2].lang_rejected
    assert rows[1].lang_pred == "de" and rows[None].lang_pred in ("de", "en")
    assert compress_lang.fit_languages(docs.limit(0), F.lit(True)) == {}
    assert [r.lang_pred for r in compress_lang.classify(docs, {}).collect()] == ["und"] * 6
    assert compress_lang.classify(docs.limit(0), model).count() == 0
    one = compress_lang.fit_languages(docs.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in compress_lang.classify(docs, one).collect()} == {"en", "und"}


def test_dictionaries_hold_whole_texts_within_bounds(spark):
    rows = [(7, "same text", "a")] * 50 + [(k, f"word{'abcdefgh'[k % 8]} " * (k + 1), "a") for k in range(20)] + [(None, "x" * 9000, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = compress_lang.fit_languages(docs, F.lit(True), sample_docs=12, dictionary_bytes=600, doc_bytes=100)
    assert {k: n for k, (n, _) in model.items()} == {"a": 70, "b": 3} and model["b"][1] == b"x" * 9000
    held, texts = model["a"][1].decode(), {compress_lang.letters(t).decode() for _, t, lang in rows if lang == "a"}
    assert len(held) <= 600 and held.count("same text") <= 1
    for t in sorted(texts, key=len, reverse=True):
        held = held.replace(t, "", 1)
    assert not held.strip()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 5, 0, 8, 3]
    odds, chain, start = rng.gamma(1.0, 1.0, sum(sizes)), rng.gamma(1.0, 1.0, 4), rng.gamma(1.0, 1.0, 2)
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])[np.array(sizes) > 0]] = True
    got, at = toxic_crf.marginals(odds, first, chain, start), 0
    for n in sizes:
        total, mine = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = 1.0
            for t, y in enumerate(tags):
                w *= (start[y] if t == 0 else chain[2 * tags[t - 1] + y]) * (odds[at + t] if y else 1.0)
            total += w
            mine += w * np.array(tags)
        assert np.allclose(got[at : at + n], mine / total if n else [])
        at += n


def planted(n=240, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    texts, toxic = [], []
    for k in range(n):
        body = list(rng.choice(words, 40))
        if k % 6 == 0:
            for at in rng.choice(40, 3, replace=False):
                body[at] = rng.choice(["zzfool", "zzjerk"])
        texts.append(" ".join(body))
        toxic.append(int(k % 6 == 0))
    return texts, np.array(toxic)


def test_field_finds_planted_words():
    texts, toxic = planted()
    tag = toxic_crf.Tagger(toxic_crf.train(texts, toxic))
    others, truth = planted(seed=2)
    got = tag(others)
    assert [int(s >= 0.3) for s, _ in got] == truth.tolist()
    for text, (_, spans), y in zip(others, got, truth, strict=True):
        found = {w for s in spans for w in text[s["start"] : s["end"]].split()}
        assert found == ({w for w in text.split() if w.startswith("zz")} if y else set())
    assert tag(["", "12 34", "Zzfool! zzjerk?"])[2][0] > 0.3


def test_toxicity_rows(spark):
    texts, toxic = planted()
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (None, "zzfool zzjerk zzfool", 1), (0, texts[0], 1)], "doc_id long, text string, toxic_score int")
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(toxic)] + [(5000, 1), (None, 1), (3, None), (6, 0)], "doc_id long, toxic int")
    model = toxic_crf.fit_toxicity(docs, labels, ~held_out())
    rows = toxic_crf.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    assert all(r.toxic_pred == (1 if r.doc_id is None else int(r.doc_id < 240 and r.doc_id % 6 == 0)) for r in rows)
    assert toxic_crf.score_toxicity(docs, toxic_crf.fit_toxicity(docs, labels.where("toxic = 0"), F.lit(True))).where("toxic_score > 0").count() == 0
    assert toxic_crf.fit_toxicity(docs.limit(0), labels, F.lit(True)).curve is None
    assert toxic_crf.score_toxicity(docs.limit(0), model).count() == 0


def test_very_long_texts(spark):
    """Whole texts decide, whatever their length: what only the last words say is found."""
    clean, toxic = [f"pleasant words number {k} about rivers" for k in range(60)], [f"pleasant vileword{k % 3} badmouth number {k}" for k in range(30)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(clean + toxic)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(90)], "doc_id long, toxic int")
    model = toxic_crf.fit_toxicity(docs, labels, F.lit(True))
    long = spark.createDataFrame([(1, "about rivers " * 200_000), (2, "about rivers " * 200_000 + "vileword1 badmouth")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxic_crf.score_toxicity(long, model).collect()}
    assert got[1].toxic_pred == 0 and got[2].toxic_pred == 1
    langs = spark.createDataFrame([(k, t, lang) for lang, t in (("en", "the of and to in that it is was for "), ("de", "der die und das nicht ist ein zu von mit ")) for k in range(30)], "doc_id long, text string, lang string")
    told = compress_lang.classify(spark.createDataFrame([(1, "der die und das nicht ist " * 100_000), (2, "the of and to in that " * 100_000)], "doc_id long, text string"), compress_lang.fit_languages(langs, F.lit(True)))
    assert {r.doc_id: r.lang_pred for r in told.collect()} == {1: "de", 2: "en"}
