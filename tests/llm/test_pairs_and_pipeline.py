import corpus_pipeline
from waymark.llm import preferences
from pyspark.sql import functions as F


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_pairs(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "ok"), ("assistant", "good")]
    b = [("user", "hi"), ("assistant", "yo"), ("user", "no"), ("assistant", "bad"), ("assistant", "worse")]
    rows = [(0, k, *t) for k, t in enumerate(a)] + [(1, k, *t) for k, t in enumerate(b)]
    rows += [(2, 0, None, None), (3, 0, None, None), (3, 1, "assistant", ""), (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, 0, "user", "u"), (6, 0, "user", "u"), (7, 0, "user", "u")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, prompt int")
    out = preferences.format_pairs(df, F.call_function("shiftright", F.col("conv_id"), F.lit(1)), F.col("conv_id") % 2 == 1)
    got = {r.pair_id: r for r in out.collect()}
    assert got[0].n_shared == 2 and got[0].prompt == render(a[:2]) and got[0].chosen == render(a[2:]) and got[0].rejected == render(b[2:])
    learned = lambda text, spans: [text[s.start : s.end] for s in spans]
    assert learned(got[0].chosen, got[0].chosen_spans) == ["good<|end|>\n"] and learned(got[0].rejected, got[0].rejected_spans) == ["bad<|end|>\n", "worse<|end|>\n"]
    assert got[1].n_shared == 1 and got[1].chosen == "" and got[1].rejected == render([("assistant", "")])
    assert got[2].n_shared == 0 and got[2].chosen == render([("user", "alone")]) and got[2].rejected == ""
    assert got[3].n_shared == 1 and got[3].chosen == render([("user", "u")]) and len(got) == 4
    assert preferences.format_pairs(df.limit(0), F.col("conv_id"), F.lit(False)).count() == 0


def test_long_turns(spark):
    long = "x" * 3_000_000
    rows = [(0, 0, "user", long), (0, 1, "assistant", long), (1, 0, "user", long), (1, 1, "assistant", "y" + long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preferences.format_pairs(df, F.call_function("shiftright", F.col("conv_id"), F.lit(1)), F.col("conv_id") % 2 == 1).first()
    assert got.n_shared == 1 and got.prompt == render([("user", long)]) and got.chosen == render([("assistant", long)])
    assert [(s.start, s.end) for s in got.rejected_spans] == [(14, 14 + len(long) + 1 + 8)]


def test_pipeline_stages(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{root}/labels.parquet").where("toxic = 1").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, root)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and len(left & toxic) < len(toxic) and len(left) > 0.8 * docs.count()
    known = corpus_pipeline.drop_unknown_language(spark, clean, root)
    assert known.columns == docs.columns and known.count() >= 0.97 * len(left)
    rows = known.unionAll(known.limit(3))
    single = corpus_pipeline.drop_near_duplicates(spark, rows, root)
    ids = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and len(ids) == len(set(ids))
    mixed = corpus_pipeline.mix_sources(spark, single, root)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack(spark, mixed, root)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_sequences_follow_the_training_order(spark, tmp_path):
    """Documents are numbered by training position; later files are larger, so a scan deals them first."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(40 * (1 + i // 100)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
    docs.write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(stored.inputFiles()) == 6
    pieces = corpus_pipeline.pack(spark, stored, "").collect()
    covered = {}
    for p in pieces:
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    assert covered == {p.doc_id: p.doc_tokens for p in pieces} and len(covered) == 600
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p.doc_id)
    means = [sum(by[s]) / len(by[s]) for s in sorted(by)]
    parts = [m // 100 for m in means]
    assert parts == sorted(parts) and parts[0] == 0 and parts[-1] == 5


def test_pipeline_on_an_empty_table(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
