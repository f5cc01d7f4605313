import numpy as np

from waymark.llm import circulant, nn_graph
from waymark.llm.entry import op7_neighbours


def test_recall_on_the_table(spark):
    root = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{root}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(1))
    got = {}
    for r in op7_neighbours(spark, root).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (norm * norm[q])
        s[q] = -9
        best, mine = np.lexsort((ids, -s))[:5], sorted(got[ids[q]])
        hits += len({int(i) for i in ids[best]} & {v for _, v, _ in mine})
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s[ids == v][0] - sc) < 1e-12 for _, v, sc in mine)
    assert hits / (5 * (ids % 50 == 0).sum()) >= 0.9


def test_vector_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (0, [1.0, 0.0])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    out = nn_graph.nearest_neighbours(v, lambda i: i % 50 == 0)
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 12)))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 50, 1.0), (4, 3, 0.0)], 50: [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 0.0)]}
    assert nn_graph.nearest_neighbours(v.limit(0), lambda i: i % 50 == 0).count() == 0


def test_repeated_ids(spark):
    inf = float("inf")
    rows = [(0, [0.0, 0.0]), (0, [1.0, 0.1]), (50, [inf, 1.0]), (50, [0.0, 1.0]), (50, [0.5]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [0.0, 2.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in sorted(nn_graph.nearest_neighbours(v, lambda i: i % 50 == 0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    near = lambda *x: [(i, round(float(s), 9)) for i, s in x]
    a, b = 1 / np.hypot(1, 0.1), 0.1 / np.hypot(1, 0.1)
    assert got == {0: near((7, a), (100, a), (50, b), (8, -a)), 50: near((7, 1), (100, 1), (0, b), (8, 0)), 100: near((7, 1), (50, 1), (0, b), (8, 0))}


def table_of(spark, ids, x):
    return spark.createDataFrame(zip(ids.tolist(), x.tolist(), strict=True), "vec_id long, embedding array<double>").repartition(4)


def recall(out, ids, x, k=5):
    """Share of the k best places that hold a neighbour at least as near (to 1e-12) as the k-th in truth."""
    unit, hits, n, at = x / np.linalg.norm(x, axis=1, keepdims=True), 0, 0, {int(i): j for j, i in enumerate(ids)}
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        s = unit @ unit[at[q]]
        s[at[q]] = -9
        least = np.partition(s, -k)[-k]
        hits, n = hits + sum(s[at[v]] >= least - 1e-12 for v in found), n + k
    return hits / n


def test_near_copies_and_rescaled_copies(spark):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(64) / 8
    ids = np.arange(5000)
    jittered = one + 0.002 / 8 * rng.standard_normal((5000, 64))
    out = nn_graph.nearest_neighbours(table_of(spark, ids, jittered), lambda i: i % 50 == 0)
    assert recall(out, ids, jittered) >= 0.9
    rescaled = one * rng.uniform(0.01, 100, (5000, 1))
    got = {}
    for r in sorted(nn_graph.nearest_neighbours(table_of(spark, ids, rescaled), lambda i: i % 500 == 0).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i in range(6) if i != q][:5] for q in range(0, 5000, 500)}


def test_recall_on_many_vectors(spark):
    """At 20,000 rows a fixed number of rounds and a beam of 64 are not enough."""
    old = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], np.float64)
    ids, x = np.arange(20_000), np.random.default_rng(20_000).multivariate_normal(old.mean(0), np.cov(old.T), 20_000)
    out = nn_graph.nearest_neighbours(table_of(spark, ids, x), lambda i: i % 200 == 0)
    assert recall(out, ids, x) >= 0.93


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_vectors_are_not_sent_for_each_pair(spark):
    """A graph of all nodes sent a vector for each pair that build and search measured: some hundred times the table."""
    ids, x = np.arange(6000), np.random.default_rng(11).standard_normal((6000, 64))
    table, before = table_of(spark, ids, x).localCheckpoint(), shuffled(spark)
    out = nn_graph.nearest_neighbours(table, lambda i: i % 50 == 0)
    assert recall(out, ids, x) >= 0.93
    assert shuffled(spark) - before < 15 * x.nbytes


def test_many_shards(spark, monkeypatch):
    """Near copies, repeated vectors and repeated ids whose rows lie in different shards."""
    monkeypatch.setattr(nn_graph, "LEAST", 150)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[1000:2000] = x[:25].repeat(40, 0) + 0.01 * rng.standard_normal((1000, 16))
    x[2000:2100] = x[0]
    ids = np.arange(3000)
    assert nn_graph.shards_for(3000) == 20
    out = nn_graph.nearest_neighbours(table_of(spark, ids, x), lambda i: i % 10 == 0)
    assert recall(out, ids, x) >= 0.93
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 3000, 10)) and got[0] == [2000, 2001, 2002, 2003, 2004] and got[2000] == [0, 2001, 2002, 2003, 2004]
    names = np.where(ids < 400, 7, ids)  # one id of 400 rows
    got = {}
    for r in nn_graph.nearest_neighbours(table_of(spark, names, x), lambda i: i % 500 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {500, 1000, 1500, 2000, 2500} and all(len(found) == 5 for found in got.values())


def test_lists_of_a_shard():
    """Lists are sorted, without repeats or the node itself, and near the true ones."""
    small = nn_graph._unit(np.random.default_rng(2).standard_normal((1500, 24))).astype(np.float32)
    lists = nn_graph.descend(small, nn_graph._codes(small), 20)
    true = small.astype(float) @ small.T.astype(float)
    np.fill_diagonal(true, -9)
    best = np.argsort(-true, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(best, lists.others, strict=True)]) >= 0.9 * 20
    assert (np.diff(lists.near, axis=1) <= 0).all() and all(len(set(r)) == 20 and i not in r for i, r in enumerate(lists.others.tolist()))


def brute(docs, k, share):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    ids, joined = sorted(sets), circulant.Joiner()
    for i in ids:
        joined.find(i)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n * share[1] >= share[0] * (len(sets[a]) + len(sets[b]) - n):
                    joined.join(a, b)
    return {i: (len(sets[i]), joined.find(i)) for i in ids}


def corpus(n=260, seed=4):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(n):
        kind, body = i % 4, list(base)
        if kind == 0:
            body = [word() for _ in range(60)]
        elif kind == 1:  # near copies, some nearer than others
            for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
                body[at] = word()
        elif kind == 2 and i > 8:
            body = docs[i - 4][1].split()[: 90 + i % 9]
        docs.append((i, " ".join(body)))
    return docs + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "Two Words"), (1004, "two words"), (1005, "two"), (1006, docs[1][1].upper())]


def test_links_equal_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, node string").repartition(5)
    for k, share, block in ((3, (85, 100), 256), (3, (85, 100), 20), (5, (80, 100), 20)):
        monkeypatch.setattr(circulant, "BLOCK_DOCS", block)  # small blocks: clusters of many blocks
        want = brute(docs, k, share)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in circulant.near_duplicates(df, k, share).collect()}
        assert got == want


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A b\tc d e f"), (3, "x y z"), (3, "p q r s t u v w")], "doc_id long, text string")
    got = sorted(map(tuple, circulant.near_duplicates(df, 3, (85, 100)).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (2, 4, 1, False), (2, 4, 1, False), (1, 4, 1, True), (3, 1, 3, True), (3, 6, 3, True)], key=str)
    assert circulant.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    texts = [" ".join(f"w{j}" for j in range(300)).encode(), " ".join(f"w{j}" for j in range(60, 300)).encode()]
    a, b = circulant.shingle_sets(texts, 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(np.mean(circulant.signature(a, 252) == circulant.signature(b, 252)) - true) < 0.1


def test_roots_equal_union_find(spark):
    rng = np.random.default_rng(8)
    star = [(5_000, int(x)) for x in rng.choice(9_000, 300, replace=False)]
    paths = [(10_000 + i, 10_001 + i) for i in range(200)] + [(int(a), int(b)) for a, b in zip(*(lambda p: (p, p[1:]))(20_000 + rng.permutation(300)), strict=False)]
    two = [(30_000 + 2 * i, 30_002 + 2 * i) for i in range(60)] + [(30_001 + 2 * i, 30_003 + 2 * i) for i in range(60)] + [(30_120, 30_121), (30_120, 30_120)]
    mixed = [tuple(map(int, x)) for x in 40_000 + rng.integers(0, 500, (450, 2))]
    edges = star + paths + two + mixed + [(-3, 7), (7, -3)]
    joined = circulant.Joiner()
    for a, b in edges:
        joined.join(a, b)
    want = {x: joined.find(x) for x in joined.up}
    got = {r.node: r.root for r in circulant.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items() if x != r}
    assert circulant.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_with_several_texts(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a, 0), (3, a, 0), (3, b, 1), (4, b, 2), (4, None, 2), (9, "x y z", 3), (9, "x y z", 4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, node int").repartition(3)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in circulant.near_duplicates(df, 3, (85, 100)).collect())
        assert got == [(1, 6, 1, True), (3, 6, 1, False), (3, 6, 1, False), (4, 0, 4, True), (4, 6, 1, False), (9, 1, 9, True), (9, 1, 9, True)]
