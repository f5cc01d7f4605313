"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the distinct k-word shingles of its text, A-Z lower-cased, as 64-bit hashes; with fewer
than k words the whole sequence is the one shingle. Two permutations give the whole signature: the first sends
a shingle to a position on a circle of ``CIRCLE`` places, the second orders the places, and coordinate i uses
the second shifted by i. So the coordinates of one shingle lie side by side in a table and a signature is the
minimum over rows of a sliding window.

Steps, each a Spark job over written tables in the shared folder:

1. ``signatures``: one pass over the texts. Equal sets share a node; only one row of a node goes on.
2. ``candidates``: (band, node) rows are range-sorted by both, so a frequent band is spread over tasks. A task
   joins equal neighbours in a union-find and gives one edge for each member of its components, to the smallest
   one; the ends of neighbouring ranges are joined as well. ``roots`` contracts these edges.
3. ``verify``: candidate clusters meet in blocks of at most about ``BLOCK_DOCS`` texts, where exact
   intersections of all pairs not yet joined are counted. Clusters of several blocks are dealt once more by another
   hash, which joins what belongs together, and then each document outside the largest component is held
   against all blocks. No pair of a cluster stays unchecked, and no task gets more than two blocks.
4. ``roots`` of the confirmed links, each component named by its smallest ``doc_id``.

Rows: null, empty and blank texts have an empty set and are linked with nothing; a null ``doc_id`` is linked
with nothing either and has a null component; rows that repeat an id are one document, so what any of them is
linked with is one component, which all of them (but those of an empty set) share; a very long text is one set
like any other; an empty table gives no rows; other columns are not looked at. Sets are named by 64-bit hashes: two different
ones share a name, and so a group, with a chance of n^2 / 2^65 for n sets (0.03 for 10^9, a few pairs for 10^10).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.bloom import Bloom
from waymark.llm.pretokens import batches
from waymark.llm.scratch import write_table

CIRCLE = 1 << 20
ROWS, BANDS = 7, 36
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _byte_keys() -> tuple[np.ndarray, np.ndarray]:
    keys = _stream(11, 256)
    keys[65:91] = keys[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return keys, space


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.ones(1, np.uint64)
        while len(a) < 1 << bits:
            a = np.concatenate([a, a * np.uint64(pow(b, len(a), 1 << 64))])
        out.append(a)
    return out[0], out[1]


@lru_cache(maxsize=2)
def _windows(coordinates: int) -> np.ndarray:
    """Row p: the values of a shingle at place p under the second permutation and its circular shifts."""
    order = np.argsort(_stream(23, CIRCLE), kind="stable").astype(np.uint32)
    around = np.concatenate([order, order[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(around, coordinates)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    keys, space = _byte_keys()
    with np.errstate(over="ignore"):
        buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        power, inverse = _powers(max(20, len(buffer).bit_length()))
        blank = space[buffer]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        running = np.cumsum(keys[buffer] * power[: len(buffer)], dtype=np.uint64)
        low = np.where(starts > 0, running[starts - 1], np.uint64(0)) if len(starts) else np.zeros(0, np.uint64)
        word = mix((running[ends - 1] - low) * inverse[starts]) if len(starts) else low
        rolled = word.copy()
        for j in range(1, k):
            n = max(0, len(word) - j)
            rolled[:n] = mix(rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + word[j : j + n])
        at = np.searchsorted(starts, bounds)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:  # a short sequence: its words in order, and how many they are
                h = np.array([b - a], np.uint64)
                for w in word[a:b]:
                    h = mix(h * np.uint64(0xD1B54A32D192ED03) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash of a set that is not empty."""
    windows = _windows(coordinates)
    places = (mix(hashes) >> np.uint64(44)).astype(np.int64)
    least = windows[places[:1024]].min(0)
    for k in range(1024, len(places), 1024):
        least = np.minimum(least, windows[places[k : k + 1024]].min(0))
    return least


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    n, coordinates = signatures.shape
    bands = signatures.reshape(n, coordinates // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_stream(31, coordinates // rows), bands.shape[:2]).copy()
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key.view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, k: int, rows: int = ROWS, bands: int = BANDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text_key, n_shingles, node, keys``; node and keys are null for an empty set or a null id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], k)
                live = [j for j, s in enumerate(sets) if len(s) and ids[a + j] is not None]
                keys = band_keys(np.stack([signature(sets[j], rows * bands) for j in live]), rows).tolist() if live else []
                node, key = [None] * len(sets), [None] * len(sets)
                for j, v in zip(live, keys, strict=True):
                    node[j], key[j] = node_of(sets[j]), v
                cols = [batch.column(0)[a:b], batch.column(2)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(key, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n_shingles", "node", "keys"])

    return _texts(docs, text_col, id_col).mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, keys array<long>")


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``doc_id, text, text_key``: the two that name a row's text, whatever rows repeat its id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


class Joiner:
    """Union-find over hashable names; the smallest name is a component's root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> Iterator[tuple]:
        """One edge for each member of a component, to its root."""
        for x in list(self.up):
            if (r := self.find(x)) != x:
                yield x, r


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join nodes with an equal band key, from ``node, keys``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, joined, ends = TaskContext.get().partitionId(), Joiner(), []
        last_key = last_node = None
        for batch in it:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last_key is None:
                ends.append((int(key[0]), int(node[0])))
            elif last_key == key[0]:
                joined.join(last_node, int(node[0]))
            same = np.flatnonzero(key[1:] == key[:-1])
            for a, b in zip(node[same].tolist(), node[same + 1].tolist(), strict=True):
                joined.join(a, b)
            last_key, last_node = int(key[-1]), int(node[-1])
        if last_key is not None:
            ends.append((last_key, last_node))
        rows = [(a, b, None, None) for a, b in joined.stars()] + [(n, None, k, 2 * part + j) for j, (k, n) in enumerate(ends)]
        for s in range(0, len(rows), 10_000):
            cols = zip(*rows[s : s + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "key", "place"])

    keys = nodes.select(F.explode("keys").alias("key"), "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = write_table(keys.mapInArrow(run, "a long, b long, key long, place long"), "edges")
    # Two rows for each range: a run of one key that the ranges cut is joined at the cuts.
    in_order = Window.orderBy("place")
    cuts = found.where("place is not null").select("a", F.lag("a").over(in_order).alias("b"), (F.lag("key").over(in_order) == F.col("key")).alias("same"))
    return found.where("place is null").select("a", "b").unionAll(cuts.where("same and a <> b").select("a", "b"))


def _jump(parents: DataFrame) -> DataFrame:
    """``node, root`` from ``node, root`` where a root may itself be a node: the distance to go halves each round."""
    now = parents
    while True:
        on = now.select(F.col("node").alias("at"), F.col("root").alias("next"))
        moved = now.join(on, F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("root"), F.col("at").isNotNull().alias("moved"))
        moved = write_table(moved, "jump")
        if moved.where("moved").isEmpty():
            return now
        now = moved.select("node", "root")


def _between(pairs: DataFrame) -> DataFrame:
    """Distinct edges ``a, b`` with a > b from pairs ``x, y``."""
    return pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node reaches along ``edges`` (a, b); roots themselves are left out.

    Contraction: every node goes to its smallest lower neighbour, and these steps are followed to their ends. Its
    other lower neighbours are then joined with that one, named by their ends; only these edges, mostly equal to each
    other or loops, go on to the next round. Node names are hashes, so what is left falls geometrically.
    """
    left, found = write_table(_between(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))), "edges"), None
    while True:
        lower = write_table(left.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")), "lower")
        other = left.join(lower.where("least < most"), "a").where("b > least").select(F.col("b").alias("x"), F.col("least").alias("y")).distinct()
        ends = _jump(lower.select(F.col("a").alias("node"), F.col("least").alias("root")))
        for c in ("x", "y"):
            named = ends.select(F.col("node").alias("at"), F.col("root").alias("end"))
            other = other.join(named, F.col(c) == F.col("at"), "left").withColumn(c, F.coalesce("end", c)).drop("at", "end")
        left = write_table(_between(other), "edges")
        if found is None:
            found = ends
        else:
            on = ends.select(F.col("node").alias("at"), F.col("root").alias("next"))
            further = found.join(on, F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("root"))
            found = write_table(further.unionAll(ends), "found")  # a node of a later round is a root of the earlier ones
        if left.isEmpty():
            return found


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, label`` of all ``nodes`` (node): the smallest node that each reaches along ``edges``."""
    found = roots(edges).select(F.col("node").alias("at"), "root")
    return write_table(nodes.join(found, F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("label")), "labels")


def links_in_block(sets: list[np.ndarray], comps: list, left: np.ndarray, right: np.ndarray, share: tuple[int, int]) -> Joiner:
    """Join ``comps`` across all pairs of a left and a right member whose sets are similar enough."""
    joined = Joiner()
    for c in comps:
        joined.find(c)
    sizes = np.array([len(s) for s in sets], np.int64)
    rights = np.flatnonzero(right)
    universe, codes = np.unique(np.concatenate([sets[j] for j in rights]), return_inverse=True) if len(rights) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    starts = np.cumsum(sizes[rights]) - sizes[rights]
    of_right = dict(zip(rights.tolist(), starts.tolist(), strict=True))
    flag = np.zeros(len(universe), bool)
    for i in np.flatnonzero(left).tolist():
        if i in of_right:
            mine = codes[of_right[i] : of_right[i] + sizes[i]]
        else:
            at = np.minimum(np.searchsorted(universe, sets[i]), len(universe) - 1)
            mine = at[universe[at] == sets[i]] if len(universe) else at
        flag[mine] = True
        common = np.add.reduceat(flag[codes], starts) if len(codes) else np.zeros(0, np.int64)
        flag[mine] = False
        union = sizes[i] + sizes[rights] - common
        for j in rights[common * share[1] >= share[0] * union].tolist():
            joined.join(comps[i], comps[j])
    return joined


def _check_blocks(rows: DataFrame, by: list[str], k: int, share: tuple[int, int]) -> DataFrame:
    """Confirmed links ``a, b`` (component names) from groups of ``node, comp, text, is_left, is_right``."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets([bytes(t) for t in pdf["text"]], k)
        keep, seen = [], {}
        left, right = pdf["is_left"].to_numpy(bool).copy(), pdf["is_right"].to_numpy(bool).copy()
        for j, n in enumerate(pdf["node"].tolist()):
            if n in seen:
                left[seen[n]] |= left[j]
                right[seen[n]] |= right[j]
            else:
                seen[n] = j
                keep.append(j)
        comps = pdf["comp"].tolist()
        joined = links_in_block([sets[j] for j in keep], [comps[j] for j in keep], left[keep], right[keep], share)
        return pd.DataFrame(list(joined.stars()), columns=["a", "b"], dtype="int64")

    return rows.groupBy(*by).applyInPandas(run, "a long, b long")


def verify(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, k: int, share: tuple[int, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Confirmed links ``a, b`` between nodes. ``nodes``: node, rep, rep_key, n_shingles; ``clusters``: node, label."""
    members = clusters.join(nodes.select("node", "rep", "rep_key", "n_shingles"), "node")
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    large = write_table(sizes.where("blocks > 1"), "large")
    dealt = write_table(members.join(large, "label", "left").select("label", "node", "rep", "rep_key", F.coalesce("blocks", F.lit(1)).alias("blocks")), "members")
    texts = _texts(docs, text_col, id_col).withColumnsRenamed({"doc_id": "rep", "text_key": "rep_key"})
    # Only texts that may be on the list are shuffled; most are not. A merge join at every size: the list of
    # representatives grows with the input, so it is never broadcast.
    texts = texts.where(Bloom(dealt, ["rep", "rep_key"]).maybe("rep", "rep_key"))
    # Rows that repeat both id and text become one before they meet their node.
    texts = texts.join(dealt.select("rep", "rep_key").hint("merge"), ["rep", "rep_key"], "left_semi").groupBy("rep", "rep_key").agg(F.first("text").alias("text"))
    held = write_table(dealt.join(texts, ["rep", "rep_key"]).drop("rep", "rep_key"), "texts")
    whole = [F.lit(True).alias("is_left"), F.lit(True).alias("is_right")]

    def block(salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).alias(f"block{salt}")

    first = write_table(_check_blocks(held.select("label", block(1), "node", F.col("node").alias("comp"), "text", *whole), ["label", "block1"], k, share), "links")
    big = held.where("blocks > 1")
    if big.isEmpty():
        return first
    comps = components(first, big.select("node").distinct())
    named = write_table(big.join(comps.select("node", F.col("label").alias("comp")), "node"), "named")
    second = write_table(_check_blocks(named.select("label", block(2), "node", "comp", "text", *whole), ["label", "block2"], k, share), "links")
    merged = components(second, comps.select(F.col("label").alias("node")).distinct())
    named = write_table(named.join(merged.select(F.col("node").alias("comp"), F.col("label").alias("now")), "comp").drop("comp"), "named")
    counts = named.groupBy("label", "now").agg(F.countDistinct("node").alias("n"), F.max("blocks").alias("blocks"))
    per = counts.groupBy("label").agg(F.max(F.struct("n", "now"))["now"].alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    per = write_table(per.where("outside > 0").withColumn("outer_blocks", F.ceil(F.col("outside") / BLOCK_DOCS)), "outside")
    rows = named.join(per, "label")
    outer = F.pmod(F.xxhash64("node", F.lit(3)), F.col("outer_blocks"))
    lefts = rows.where("now <> main").select(
        "label", outer.alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "node", F.col("now").alias("comp"), "text", F.lit(True).alias("is_left"), F.lit(False).alias("is_right")
    )
    rights = rows.select(
        "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer_blocks") - 1)).alias("o"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("j"), "node", F.col("now").alias("comp"), "text", F.lit(False).alias("is_left"), F.lit(True).alias("is_right")
    )
    third = write_table(_check_blocks(lefts.unionAll(rights), ["label", "o", "j"], k, share), "links")
    return first.unionAll(second).unionAll(third)


def near_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), rows: int = ROWS, bands: int = BANDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``share``: linked if intersection / union is at least this fraction, compared in integers. With 36 bands of 7
    rows two sets of similarity 0.8 meet with probability 0.9998 (0.85: 0.999999), and sets of a candidate
    cluster are compared whether or not they met themselves.
    """
    marked = write_table(signatures(docs, k, rows, bands, text_col, id_col), "signatures")
    known = marked.where("node is not null")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    nodes = known.groupBy("node").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    nodes = write_table(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), "n_shingles", "keys", "copies"), "nodes")
    edges = write_table(candidates(nodes.select("node", "keys")), "candidates")
    clusters = components(edges, edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct())
    links = verify(docs, nodes, clusters, k, share, text_col, id_col)
    # The sets of rows that repeat an id belong to one document.
    repeated = known.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    same_id = known.join(repeated, "doc_id").where("node > b").select(F.col("node").alias("a"), "b")
    found = roots(links.unionAll(same_id)).select(F.col("node").alias("of"), "root")
    named = write_table(nodes.select("node", "rep", "copies").join(found, F.col("node") == F.col("of"), "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("nodes"))
    # One row for each node that is more than a single document; documents of one node may be very many.
    groups = write_table(named.join(least, "root").where("copies > 1 or nodes > 1").select(F.col("node").alias("of"), "component"), "groups")
    out = marked.select("doc_id", "n_shingles", "node").join(groups, F.col("node") == F.col("of"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
