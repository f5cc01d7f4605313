"""Approximate nearest neighbours by cosine: NN-descent graphs of the nodes' shards, searched greedily.

Vectors of equal direction (to 12 digits of the largest component) form one node, named by a hash of it, so a very
common vector is one node however many rows have it, at whatever scale; up to ``k + 1`` of its smallest ids are kept, which is all that a list of k neighbours can show.

Shards: a hash of the node deals the nodes out, at most about ``SHARD`` to one; a shard's vectors are sent once, and no pair of nodes
goes through a shuffle. Every query is searched in every shard, and a window keeps the nearest of what the shards found.

Build, in the task that has the shard: nodes are sorted by the signs of random projections, a few times over, and every
node takes its nearest ones in its block of that order. Then, in rounds, each node introduces its neighbours (by forward
and backward edges, the backward ones bounded by ``REVERSE`` random ones) to each other, and what beats a neighbour's
own list goes to it. An edge is new in the round after it was found; only pairs with a new edge are measured. Rounds end when few lists change,
however many it takes. Vectors are unit vectors in single precision, and ``near`` is half the squared
distance with a minus, summed in double precision: it tells near copies apart where their cosines all round to 1.

Recall: a fixed sample of the queries is also measured against all vectors. While the search of a shard finds less than
``RECALL`` of those of the sample's true neighbours that the shard has, its beam is doubled, and its lists too once the beam is
32 times as long. The sample sets these two lengths only; all queries are searched in the same way.

Search: a beam of the ``beam`` best nodes seen so far; each step expands the best few of those not expanded yet, until none is left.
It starts at the nodes beside the query in each of the sorted orders, where near copies of it stand. The beam that remains
is measured on the original vectors in double precision. Cosines equal to 14 digits are ties, of which the smallest id comes first.

Rows: vectors that are null, zero, of another length than most or hold a null or a non-finite component take no
part, neither as query nor as candidate; so do null ids. All usable rows that repeat an id are candidates of
other queries, which list the id once, by its nearest row; as a query the first of them in vector order stands for the id, and no row of its own id is a neighbour of a query (a
reading of "every row but its own" for ids that repeat). Fewer candidates than k give shorter lists; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.scratch import write_table

NEIGHBOURS = 20
REVERSE = 20
#: Edges that lead back from a node in the search: so many, or twice the lists' length.
BACK = 40
BLOCK = 96
PLANTINGS = 8
#: Nodes beside a query in each planting at which its search starts.
ENTRIES = 32
#: Rounds end when fewer than this share of all list places changed.
SETTLED = 0.005
BEAM = 64
#: So many nodes of the beam are expanded in one step.
STEP = 16
#: The share of true neighbours that the search must find for a fixed sample of queries, and the sample's size.
RECALL = 0.95
SAMPLE = 200
#: Nodes of a shard at most; small tables are dealt to up to SPREAD shards of LEAST nodes, so that several tasks work.
SHARD, SPREAD, LEAST = 32_768, 24, 4096
#: Queries that one task searches in its shard, about.
PART = 16_384
#: Below every ``near``.
NOTHING = -9.0


def _direction(v: Column) -> Column:
    """The vector over its largest component, to 12 digits: a key that rescaled copies share."""
    most = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: F.rint(x / most * F.lit(1e12)).cast("long"))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def nodes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 6) -> DataFrame:
    """``node, vector, ids, direction``: the usable vectors of distinct direction, with the ``keep`` smallest ids of each."""
    rows = _usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))
    rows = rows.withColumn("direction", _direction(F.col("vector")))
    # Ids of a vector are first bounded within slices of the ids, so a very common vector meets in no task.
    near = Window.partitionBy("direction", "slice").orderBy("id")
    sliced = rows.groupBy("direction", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slice"), "id").agg(F.min("vector").alias("vector"))
    sliced = sliced.withColumn("r", F.row_number().over(near)).where(F.col("r") <= keep)
    grouped = sliced.groupBy("direction").agg(F.min_by("vector", "id").alias("vector"), F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    # A node's name is its direction's: ids that repeat with other vectors stand in several nodes.
    return grouped.select(F.xxhash64("direction").alias("node"), "vector", "ids", "direction")


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length; first scaled by the largest component, so that no square overflows."""
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _ragged(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A list or binary column as its values and the lengths of its rows."""
    rows = column.to_pylist()
    if dtype is None:
        lengths = np.array([len(r) for r in rows], np.int64)
        return np.array([x for r in rows for x in r], np.int64), lengths
    return np.frombuffer(b"".join(rows), dtype), np.array([len(r) // np.dtype(dtype).itemsize for r in rows], np.int64)


def _padded(rows: np.ndarray, values: np.ndarray, n: int, most: int | None = None) -> np.ndarray:
    """A matrix of n rows with the values of each, -1 beyond them. ``rows``: sorted."""
    count = np.bincount(rows, minlength=n)
    place = np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
    width = int(count.max(initial=0)) if most is None else min(most, int(count.max(initial=0)))
    out, kept = np.full((n, width), -1, np.int32), place < width
    out[rows[kept], place[kept]] = values[kept]
    return out


def _codes(unit: np.ndarray) -> np.ndarray:
    """62 sign bits of random projections for each planting: a row a planting."""
    planes = np.random.default_rng(7).standard_normal((unit.shape[1], PLANTINGS * 62))
    bits = (unit @ planes > 0).reshape(len(unit), PLANTINGS, 62).astype(np.int64)
    return (bits @ (1 << np.arange(62, dtype=np.int64))).T


class Lists:
    """The k nearest others known of each node of a shard, nearest first, and which of them are new."""

    def __init__(self, small: np.ndarray, k: int):
        self.small, k = small, min(k, len(small) - 1)
        self.others, self.near = np.full((len(small), k), -1, np.int32), np.full((len(small), k), NOTHING, np.float32)
        self.fresh = np.zeros((len(small), k), bool)

    def introduce(self, members: np.ndarray, fresh: np.ndarray) -> None:
        """Measure the pairs in each row of ``members`` (-1: none) of which one is fresh; what beats a list enters it."""
        width, held, n = members.shape[1], [], 0
        for x in range(0, len(members), step := max(1, 1_000_000 // width**2)):
            m, f = members[x : x + step], fresh[x : x + step]
            unit = self.small[m].astype(np.float64)
            near = unit @ unit.transpose(0, 2, 1)
            square = np.einsum("gii->gi", near) / 2
            near = np.minimum(near - square[:, :, None] - square[:, None, :], 0).astype(np.float32)
            near[~(f[:, :, None] | f[:, None, :]) | (m[:, :, None] == m[:, None, :])] = NOTHING
            floor = self.near[:, -1][m]
            floor[m < 0] = 1
            near.transpose(0, 2, 1)[m < 0] = NOTHING
            g, i, j = np.nonzero(near > floor[:, :, None])
            held.append((m[g, i], m[g, j], near[g, i, j]))
            n += len(g)
            if n > 3_000_000:
                self._enter(held)
                held, n = [], 0
        self._enter(held)

    def _enter(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        a, b, s = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int32),) * 3
        if not len(a):
            return
        at = np.unique(a)
        k = self.near.shape[1]
        a, b, s = np.concatenate([np.repeat(at, k), a]), np.concatenate([self.others[at].ravel(), b]), np.concatenate([self.near[at].ravel(), s])
        # By node and nearness in one word: bits of floats from 0 on are in their order.
        order = np.argsort(a.astype(np.uint64) << np.uint64(32) | (-s + np.float32(0)).view(np.uint32), kind="stable")
        a, b, s = a[order], b[order], s[order]
        once = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) & (b >= 0))
        a, b, s = a[once], b[once], s[once]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))
        a, b, s, rank = (x[rank < k] for x in (a, b, s, rank))
        old, was = self.others[at], self.fresh[at]
        self.others[at], self.near[at] = -1, NOTHING
        self.others[a, rank], self.near[a, rank] = b, s
        for x in range(0, len(at), step := max(1, 10_000_000 // k**2)):
            part = slice(x, x + step)
            new = self.others[at[part]]
            same = new[:, :, None] == old[part, None, :]
            self.fresh[at[part]] = (new >= 0) & (~same.any(2) | (same & was[part, None, :]).any(2))

    def round(self, seed: int) -> int:
        """Each node introduces its neighbours to each other; how many places have changed."""
        i, p = np.nonzero(self.others >= 0)
        j, f = self.others[i, p], self.fresh[i, p]
        mixed = np.random.default_rng(seed).permutation(len(i))
        order = mixed[np.argsort(j[mixed], kind="stable")]
        back = _padded(j[order], i[order] * 2 + ~f[order], len(self.others), max(REVERSE, self.others.shape[1]))
        both = np.concatenate([np.where(self.others < 0, -1, self.others * 2 + ~self.fresh), back], 1)
        both.sort(axis=1)
        members, fresh = both >> 1, (both >= 0) & (both & 1 == 0)
        # Who stands in both lists is kept once, as fresh if it is so in one.
        members[:, 1:][members[:, 1:] == members[:, :-1].copy()] = -1
        fresh &= members >= 0
        rows = fresh.any(1)
        self.fresh[:] = False
        self.introduce(members[rows], fresh[rows])
        return int(self.fresh.sum())


def descend(small: np.ndarray, codes: np.ndarray, k: int, lists: Lists | None = None) -> Lists:
    """About the k nearest others of each node, from blocks of each planting's order and the shorter ``lists``, if there are some."""
    out, n = Lists(small, k), len(small)
    k = out.near.shape[1]
    if not k:
        return out
    for code in codes:
        order = np.argsort(code, kind="stable")
        blocks = np.concatenate([order, np.full(-n % BLOCK, -1)]).reshape(-1, BLOCK).astype(np.int32)
        out.introduce(blocks, blocks >= 0)
    if lists is not None:
        i, p = np.nonzero(lists.others >= 0)
        out._enter([(i.astype(np.int32), lists.others[i, p], lists.near[i, p])])
    seed = 0
    while out.round(seed) > SETTLED * k * n:
        seed += 1
    return out


def edges_of(lists: Lists) -> np.ndarray:
    """The edges walked from each node: its list, and of the edges that lead back from it the nearest ones; -1: none."""
    i, p = np.nonzero(lists.others >= 0)
    j = lists.others[i, p]
    order = np.lexsort((-lists.near[i, p], j))
    back = _padded(j[order], i[order], len(lists.others), max(BACK, 2 * lists.others.shape[1]))
    both = np.sort(np.concatenate([lists.others, back], 1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1].copy()] = -1
    i, p = np.nonzero(both >= 0)
    return _padded(i, both[i, p], len(both))


class Shard:
    """Nodes, vectors and edges of one shard, to be searched."""

    def __init__(self, node: np.ndarray, unit: np.ndarray, codes: np.ndarray, edges: np.ndarray):
        self.node, self.unit, self.small, self.edges = node, unit, unit.astype(np.float32), edges
        self.orders = [(order := np.argsort(c, kind="stable").astype(np.int32), c[order]) for c in codes]

    def own(self, query: np.ndarray) -> np.ndarray:
        """The places of the queries' own nodes; -1: in another shard. ``node`` is sorted."""
        at = np.minimum(np.searchsorted(self.node, query), len(self.node) - 1)
        return np.where(self.node[at] == query, at, -1)

    def starts(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beside, n = [own[:, None]], len(self.node)
        for code, (order, sorted_codes) in zip(_codes(unit), self.orders, strict=True):
            at = np.searchsorted(sorted_codes, code)[:, None] + np.arange(-(ENTRIES // 2), ENTRIES // 2)
            beside.append(np.where((at >= 0) & (at < n), order[np.clip(at, 0, n - 1)], -1))
        beside = np.concatenate(beside, 1)
        q, p = np.nonzero(beside >= 0)
        return q, beside[q, p]

    def search(self, query: np.ndarray, unit: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the places of the ``beam`` nearest nodes seen (-1: none), and their cosines. ``unit``: the queries' vectors.

        A beam that has room for all nodes gets all, also those to which no edge leads.
        """
        n, m, small = len(self.node), len(query), unit.astype(np.float32)
        beam = min(beam, n)
        top, near = np.full((m, beam), -1, np.int32), np.full((m, beam), np.float32(NOTHING))
        ahead, seen = np.zeros((m, beam), bool), np.full(m * n, -1, np.int32)
        q, at = self.starts(unit, self.own(query)) if beam < n else np.divmod(np.arange(m * n), n)
        while len(q):
            # What was not seen before, once: of equal ones that which has left its mark.
            flat = q * n + at
            new = np.flatnonzero(seen[flat] < 0)
            seen[flat[new]] = new
            new = new[seen[flat[new]] == new]
            q, at = q[new], at[new]
            away = self.small[at] - small[q]
            s = np.einsum("ij,ij->i", away, away) * np.float32(-0.5)
            better = s > near.min(1)[q]
            q, at, s = q[better], at[better], s[better]
            # Rows that get something: their beam and that, of which the best stay.
            rows, place = np.unique(q, return_inverse=True)
            if len(rows):
                more = _padded(place, at, len(rows))
                more_near = np.full(more.shape, np.float32(NOTHING))
                more_near[more >= 0] = s
                all_near = np.concatenate([near[rows], more_near], 1)
                best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
                near[rows] = np.take_along_axis(all_near, best, 1)
                top[rows] = np.take_along_axis(np.concatenate([top[rows], more], 1), best, 1)
                ahead[rows] = np.take_along_axis(np.concatenate([ahead[rows], more >= 0], 1), best, 1)
            rows = np.flatnonzero(ahead.any(1))
            step = min(STEP, beam)
            nearest = np.argpartition(-np.where(ahead[rows], near[rows], np.float32(NOTHING)), step - 1, axis=1)[:, :step]
            r, p = np.nonzero(np.take_along_axis(ahead[rows], nearest, 1))
            q, p = rows[r], nearest[r, p]
            ahead[q, p] = False
            to = self.edges[top[q, p]]
            i, p = np.nonzero(to >= 0)
            q, at = q[i], to[i, p].astype(np.int64)
        cosine = np.stack([(self.unit[row] * one).sum(1) for row, one in zip(top, unit, strict=True)])
        cosine[top < 0] = NOTHING
        return top, cosine

    def searched(self, query: np.ndarray, unit: np.ndarray, beam: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """``search`` for so many queries at a time that the marks of what they have seen stay few."""
        for x in range(0, len(query), 64):
            part = slice(x, min(len(query), x + 64))
            yield part, *self.search(query[part], unit[part], beam)

    def recall(self, query: np.ndarray, unit: np.ndarray, least: np.ndarray, beam: int, k: int) -> float:
        """The share that the search finds of the shard's nodes, but the query's own, with cosines from ``least`` on: up to k for each query."""
        hits = places = 0
        for part, top, cosine in self.searched(query, unit, beam):
            own, floor = self.own(query[part]), least[part, None] - 1e-12
            true = unit[part] @ self.unit.T
            true[np.flatnonzero(own >= 0), own[own >= 0]] = NOTHING
            there = np.minimum((true >= floor).sum(1), k)
            found = ((top >= 0) & (top != own[:, None]) & (cosine >= floor)).sum(1)
            hits, places = hits + np.minimum(found, there).sum(), places + there.sum()
        return hits / places if places else 1.0


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors, a row each, of a list column of equal lengths."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return _unit(flat.to_numpy().reshape(len(column), -1))


def shards_for(n: int) -> int:
    return max(1, -(-n // SHARD), min(SPREAD, n // LEAST))


def _least_scores(nodes: DataFrame, asked: np.ndarray, asked_unit: np.ndarray, k: int) -> np.ndarray:
    """For each of a bounded sample of queries the cosine of its k-th nearest other node, or of the last there is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(asked), 0))
        for batch in it:
            if batch.num_rows:
                near = asked_unit @ _matrix(batch.column("vector")).T
                near[asked[:, None] == batch.column("node").to_numpy()] = NOTHING
                best = -np.sort(-np.concatenate([best, near], 1), axis=1)[:, :k]
        q, p = np.nonzero(best > NOTHING)
        yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(best[q, p])], names=["query", "score"])

    found = nodes.select("node", "vector").mapInArrow(run, "query long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    least = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query").agg(F.min("score").alias("least"))
    known = {r["query"]: r["least"] for r in least.collect()}  # one row for each query of the sample
    return np.array([known.get(int(q), 1.0) for q in asked])


def build_index(nodes: DataFrame, shards: int, sample: list, k: int) -> DataFrame:
    """``shard, node, vector, ids, edges, beam``: every node with its edges, as places in its shard's sorted nodes.

    ``sample``: rows of query and vector, by whose k nearest nodes each shard chooses the lengths of its lists and of its beam.
    """
    asked = np.array([r["query"] for r in sample], np.int64)
    asked_unit = _unit(np.array([r["vector"] for r in sample], np.float64)) if sample else None
    least = _least_scores(nodes, asked, asked_unit, k) if sample else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("node")
        unit = _matrix(table["vector"])
        codes, lists, beam = _codes(unit), NEIGHBOURS, max(BEAM, 2 * (k + 1))
        found = descend(unit.astype(np.float32), codes, lists)
        while True:
            shard = Shard(table["node"].to_numpy(), unit, codes, edges_of(found))
            if asked_unit is None or beam >= len(unit) or shard.recall(asked, asked_unit, least, beam, k) >= RECALL:
                break
            if beam >= 32 * lists:
                lists *= 2
                found = descend(unit.astype(np.float32), codes, lists, found)
            beam *= 2
        edges = pa.array([r[r >= 0].tobytes() for r in shard.edges], pa.binary())
        out = table.append_column("edges", edges).append_column("beam", pa.array(np.full(len(table), beam, np.int32)))
        yield from out.to_batches(max_chunksize=4096)

    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "vector", "ids")
    return dealt.repartitionById(shards, F.col("shard")).mapInArrow(run, "shard int, node long, vector array<double>, ids array<long>, edges binary, beam int")


def search(index: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """``query, vec_id, score``: for each of ``queries`` (query, vector) and shard the k nearest ids, ties in the k-th place to the smallest."""

    def nearest(shard: Shard, ids: tuple[np.ndarray, np.ndarray], beam: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query, unit = batch.column("query").to_numpy(), _matrix(batch.column("vector"))
        values, lengths = ids
        first = np.cumsum(lengths) - lengths
        for part, top, cosine in shard.searched(query, unit, beam):
            q, p = np.nonzero(top >= 0)
            at, s = top[q, p], cosine[q, p]
            many = lengths[at]
            own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            q, s, vec = np.repeat(q, many), np.repeat(s, many), values[np.repeat(first[at], many) + own]
            # An id once, by its nearest row; then the first k of each query.
            order = np.lexsort((-s, vec, q))
            q, s, vec = q[order], s[order], vec[order]
            once = np.concatenate([[True], (q[1:] != q[:-1]) | (vec[1:] != vec[:-1])])[: len(q)]
            q, s, vec = q[once], s[once], vec[once]
            order = np.lexsort((vec, -np.round(s, 14), q))
            q, s, vec = q[order], s[order], vec[order]
            count = np.bincount(q, minlength=part.stop - part.start)
            kept = np.arange(len(q)) - (np.cumsum(count) - count)[q] < k
            yield pa.RecordBatch.from_arrays([pa.array(query[part][q[kept]]), pa.array(vec[kept]), pa.array(s[kept])], names=["query", "vec_id", "score"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, ids, beam = [], None, None, 0
        for batch in it:
            nodes = batch.num_rows - batch.column("node").null_count  # they come first, the queries after them
            if nodes:
                held.append(batch.slice(0, nodes))
            if nodes < batch.num_rows and held:
                table, held = pa.Table.from_batches(held), []
                unit = _matrix(table["vector"])
                edges, count = _ragged(table["edges"], np.int32)
                ids, beam = _ragged(table["ids"], None), table["beam"][0].as_py()
                shard = Shard(table["node"].to_numpy(), unit, _codes(unit), _padded(np.repeat(np.arange(len(unit)), count), edges, len(unit)))
            if nodes < batch.num_rows and shard is not None:
                yield from nearest(shard, ids, beam, batch.slice(nodes))

    parts = max(1, -(-queries.count() // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.withColumn("part", every(parts)).withColumn("query", F.lit(None).cast("long"))
    asking = queries.select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part")).withColumn("shard", every(shards))
    both = held.unionByName(asking, allowMissingColumns=True).withColumn("task", F.col("shard") * F.lit(parts) + F.col("part"))
    dealt = both.repartitionById(shards * parts, F.col("task")).sortWithinPartitions(F.asc_nulls_last("node"), "query")
    return dealt.select("node", "query", "vector", "ids", "edges", "beam").mapInArrow(run, "query long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` where ``is_query(id)`` holds, against all others.

    Queries with one vector are searched once; each then leaves out its own row only.
    """
    nodes = write_table(nodes_of(vectors, id_col, vector_col, k + 1), "nodes")
    asking = _usable(vectors.where(is_query(F.col(id_col).cast("long"))), id_col, vector_col).withColumn("direction", _direction(F.col("vector")))
    members = write_table(asking.join(nodes.select("node", "direction"), "direction").groupBy("id").agg(F.min_by("node", "vector").alias("node")), "members")
    asked = write_table(nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vector"), "queries")
    shards = shards_for(nodes.count())
    sample = asked.orderBy(F.xxhash64("query"), "query").limit(SAMPLE).collect()
    index = write_table(build_index(nodes, shards, sample, k), "index")
    found = write_table(search(index, shards, asked, k + 1), "found")
    every = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 14)), "vec_id")
    lists = every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    lists = write_table(lists, "lists")
    own = members.join(lists, F.col("node") == F.col("query")).select("id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("list"))
    out = own.select(F.col("id").alias("query_id"), F.posexplode("list").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
