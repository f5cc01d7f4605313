"""Prefix trie of conversations, built as a Patricia tree: sorted, with branch, end and leaf points only.

A turn is the first 16 bytes of SHA-256 of its role and text, and their length in bytes; texts aren't shuffled. Rows of a
conversation are numbered by buckets of 1024 turn numbers and gathered into blocks of ``BLOCK`` turns, so neither a task
nor a row holds a whole conversation. A block stands under the node that the blocks before it end at, and the blocks
under one node are a tree of their own; most conversations are one block under the root.

Equal conversations become one row with a count. The rows are sorted by range (block number, node, path of turn
digests), written in chunks of at most ``CHUNK`` rows with the length of the prefix that each shares with the row before,
and each chunk becomes a compressed tree by one pass with a stack: every branch point is the prefix that two neighbours
share. Which points of a chunk's first and last path come from other chunks follows from a pass over summaries of chunks
(shared lengths only) in either direction; with these, a chunk knows the final edges of all its points, and counts,
smallest ids, leaves and saved bytes of a point that several chunks see are just added up. What lies in later
blocks of long conversations is added to the points of their earlier ones by suffix sums. At last each edge is expanded to
its unary nodes; what they save follows from suffix sums of the bytes along the edge.

Rows: those without a conversation id take no part; a null role or text is empty; turns go by number, null first, equal
numbers by digest; repeated rows are turns of their own; other columns are not looked at; an empty table has no nodes. Two
different turns or prefixes are taken for one if 128 bits of SHA-256 agree (for 10^12 turns a chance below 10^-14).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.scratch import write_table

#: Turns of a block, rows of a chunk, turn numbers that are numbered together (as a power of two), bytes of a digest.
BLOCK, CHUNK, BUCKET_BITS, WIDTH = 256, 4096, 10, 16
ROOT = bytes(WIDTH)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _short(col: Column) -> Column:
    return F.substring(F.unhex(F.sha2(col, 256)), 1, WIDTH)


def _python_short(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:WIDTH]


def _root() -> Column:
    return F.unhex(F.lit(ROOT.hex()))


def number_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, i`` (from 1)``, digest, n_bytes`` for the turns of each conversation, written to the shared folder."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    digest = _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.shiftright(turn, BUCKET_BITS), F.lit(-(1 << 62))).alias("bucket"), digest.alias("digest"), F.octet_length(text).alias("n_bytes")
    )
    k = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(F.asc_nulls_first("turn"), "digest"))
    rows = write_table(rows.select("conv_id", "bucket", k.cast("long").alias("k"), "digest", "n_bytes"), "turns")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # Only what a bucket's rows lack: conversations of one bucket, nearly all, have no row here.
    sizes = rows.groupBy("conv_id", "bucket").agg(F.max("k").alias("n")).withColumn("before", before).where("before > 0").drop("n")
    return rows.join(sizes, ["conv_id", "bucket"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "n_bytes")


def with_heads(own: DataFrame, head: Callable[[Column], Column], shared: Callable[[Column], Column], most: int) -> DataFrame:
    """Conversations rebuilt: the first ``shared(id)`` (at most ``most``) turns of ``head(id)``, then the own ones after as many.

    A head that is shorter gives all it has, one that isn't there none. Every conversation keeps one row of number 0.
    """
    turn = F.struct("i", "digest", "n_bytes")
    first = own.where(F.col("i") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("first"))
    c, empty = F.col("conv_id"), F.array().cast("array<struct<i: bigint, digest: binary, n_bytes: int>>")
    taken = F.slice(F.coalesce("first", empty), F.lit(1), shared(c).cast("int"))
    heads = write_table(first, "heads")
    lent = heads.select("conv_id", head(c).alias("head")).join(heads.select(c.alias("head"), "first"), "head", "left").select("conv_id", taken.alias("lent"))
    lent = write_table(lent, "lent")
    short = lent.select("conv_id", (F.size("lent") - shared(c)).alias("less")).where("less < 0")
    kept = own.where(F.col("i") > shared(c)).join(short, "conv_id", "left").select("conv_id", (F.col("i") + F.coalesce("less", F.lit(0))).alias("i"), "digest", "n_bytes")
    marker = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.unhex(F.lit("")).alias("digest"), F.lit(0).alias("n_bytes")))
    return lent.select("conv_id", F.explode(F.concat(marker, "lent")).alias("t")).select("conv_id", "t.*").unionByName(kept)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """A row for each block: ``conv_id, block, path, lens, above`` (node it stands under)``, node`` (it ends at)``, final`` (of the conversation)."""
    rows = rows.withColumn("block", F.greatest((F.col("i") - 1) / size, F.lit(0)).cast("int"))
    turns = F.expr("filter(turns, t -> t.i > 0)")
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "n_bytes"))).alias("turns")).withColumn("turns", turns)
    path = F.aggregate("turns", F.unhex(F.lit("")), lambda a, t: F.concat(a, t["digest"]))
    blocks = write_table(blocks.select("conv_id", "block", path.alias("path"), F.transform("turns", lambda t: t["n_bytes"]).alias("lens")), "blocks")
    one = (F.col("block") == 0) & (F.size("lens") < size)
    end = F.when(F.size("lens") == 0, _root()).otherwise(_short(F.concat(_root(), "path")))
    single = blocks.where(one).withColumns({"above": _root(), "node": end}).withColumn("final", F.col("node"))
    # Longer ones: the node after a full block is told by running sums of three lanes of 44 bits of its blocks' hashes.
    by_block = Window.partitionBy("conv_id").orderBy("block")
    hashed = F.sha2(F.concat(F.col("block").cast("string").cast("binary"), F.unhex(F.lit("3a")), F.col("path")), 256)
    lanes = [F.sum(F.conv(F.substring(hashed, 1 + 11 * j, 11), 16, 10).cast("long")).over(by_block) for j in range(3)]
    full = _short(F.concat_ws(",", F.lit("block"), F.col("block").cast("string"), *(lane.cast("string") for lane in lanes)).cast("binary"))
    many = blocks.where(~one).withColumn("full", full).withColumn("above", F.coalesce(F.lag("full").over(by_block), _root()))
    many = many.withColumn("node", F.when(F.size("lens") == size, F.col("full")).otherwise(_short(F.concat("above", "path")))).drop("full")
    whole = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return single.unionByName(many.withColumn("final", F.last("node").over(whole)))


def _ends(blocks: DataFrame) -> DataFrame:
    """``key, ends``: for each node at which conversations end, SHA-256 of their ids in ascending order, joined by commas.

    Ids are sorted by range, so that the copies of one conversation may fill many tasks, and joined there; the one task
    that hashes a node's ids reads their pieces one by one.
    """

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            runs = pa.compute.run_end_encode(batch.column(0))
            ids, begin, out = batch.column(1).to_pylist(), 0, []
            for end in runs.run_ends.to_pylist():
                out.append((ids[begin], ",".join(map(str, ids[begin:end]))))
                begin = end
            yield pa.RecordBatch.from_arrays([runs.values, pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.string())], names=["key", "first", "ids"])

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in it:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.binary()), pa.array([b for _, b in done], pa.string())], names=["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    ids = blocks.where("node = final").select(F.col("final").alias("key"), "conv_id")
    pieces = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends string")


def _common(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both paths."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # shared up to low turns, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


#: A row of the sorted table, as lists of one chunk.
ROW = {"block": "int", "above": "binary", "path": "binary", "lens": "array<int>", "node": "binary", "final": "binary", "conv_id": "long", "n": "long"}
END = "struct<block: int, above: binary, path: binary>"
CHUNKS = f"part int, chunk int, {', '.join(f'{k} array<{v}>' for k, v in ROW.items())}, shared array<int>, head {END}, tail {END}, fore array<int>, aft array<int>, low int"


def _join_length(a: dict, b: dict) -> int:
    """Turns that two rows of the sorted table share in one tree, -1 if they're of different ones."""
    return _common(a["path"], b["path"]) if (a["block"], a["above"]) == (b["block"], b["above"]) else -1


def _falling(values: list[int]) -> list[int]:
    """The distinct running minima."""
    out: list[int] = []
    for v in values:
        if not out or v < out[-1]:
            out.append(v)
    return out


def _chunks(most: int):
    """Rows in order to chunks: each row's shared length (unknown: -2, at the beginning of a partition), and a summary."""
    end_type, ints = pa.struct([("block", pa.int32()), ("above", pa.binary()), ("path", pa.binary())]), pa.list_(pa.int32())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, before = TaskContext.get().partitionId(), 0, None
        for batch in it:
            for at in range(0, batch.num_rows, most):
                rows = batch.slice(at, most)
                ends = [dict(zip(("block", "above", "path"), r, strict=True)) for r in zip(*(rows.column(j).to_pylist() for j in range(3)), strict=True)]
                inner = [_join_length(a, b) for a, b in zip(ends, ends[1:], strict=False)]
                shared = [-2 if before is None else _join_length(before, ends[0]), *inner]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.concat_arrays([c])) for c in rows.columns]
                own = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), *lists, pa.array([shared], ints), pa.array([ends[0]], end_type), pa.array([ends[-1]], end_type)]
                own += [pa.array([_falling(inner)], ints), pa.array([_falling(inner[::-1])], ints), pa.array([min(inner, default=2**31 - 1)], pa.int32())]
                yield pa.RecordBatch.from_arrays(own, names=["part", "chunk", *ROW, "shared", "head", "tail", "fore", "aft", "low"])
                chunk, before = chunk + 1, ends[-1]

    return run


def _cuts(chunks: DataFrame) -> DataFrame:
    """``part, chunk, joint`` (turns shared with the row before the chunk)``, next`` (with the row after it)`` , left, right``.

    ``left``: depths on the path of the first row that are points because of earlier chunks; ``right``: the same of the last
    row and later chunks. One task reads one narrow row a chunk, forwards and backwards.
    """

    def scan(forwards: bool):
        here, there, own = ("head", "tail", "aft") if forwards else ("tail", "head", "fore")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, cuts = None, set()
            for batch in it:
                out = []
                for r in batch.to_pylist():
                    joint = -1 if last is None else _join_length(last, r[here])
                    cuts = {min(d, joint) for d in cuts} | {joint}
                    cuts.discard(-1)
                    out.append((joint, sorted(cuts)))
                    cuts = {d for d in {*r[own], *(min(d, r["low"]) for d in cuts)} if d >= 0}
                    last = r[there]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([j for j, _ in out], pa.int32()), pa.array([c for _, c in out], pa.list_(pa.int32()))], names=["part", "chunk", "joint", "cuts"])

        return run

    narrow = chunks.select("part", "chunk", "head", "tail", "fore", "aft", "low").repartition(1)
    schema = "part int, chunk int, joint int, cuts array<int>"
    left = narrow.sortWithinPartitions("part", "chunk").mapInArrow(scan(True), schema)
    right = narrow.sortWithinPartitions(F.desc("part"), F.desc("chunk")).mapInArrow(scan(False), schema)
    return left.withColumnRenamed("cuts", "left").join(right.select("part", "chunk", F.col("joint").alias("next"), F.col("cuts").alias("right")), ["part", "chunk"])


#: What chunks know of points: sums that are added up, and of long conversations the rows of their blocks.
PARTIALS = "is_point boolean, key binary, depth long, parent binary, n long, conv_id long, leaves long, saved long, edge array<long>, final binary, block int, above binary, path binary"


class _ChunkTree:
    """The compressed trees of one chunk, by a stack of open points ``[depth, n, smallest id, leaves, below, has first row]``."""

    def __init__(self, chunk: dict, size: int):
        self.chunk, self.size, self.points, self.long = chunk, size, [], []
        self.joint = chunk["joint"]
        self.stack: list[list] = []

    def build(self) -> _ChunkTree:
        c = self.chunk
        shared = [self.joint, *c["shared"][1:], c["next"]]
        for k, size in enumerate(map(len, c["lens"])):
            if k:
                self._close(shared[k])
            self.row, self.sums = k, [0]
            for b in c["lens"][k]:
                self.sums.append(self.sums[-1] + b)
            if k == 0:
                depths = [0, *(d for d in c["left"] if d)]
            else:
                depths = [] if self.stack else [0]
            self.stack += [[d, 0, None, 0, 0, k == 0] for d in depths]
            if self.stack[-1][0] < size:
                self.stack.append([size, 0, None, 0, 0, k == 0])
            top, conv, n = self.stack[-1], c["conv_id"][k], c["n"][k]
            last = c["node"][k] == c["final"][k]
            leaf = int(last and shared[k + 1] < size)
            top[1] += n
            top[2] = conv if top[2] is None else min(top[2], conv)
            top[3] += leaf
            if c["block"][k] or size == self.size:
                saved = n * self.sums[-1] - (self.sums[-1] - self.sums[max(shared[k], 0)])
                self.long.append((c["final"][k], c["block"][k], c["above"][k], c["path"][k], leaf, saved, not last))
        for d in sorted(c["right"], reverse=True):
            self._close(d)
        self._close(-1)
        return self

    def _key(self, depth: int) -> bytes:
        c, k = self.chunk, self.row
        if depth == 0:
            return c["above"][k]
        return c["node"][k] if depth == len(c["lens"][k]) else _python_short(c["above"][k] + c["path"][k][: depth * WIDTH])

    def _close(self, depth: int) -> None:
        """Points deeper than the prefix shared with what follows are done: each goes into the point above it."""
        sums, stack, base = self.sums, self.stack, self.size * self.chunk["block"][self.row]
        while stack and stack[-1][0] > depth:
            d, n, conv, leaves, below, first = stack.pop()
            if d == 0:  # the root of a later block is the end point of the block before
                if base == 0:
                    self.points.append((self._key(0), 0, None, n, conv, leaves, below, None))
                continue
            if stack[-1][0] < depth:
                stack.append([depth, 0, None, 0, 0, first])
            above = stack[-1]
            # Nodes on the path that the row before the chunk has too were counted there as distinct ones.
            known = min(self.joint, d) if first else 0
            saved = below + (n - (d > known)) * (sums[d] - sums[d - 1])
            up = saved + n * (sums[d - 1] - sums[above[0]]) - (sums[d - 1] - sums[min(max(above[0], known), d - 1)])
            edge = [sums[d - 1] - sums[j - 1] for j in range(above[0] + 1, d)]
            self.points.append((self._key(d), base + d, self._key(above[0]), n, conv, leaves, saved, edge))
            above[1] += n
            above[2] = conv if above[2] is None else conv if conv is not None and conv < above[2] else above[2]
            above[3] += leaves
            above[4] += up


def _partials(size: int):
    """Chunks to the points of their trees, and the rows of blocks of long conversations (``depth`` 1: another block follows)."""
    names = [f.split()[0] for f in PARTIALS.split(", ")]
    types = dict(zip(names, (pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                tree = _ChunkTree(batch.slice(k, 1).to_pylist()[0], size).build()
                rows = [dict(zip(("key", "depth", "parent", "n", "conv_id", "leaves", "saved", "edge"), p, strict=True)) | {"is_point": True} for p in tree.points]
                rows += [dict(zip(("final", "block", "above", "path", "leaves", "saved", "depth"), (*p[:6], int(p[6])), strict=True)) | {"is_point": False} for p in tree.long]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types[c]) for c in names], names=names)

    return run


def _from_later_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """``key, leaves, saved`` of what lies in later blocks, for every node on the way of a conversation through a block."""
    later = Window.partitionBy("final").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("final", "block", "above", "path", "depth", F.sum("leaves").over(later).alias("leaves"), F.sum("saved").over(later).alias("saved"), F.lag("above").over(Window.partitionBy("final").orderBy(F.desc("block"))).alias("end"))
    inner = F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda d: _short(F.concat(F.col("above"), F.col("path").substr(F.lit(1), d * WIDTH))))
    root = F.when(F.col("block") == 0, F.array(_root())).otherwise(F.array().cast("array<binary>"))
    return rows.where("depth = 1").select(F.explode(F.concat(root, inner, F.array("end"))).alias("key"), "leaves", "saved")


def prefix_trie(rows: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """All nodes of the trie of conversations: ``conv_id`` (smallest member)``, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``. ``rows``: ``conv_id, i, digest, n_bytes`` as ``with_heads`` gives them.

    ``block`` turns (2 at least) and ``chunk`` rows bound what one row of the intermediate tables holds; results don't depend on them.
    """
    blocks = write_table(_blocks(rows, block), "paths")
    keys = [c for c in ROW if c not in ("conv_id", "n")]
    distinct = blocks.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).select(*ROW)
    order = ["block", "above", "path", F.col("node") != F.col("final"), "final"]
    chunks = write_table(distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks(chunk), CHUNKS), "chunks")
    cuts = _cuts(chunks)
    partials = write_table(chunks.drop("head", "tail", "fore", "aft", "low").join(cuts, ["part", "chunk"]).mapInArrow(_partials(block), PARTIALS), "partials")
    found = partials.where("is_point").select("key", "depth", "parent", "n", "conv_id", "leaves", "saved", "edge")
    rest = _from_later_blocks(partials.where("not is_point"), block)
    columns = found.unionByName(rest, allowMissingColumns=True).unionByName(_ends(blocks), allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "saved")]
    tree = columns.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums, F.max("edge").alias("edge"), F.max("ends").alias("ends"))
    # Nodes within an edge get sums of later blocks too, but are no points.
    tree = write_table(tree.where("depth is not null"), "tree")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    points = tree.join(children, "key", "left").join(above, "parent", "left")
    top = F.col("depth") - F.coalesce(F.size("edge"), F.lit(0))  # depth of the first node of the edge
    nodes = points.withColumn("top", F.when(F.col("depth") == 0, F.lit(0)).otherwise(top)).withColumn("d", F.explode(F.sequence("top", "depth")))
    end, first = F.col("d") == F.col("depth"), F.col("d") == F.col("top")
    saves = F.coalesce(F.get("edge", (F.col("d") - F.col("top")).cast("int")), F.lit(0)) * (F.col("n") - 1)
    return nodes.select(
        "conv_id",
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None)).when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.coalesce("n_children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.when(end, F.lit(0)).otherwise(saves)).alias("saved_tokens"),
        F.when(end, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
