import hashlib
import random
import zlib

import pytest

from waymark.llm import prefix_trie as trie
from waymark.llm.entry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(conversations: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[c] for c in below) or 1
        saved[p] = sum(saved[c] for c in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(head, [])[:h] + turns[h:]
    return out


def result(df) -> list[tuple]:
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]


def of_rows(spark, rows, **sizes):
    own = trie.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest int, n_bytes string"))
    from pyspark.sql import functions as F

    return result(trie.prefix_trie(trie.with_heads(own, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8), **sizes))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(QUERIES["op11_prefix_trie"](spark, SF))
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt(rows))


def planted(seed: int, n: int, letters: str, longest: int) -> list[tuple]:
    """Conversations of few different turns, with copies, prefixes of each other, and repeated first turns."""
    rnd, rows, known = random.Random(seed), [], [[]]
    for c in rnd.sample(range(-40, 400), n):
        turns = list(rnd.choice(known))[: rnd.randrange(longest + 1)] + [rnd.choice(letters) for _ in range(rnd.randrange(longest // 2 + 1))]
        turns = turns or ["a"]
        known.append(turns)
        rows += [(c, k, None if t == "b" else "user", None if t == "c" else t * (1 + ord(t) % 5), None, None) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("seed", "n", "letters", "longest", "block", "chunk"), [(1, 60, "abcde", 6, 256, 4096), (2, 120, "ab", 9, 2, 1), (3, 150, "abc", 14, 3, 2), (4, 100, "a", 20, 4, 3), (5, 200, "abé", 8, 5, 7), (6, 80, "ab", 40, 7, 4096)])
def test_blocks_and_chunks(spark, seed, n, letters, longest, block, chunk):
    """Small blocks and chunks, so that points of one edge and sums come from many of them."""
    rows = planted(seed, n, letters, longest)
    got = of_rows(spark, rows, block=block, chunk=chunk)
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt([r[:4] for r in rows]))


def test_long_conversations(spark):
    """Turn numbers of several buckets, conversations of several blocks, in the sizes of the query."""
    same = [(c, k, "user", f"t{k}", None, None) for c in (10, 12, 14) for k in range(1400)]
    rows = same + [(11, k, "user", f"t{k}", None, None) for k in range(256)] + [(13, k, "user", f"t{k}" if k != 700 else "other", None, None) for k in range(1100)] + [(3, k, "user", f"t{k}", None, None) for k in range(512)]
    got = of_rows(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt([r[:4] for r in rows]))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (5, None, "user", "first"), (5, 3, None, None), (5, 3, None, None), (5, 3, "z", ""), (7, 0, "user", "x" * 50_000), (8, 2, "", "é"), (2**62, 1, "a", "b"), (-3, 1, "a", "b"), (-3, 0, "a", "b")]
    rows = [(*r, None, None) for r in rows]
    got = of_rows(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt([r[:4] for r in rows]))
    assert of_rows(spark, []) == []
    assert of_rows(spark, [(None, 0, "user", "x", None, None)]) == []


def test_copies_of_one_conversation(spark):
    rows = [(c, k, "user", f"t{k}", None, None) for c in range(3000) for k in range(2)]
    got = of_rows(spark, rows)
    assert set(got) == brute(rebuilt([r[:4] for r in rows]))
