"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Labelled tokens come from labelled documents: a token of a toxic document is tagged toxic when its word, or a
word beginning of 4 to 8 letters, is found in toxic texts and hardly in clean ones; all other tokens,
and all of clean documents, are tagged clean. The field has two tags, weights for those words and beginnings,
a tag bias and tag transitions, and is fitted to the tagged sequences by maximum likelihood.

Forward and backward messages run over the concatenated tokens of many documents at once: a token is a 2 x 2
matrix, a document's first token resets the chain, blocks of tokens are multiplied side by side, and only the
block products are chained one by one. The sum of the squared marginals, which many faint doubts hardly raise, goes through a logistic curve,
fitted to the documents' labels, to give the score; tokens with a marginal of one half or more, joined where
they are neighbours, are the offending spans.

Rows: null and empty texts have no tokens and score what the curve gives for none; without a labelled toxic
document every score is 0; a document with several labels counts as toxic if one says so; labels that are
null, or of unknown documents, are not used; repeated rows stay; a very long text is tagged whole, with others in one
batch or alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.pretokens import Memo, batches

#: Bound of the fit: clean and toxic labelled documents, those with the smallest hashes, and the bytes of their texts.
SAMPLE_DOCS, SAMPLE_BYTES = (2000, 1000), (24_000_000, 12_000_000)
#: A word or beginning is a feature if toxic texts have it so many times as often as clean ones, and if the
#: log-likelihood ratio says that chance, among all the words there are, hardly gives that.
MIN_RATIO, MIN_G2 = 8.0, 15.0
BEGINNINGS = (4, 5, 6, 7, 8)
STEPS = 40
PENALTY = 1e-3
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked."""
    w = word.lower()
    return ["=" + w, *(w[:n] for n in BEGINNINGS if len(w) >= n)]


@dataclass
class Model:
    """``weights`` of features; ``chain``: 2 x 2 transition factors; ``start``; ``curve``: intercept and slope."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    chain: tuple = (1.0, 1.0, 1.0, 1.0)
    start: tuple = (1.0, 1.0)
    curve: tuple | None = None

    def __post_init__(self):
        self.heads = {f.lstrip("=")[:3] for f in self.weights}
        self.plain = float(np.exp(np.clip(self.bias, -30, 30)))

    def emission(self, word: str) -> float:
        """A token's toxic against clean factor; most words share no first letters with any feature."""
        if word[:3].lower() not in self.heads:
            return self.plain
        return float(np.exp(np.clip(self.bias + sum(self.weights.get(f, 0.0) for f in features(word)), -30, 30)))


def messages(odds: np.ndarray, first: np.ndarray, chain, start) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages, each 2 x tokens. ``odds``: a token's toxic against clean factor."""
    n = len(odds)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    size = blocks * width
    e = np.ones(size)
    e[:n] = odds
    f = np.ones(size, bool)  # what fills the last block up is no part of the last document
    f[:n] = first
    e, f = np.ascontiguousarray(e.reshape(blocks, width).T), np.ascontiguousarray(f.reshape(blocks, width).T)
    a00, a01, a10, a11 = chain
    s0, s1 = start

    def factors(t):
        return np.where(f[t], s0, a00), np.where(f[t], s1, a01) * e[t], np.where(f[t], s0, a10), np.where(f[t], s1, a11) * e[t]

    k00, k01, k10, k11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(width):
        g00, g01, g10, g11 = factors(t)
        k00, k01, k10, k11 = k00 * g00 + k01 * g10, k00 * g01 + k01 * g11, k10 * g00 + k11 * g10, k10 * g01 + k11 * g11
        top = k00 + k01 + k10 + k11
        k00, k01, k10, k11 = k00 / top, k01 / top, k10 / top, k11 / top
    into, back = np.empty((2, blocks)), np.empty((2, blocks))
    x, y = 0.5, 0.5
    for b, (p, q, r, s) in enumerate(zip(k00.tolist(), k01.tolist(), k10.tolist(), k11.tolist(), strict=True)):
        into[:, b] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for b in range(blocks - 1, -1, -1):
        back[:, b] = x, y
        x, y = k00[b] * x + k01[b] * y, k10[b] * x + k11[b] * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta = np.empty((2, width, blocks)), np.empty((2, width, blocks))
    x, y = into
    for t in range(width):
        g00, g01, g10, g11 = factors(t)
        x, y = x * g00 + y * g10, x * g01 + y * g11
        top = x + y
        x, y = x / top, y / top
        alpha[0, t], alpha[1, t] = x, y
    x, y = back
    for t in range(width - 1, -1, -1):
        beta[0, t], beta[1, t] = x, y
        g00, g01, g10, g11 = factors(t)
        x, y = g00 * x + g01 * y, g10 * x + g11 * y
        top = x + y
        x, y = x / top, y / top
    flat = lambda m: m.transpose(0, 2, 1).reshape(2, size)[:, :n]
    return flat(alpha), flat(beta)


def marginals(odds: np.ndarray, first: np.ndarray, chain, start) -> np.ndarray:
    """The probability of the toxic tag for every token."""
    if not len(odds):
        return np.zeros(0)
    alpha, beta = messages(odds, first, chain, start)
    clean, toxic = alpha[0] * beta[0], alpha[1] * beta[1]
    return toxic / (clean + toxic)


def learn_tokens(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Features that toxic texts have and clean ones hardly; equal texts count once."""
    seen, counts, totals = set(), (Counter(), Counter()), [0, 0]
    for text, label in zip(texts, toxic.tolist(), strict=True):
        if text in seen:
            continue
        seen.add(text)
        words = set(TOKEN.findall(text.lower()))
        counts[label].update({f for w in words for f in features(w)})
        totals[label] += 1
    clean, bad = counts
    scale, share = (totals[0] + 1) / (totals[1] + 1), totals[1] / sum(totals)

    def g2(n: int, c: int) -> float:
        return 2 * (n * np.log(n / ((n + c) * share)) + (c * np.log(c / ((n + c) * (1 - share))) if c else 0.0))

    return {f for f, n in bad.items() if n * scale >= MIN_RATIO * (clean[f] + 1) and (share == 1 or g2(n, clean[f]) >= MIN_G2)}


def train(texts: list[str], toxic: np.ndarray, all_clean: int = 0, all_toxic: int = 0) -> Model:
    """Fit the field to the tagged tokens and the curve to the labels; ``all_*``: labels before sampling."""
    if not toxic.any():
        return Model()
    names = learn_tokens(texts, toxic)
    index = {f: k for k, f in enumerate(sorted(names))}
    cache: dict[str, tuple] = {}
    words: list[tuple] = []
    owner, first = [], []
    for d, text in enumerate(texts):
        for k, w in enumerate(TOKEN.findall(text)):
            if (got := cache.get(w)) is None:
                got = cache[w] = tuple(index[f] for f in features(w) if f in index)
            words.append(got)
            owner.append(d)
            first.append(k == 0)
    owner, first = np.array(owner, np.int64), np.array(first, bool)
    where = [k for k, fs in enumerate(words) for _ in fs]
    where, which = np.array(where, np.int64), np.array([f for fs in words for f in fs], np.int64)
    n = len(words)
    gold = np.zeros(n)
    gold[where] = 1
    gold *= toxic[owner] if n else 1
    before = np.concatenate([[0.0], gold[:-1]]) if n else gold
    inner = ~first
    seen = np.array([[np.sum((1 - before) * (1 - gold) * inner), np.sum((1 - before) * gold * inner)], [np.sum(before * (1 - gold) * inner), np.sum(before * gold * inner)]])
    starts = np.array([np.sum((1 - gold) * first), np.sum(gold * first)])
    # Parameters: feature weights, bias, log transitions, log starts. Adam on the penalised mean likelihood.
    m = len(index)
    theta = np.zeros(m + 7)
    theta[:m] = 1.0
    theta[m] = np.log((gold.sum() + 1) / (n + 2))
    hold, spread = np.zeros(m + 7), np.zeros(m + 7)
    scale = max(1.0, gold.sum())
    parts = _parts(first, where)
    for step in range(1, STEPS + 1) if n else ():
        chain, start = np.exp(theta[m + 1 : m + 5]), np.exp(theta[m + 5 :])
        grad = np.concatenate([np.zeros(m + 1), seen.ravel(), starts])
        for lo, hi, x, y in parts:  # whole documents, so many at a time that the messages stay small
            here, size, f = where[x:y] - lo, hi - lo, first[lo:hi]
            odds = np.exp(np.clip(theta[m] + np.bincount(here, theta[which[x:y]], size), -30, 30))
            alpha, beta = messages(odds, f, chain, start)
            p = alpha[1] * beta[1] / (alpha[0] * beta[0] + alpha[1] * beta[1])
            pair = np.empty((4, size))
            prior = np.concatenate([[[0.5], [0.5]], alpha[:, :-1]], axis=1)
            for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                pair[k] = prior[i] * chain[k] * (odds if j else 1.0) * beta[j]
            pair /= pair.sum(0)
            grad[:m] += np.bincount(which[x:y], (gold[lo:hi] - p)[here], m)
            grad[m] += np.sum(gold[lo:hi] - p)
            grad[m + 1 : m + 5] -= pair @ ~f
            grad[m + 5 :] -= [np.sum((1 - p) * f), np.sum(p * f)]
        grad = grad / scale - PENALTY * theta
        hold, spread = 0.9 * hold + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        theta = theta + 0.2 * (hold / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    model = Model(
        {f: float(theta[k]) for f, k in index.items()}, float(theta[m]), tuple(np.exp(theta[m + 1 : m + 5]).tolist()), tuple(np.exp(theta[m + 5 :]).tolist())
    )
    expected = np.zeros(len(texts))
    for lo, hi, x, y in parts:
        odds = np.exp(np.clip(theta[m] + np.bincount(where[x:y] - lo, theta[which[x:y]], hi - lo), -30, 30))
        expected += np.bincount(owner[lo:hi], marginals(odds, first[lo:hi], model.chain, model.start) ** 2, len(texts))
    ratio = np.array([all_clean / max(1, np.sum(toxic == 0)), all_toxic / max(1, np.sum(toxic == 1))]) if all_clean + all_toxic else np.ones(2)
    model.curve = fit_curve(expected, toxic, ratio)
    return model


def _parts(first: np.ndarray, where: np.ndarray, tokens: int = 150_000) -> list[tuple[int, int, int, int]]:
    """Runs of whole documents of about so many tokens: their tokens, and their places in ``where``."""
    heads = [*np.flatnonzero(first).tolist(), len(first)]
    cuts = [0]
    for a in heads:
        if a - cuts[-1] >= tokens or (a == len(first) and a > cuts[-1]):
            cuts.append(a)
    at = np.searchsorted(where, cuts).tolist()
    return list(zip(cuts, cuts[1:], at, at[1:], strict=False))


def evidence(expected):
    """What the curve reads: it grows with the toxic tokens' squared marginals, fastest below one."""
    return np.log((np.asarray(expected, float) + 0.01) / 0.1)


def fit_curve(expected: np.ndarray, toxic: np.ndarray, ratio: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, with a small penalty."""
    x = np.stack([np.ones(len(expected)), evidence(expected)])
    w, c = np.maximum(ratio[toxic], 1e-9), np.zeros(2)
    w = w * (len(w) / w.sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -30, 30)))
        grad = x @ (w * (toxic - p)) - 0.5 * np.array([0.0, 1.0]) * (c - [0.0, 1.0])
        hess = (x * (w * p * (1 - p))) @ x.T + np.diag([1e-3, 0.5])
        c = c + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(c[0]), float(max(c[1], 1e-3))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: tuple[int, int] = SAMPLE_DOCS, sample_bytes: tuple[int, int] = SAMPLE_BYTES, text_col: str = "text") -> Model:
    """Train on the labelled rows where ``learn`` (a condition on ``doc_id``) holds.

    The driver gets whole texts of at most ``sample_docs`` clean and toxic documents and ``sample_bytes`` bytes.
    """
    marks = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * sample_docs[k] / n))])
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(6)), F.lit(1 << 30))
    picked = marks.where(order < share[F.col("toxic")] * F.lit(1 << 30)).select("doc_id", F.col("toxic").cast("int").alias("toxic"), order.alias("o"))
    # The picked ids are bounded by the parameter, so they go to the documents and not the other way round. Rows that
    # repeat an id and a text become one in the scan's tasks; what is left is bounded by number and bytes.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").select("o", "toxic", "text").distinct()
    in_order = Window.partitionBy("toxic").orderBy("o", "text")
    most = lambda bounds: F.when(F.col("toxic") == 1, bounds[1]).otherwise(bounds[0])
    texts = texts.withColumns({"r": F.row_number().over(in_order), "bytes": F.sum(F.octet_length("text")).over(in_order)})
    rows = texts.where((F.col("r") <= most(sample_docs)) & ((F.col("bytes") <= most(sample_bytes)) | (F.col("r") == 1))).select("toxic", "r", "text").collect()
    rows.sort(key=lambda r: (r["toxic"], r["r"]))
    if not any(r["toxic"] for r in rows):
        return Model()
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), counts.get(0, 0), counts[1])


class Tagger:
    def __init__(self, model: Model):
        self.model, self.memo = model, Memo()

    def __call__(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        model = self.model
        if model.curve is None:
            return [(0.0, [])] * len(texts)
        lists = [TOKEN.findall(t) for t in texts]
        distinct = list(dict.fromkeys(w for ws in lists for w in ws))
        factor = dict(zip(distinct, self.memo.look_up(distinct, lambda ws: list(map(model.emission, ws))), strict=True))
        sizes = np.array([len(ws) for ws in lists], np.int64)
        odds = np.fromiter((factor[w] for ws in lists for w in ws), float, int(sizes.sum()))
        first = np.zeros(len(odds), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        p = marginals(odds, first, model.chain, model.start)
        owner = np.repeat(np.arange(len(texts)), sizes)
        expected = np.bincount(owner, p**2, len(texts))
        a, b = model.curve
        scores = 1 / (1 + np.exp(-np.clip(a + b * evidence(expected), -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        for d in np.unique(owner[p >= 0.5]).tolist():
            mine = p[ends[d] - sizes[d] : ends[d]] >= 0.5
            last = -2
            for k, m in enumerate(TOKEN.finditer(texts[d])):
                if mine[k]:
                    if k == last + 1:
                        spans[d][-1]["end"] = m.end()
                    else:
                        spans[d].append({"start": m.start(), "end": m.end()})
                    last = k
        return list(zip(scores.tolist(), spans, strict=True))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``toxic_score``, ``toxic_spans`` (character offsets, end excluded) and ``toxic_pred``; no shuffle.

    ``keep`` names the columns of ``docs`` to carry (all); those of the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", spans), T.StructField("toxic_pred", T.IntegerType())]
    carried = docs.select(*(c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in added}))
    schema = T.StructType([*carried.schema.fields, *added])
    names = [f.name for f in schema.fields]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = Tagger(shared.value)
        for batch in it:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in batches(texts):
                rows = tag(texts[a:b])
                cols = [
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], span_type),
                    pa.array([int(r[0] >= threshold) for r in rows], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:-1]), *cols], names=names)

    return docs.select(*carried.columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_toxic_text")).mapInArrow(run, schema)
