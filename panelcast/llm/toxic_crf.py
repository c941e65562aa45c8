"""Toxicity by a linear-chain conditional random field over the words of a text.

Words of labelled documents get tags: a word is tagged if its document is toxic and its form, or the way
it begins, is found in toxic documents much more often than in others. A two-state chain is trained on
these tags (numpy, minibatch AdaGrad). Forward-backward marginals of all words of a text then give its
offending spans and, through a logistic curve fitted on labelled documents that the chain hasn't seen,
its score.

The model is fitted on SAMPLE labelled documents at most, those with the least hash of their id; everything
else covers all rows and whole texts. Chains end at line ends, at . ! ? and after CHAIN words.

Null and empty texts have no words: their score is that of no evidence. Labels other than 0 and 1, null
ids and labels of unknown documents aren't learnt from; of several labels of one id, the largest counts.
Without toxic or without clean labels the score is the share of toxic labels (0 without any). Repeated
rows get the same score each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W

SAMPLE, CHAIN, SIZE, EPOCHS = 3000, 64, 1 << 18, 5
#: A form is telling if at least so many documents have it and its log odds are at least this.
SEEN, ODDS = 4, 2.5
#: Bytes of text that a task scores at once.
SCORED = 1 << 19
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features(w: W.Words) -> np.ndarray:
    """Slots of each word's features: its form, how it begins and ends, its length."""
    lower = W.Words(w.data, w.start, w.first, w.hashes, W.lowered(w.raw), w.ends, w.begin, w.end)
    a, b = w.begin, w.end
    size = b - a
    rows = [w.hashes]
    for n in (4, 6, 8):
        rows.append(W.piece_hashes(lower, a, np.minimum(a + n, b)) * np.uint64(2 * n + 1))
    for n in (3, 5):
        rows.append(W.piece_hashes(lower, np.maximum(b - n, a), b) * np.uint64(2 * n + 101))
    rows.append(W.mix(np.minimum(size, 20).astype("uint64") + np.uint64(77)))
    return np.stack([(r >> np.uint64(40)) % np.uint64(SIZE) for r in rows], axis=1).astype("int32")


def chains(w: W.Words) -> np.ndarray:
    """First word of each chain, and the number of words."""
    n = len(w.begin)
    if n == 0:
        return np.zeros(1, "int64")
    cut = np.zeros(n, bool)
    cut[w.first[:-1][w.first[:-1] < n]] = True
    stops = np.r_[0, np.cumsum(_STOP[w.raw])]
    cut[1:] |= stops[w.begin[1:]] > stops[w.end[:-1]]
    begin = np.flatnonzero(cut)
    place = np.arange(n) - begin[np.cumsum(cut) - 1]
    return np.r_[np.flatnonzero(place % CHAIN == 0), n]


def marginals(emit: np.ndarray, cuts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the probability of the tag, and of (state before, state) by pair of states.

    emit: log odds of the tag from the word alone; move: log weights of steps between states.
    """
    size = np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    begin, size = cuts[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # chains with so many words
    odds = np.exp(np.clip(emit, -30, 30))
    step = np.exp(move)
    ahead, back = np.empty(len(emit)), np.ones(len(emit))
    pairs = np.zeros((len(emit), 4))
    for t in range(longest):
        at = begin[: live[t]] + t
        if t == 0:
            ahead[at] = odds[at] / (1 + odds[at])
        else:
            p = ahead[at - 1]
            one = ((1 - p) * step[0, 1] + p * step[1, 1]) * odds[at]
            ahead[at] = one / (one + (1 - p) * step[0, 0] + p * step[1, 0])
    for t in range(longest - 2, -1, -1):
        nxt = begin[: live[t + 1]] + t + 1
        b, o = back[nxt], odds[nxt] * back[nxt]
        back[nxt - 1] = (step[1, 0] + step[1, 1] * o) / (step[0, 0] + step[0, 1] * o)  # odds of what follows
        p = ahead[nxt - 1]
        joint = np.stack([(1 - p) * step[0, 0], (1 - p) * step[0, 1] * o, p * step[1, 0], p * step[1, 1] * o], axis=1)
        pairs[nxt] = joint / joint.sum(axis=1, keepdims=True)
        del b
    tag = ahead * back / (ahead * back + 1 - ahead)
    return tag, pairs


def evidence(tag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a document's marginals say: highest, and log of one plus the sum of those over one half."""
    n = len(first) - 1
    high, total = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        high[some] = np.maximum.reduceat(tag, first[some])
        total[some] = np.add.reduceat(np.where(tag > 0.5, tag, 0), first[some])
    return np.stack([high, np.log1p(total)], axis=1)


def fit(texts: list[str], toxic: np.ndarray) -> dict:
    """The model of a sample of labelled texts; two thirds train the chain, the others the curve."""
    base = float(toxic.mean()) if len(toxic) else 0.0
    none = {"weights": np.zeros(SIZE, "float32"), "move": np.zeros((2, 2)), "curve": np.zeros(2), "bias": 0.0, "fixed": base}
    if not 0 < base < 1:
        return none
    rng = np.random.default_rng(7)
    chain = rng.random(len(texts)) < 2 / 3
    parts = []
    for row, block in W.blocks(pa.array(texts, pa.string())):
        w = W.words_of(block, lower=True, word_byte=_LETTER)
        parts.append((row, w.first, features(w), chains(w)))
    telling = np.zeros(SIZE, bool)
    seen = np.zeros((2, SIZE))
    for row, first, slots, _ in parts:
        for d in range(len(first) - 1):
            if chain[row + d]:
                seen[int(toxic[row + d]), np.unique(slots[first[d] : first[d + 1], :4])] += 1
    docs = np.array([(chain & (toxic == k)).sum() for k in (0, 1)])[:, None]
    rate = (seen + 0.5) / (docs + 1)
    telling = (seen[1] >= SEEN) & (np.log(rate[1]) - np.log(rate[0]) > ODDS)
    weights, gain = np.zeros(SIZE), np.full(SIZE, 1e-6)
    move, move_gain = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    for epoch in range(EPOCHS):
        for p in rng.permutation(len(parts)):
            row, first, slots, cuts = parts[p]
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            use = chain[row + doc]
            goal = (telling[slots[:, :4]].any(axis=1) & (toxic[row + doc] == 1)).astype(float)
            tag, pairs = marginals(weights[slots].sum(axis=1), cuts, move)
            wrong = np.where(use, goal - tag, 0.0)
            slope = np.bincount(slots.ravel(), np.repeat(wrong, slots.shape[1]), SIZE) - 1e-3 * weights
            gain += slope**2
            weights += 0.5 * slope / np.sqrt(gain)
            inner = np.ones(len(doc), bool)
            inner[cuts[:-1]] = False
            inner &= use
            was = np.r_[0.0, goal[:-1]]
            seen_pairs = np.stack([(1 - was) * (1 - goal), (1 - was) * goal, was * (1 - goal), was * goal], axis=1)
            slope = (seen_pairs[inner].sum(axis=0) - pairs[inner].sum(axis=0)).reshape(2, 2)
            move_gain += slope**2
            move += 0.1 * slope / np.sqrt(move_gain)
    rest = [(evidence(marginals(weights[s].sum(axis=1), c, move)[0], f), r) for r, f, s, c in parts]
    x = np.concatenate([e[~chain[r : r + len(e)]] for e, r in rest])
    y = np.concatenate([toxic[r : r + len(e)][~chain[r : r + len(e)]] for e, r in rest]).astype(float)
    curve, bias = np.zeros(2), 0.0
    if len(y):
        mean = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        bias = mean
        for _ in range(300):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-(x @ curve + bias)))
            full = np.c_[x, np.ones(len(x))]
            slope = full.T @ (y - p) - np.r_[0.1 * curve, 0]
            bend = (full * (p * (1 - p))[:, None]).T @ full + np.diag([0.1, 0.1, 1e-6])
            move_by = np.linalg.solve(bend, slope)
            curve, bias = curve + np.clip(move_by[:2], -2, 2), bias + float(np.clip(move_by[2], -2, 2))
            if np.abs(move_by).max() < 1e-6:
                break
    return none | {"weights": weights.astype("float32"), "move": move, "curve": curve, "bias": bias, "fixed": None}


def fit_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of at most `sample` labelled documents that aren't held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample).collect()  # at most `sample` small rows
    spark = docs.sparkSession
    if not chosen:
        return fit([], np.zeros(0, int))
    few = spark.createDataFrame([(r[0], int(r[1])) for r in chosen], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")  # at most `sample` rows
    got = sorted({r[0]: (r[0], r[1], r[2]) for r in rows.select("doc_id", F.coalesce("text", F.lit("")), "toxic").collect()}.values())
    try:
        return fit([r[1] for r in got], np.array([r[2] for r in got], int))
    finally:
        W.give_back()  # the driver goes on with other jobs


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and spans (start and end code points and probability of offending words)."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kind = "struct<score:double,spans:array<struct<start:int,end:int,probability:double>>>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        scores, spans = [], []
        for _, block in W.blocks(texts, SCORED):
            w = W.words_of(block, lower=True, word_byte=_LETTER)
            tag, _ = marginals(m["weights"][features(w)].sum(axis=1).astype(float), chains(w), m["move"])
            p = 1 / (1 + np.exp(-(evidence(tag, w.first) @ m["curve"] + m["bias"])))
            scores += (p if m["fixed"] is None else np.full(len(p), m["fixed"])).tolist()
            place = np.r_[0, np.cumsum((w.raw & 0xC0) != 0x80)]  # code points before each byte
            hit = np.flatnonzero(tag > 0.5)
            owner = np.searchsorted(w.first, hit, "right") - 1
            found: list[list] = [[] for _ in range(len(block))]
            for i, d in zip(hit.tolist(), owner.tolist(), strict=True):
                base = place[w.ends[d]]
                found[d].append({"start": int(place[w.begin[i]] - base), "end": int(place[w.end[i]] - base), "probability": float(tag[i])})
            spans += found
        W.give_back()  # workers outlive their tasks
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["score", "spans"])

    return docs.withColumn("_toxic", F.arrow_udf(run, kind)("text")).withColumns({"score": F.col("_toxic.score"), "spans": F.col("_toxic.spans")}).drop("_toxic")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without those whose score is `limit` or more; columns as they were."""
    plain = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"])
    return score(plain, fit_labels(docs, labels)).where(F.col("score") < limit).select("_row.*")
