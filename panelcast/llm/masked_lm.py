"""Language-model scores of documents as masked pseudo-likelihoods.

A small network predicts every token from the SPAN tokens before and after it: embeddings of both sides are
summed, bent by tanh, and give a class of tokens and the token in its class (two softmaxes). A document's
score is the sum of the log-probabilities of all its tokens, each given the others.

Tokens are words with A-Z lowered. The network tells apart slots: the most frequent words of the whole corpus
have one each, all others share the rest by their hash, and the number of slots grows with the square root of
the vocabulary (SIZE at least). A word in a shared slot takes its share of the slot's words besides, by the
counts of all words over all documents: log P(slot | neighbours) + log P(word | slot). A word that was not
counted has the chance of one more occurrence of its slot. The counts stay a table; the words of each task's
texts are sent to them, and the sums come back task by task.

Every position of every document is learnt once: training goes ROUNDS times over all documents, each round
learns its own hash-chosen share of the positions, and the shares are disjoint and add up to all. In a round
every task starts from the same weights and learns (numpy, AdaGrad), and the weights are averaged over tasks
by the number of positions, as a grouped sum. Only the network comes to the driver.

Null and empty texts have no tokens: log-likelihood 0, perplexity null. Repeated rows score alike. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.stage import keep

FREQUENT, SHARED, CLASS = 768, 256, 32
SIZE = FREQUENT + SHARED
WIDTH, SPAN, ROUNDS, BATCH, RATE = 16, 4, 2, 4096, 0.1
#: Texts that a task remembers as asked for; forgetting costs time and changes nothing.
ASKED = 200_000
#: Exponents up to this, either way, fit into single precision as they are.
REACH = 40.0


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """The network over `side` classes of `side` slots; the slot after the last stands before and after a text."""
    slots = side * side
    return {"left": (slots + 1, WIDTH), "right": (slots + 1, WIDTH), "bend": (WIDTH,), "class_w": (side, WIDTH), "class_b": (side,), "word_w": (side, side, WIDTH), "word_b": (side, side)}


SHAPES = shapes(CLASS)


def word_counts(docs: DataFrame) -> DataFrame:
    """hash and count of every lower-cased word of all texts, counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(W.words_of(t, lower=True, bodies=False).hashes, return_counts=True) for _, t in W.blocks(batch.column(0))]
            if found:
                word, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
                count = np.bincount(at, np.concatenate([c for _, c in found]), len(word)).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(word.view("int64")), pa.array(count)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(docs: DataFrame) -> dict:
    """A model that knows the frequencies of words and slots only."""
    counts = keep(word_counts(docs))
    side = max(CLASS, math.ceil((4 * counts.count()) ** 0.25))
    slots = side * side
    own = slots * FREQUENT // SIZE
    top = counts.orderBy(F.desc("n"), "word").limit(own).toArrow()  # at most as many rows as slots
    frequent = top["word"].to_numpy().view("uint64")
    order = np.argsort(frequent)
    model = {"words": frequent[order], "slots": order.astype("int32"), "side": side}

    def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(tokens(batch.column(0).to_numpy().view("uint64"), model), batch.column(1).to_numpy(), slots)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used].astype("int64"))], ["slot", "n"])

    total = counts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # as many rows as slots
    seen = np.zeros(slots)
    seen[total["slot"].to_numpy()] = total["n"].to_numpy()
    n = seen + 0.5
    rng = np.random.default_rng(5)
    weights = {k: np.zeros(s, "float32") if k in ("bend", "class_b", "word_b") else (rng.standard_normal(s) * 0.1).astype("float32") for k, s in shapes(side).items()}
    by_class = n.reshape(side, side)
    weights["class_b"] = np.log(by_class.sum(axis=1) / n.sum()).astype("float32")
    weights["word_b"] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype("float32")
    return model | weights | {"total": np.where(np.arange(slots) < own, 0, seen), "counts": counts}


def _sent(docs: DataFrame, model: dict) -> Broadcast:
    """The network for tasks: as many weights as slots ask for; the table of counts stays behind."""
    return docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "counts"})


_spots: dict[bytes, tuple[int, np.ndarray]] = W.Local()


def _spot(words: np.ndarray) -> tuple[int, np.ndarray]:
    """How many low bits of a hash stay out, and for each value of the others the first of the sorted words
    that could have it."""
    key = words.tobytes()
    if key not in _spots:
        bits = min(20, len(words).bit_length() + 4)
        edges = np.arange(1 << bits, dtype="uint64") << np.uint64(64 - bits)
        _spots.clear()
        _spots[key] = 64 - bits, np.searchsorted(words, edges).astype("int32")
    return _spots[key]


def tokens(hashes: np.ndarray, model: dict) -> np.ndarray:
    slots = model["side"] ** 2
    own = slots * FREQUENT // SIZE
    out = (own + (hashes.view("int64") % (slots - own))).astype("int32")
    if len(words := model["words"]):
        low, first = _spot(words)
        spot = np.minimum(first[hashes >> np.uint64(low)], len(words) - 1)
        later = np.flatnonzero(words[spot] < hashes)  # few words share the high bits of their hash
        while len(later):
            later = later[spot[later] < len(words) - 1]
            spot[later] += 1
            later = later[words[spot[later]] < hashes[later]]
        known = words[spot] == hashes
        out[known] = model["slots"][spot[known]]
    return out


def _padded(ids: np.ndarray, first: np.ndarray, pad: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The texts with SPAN pads between and around them, and where each token stands there."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids)) + SPAN * (text + 1)
    out = np.full(len(ids) + SPAN * len(first), pad, "int32")
    out[at] = ids
    return out, at


def _reach(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest exponent, either way, that hidden values (-1 to 1) can give."""
    return (np.abs(w).sum(axis=-1) + np.abs(b)).max(axis=-1)


def _softmax(z: np.ndarray, reach: float, n: int = 1) -> np.ndarray:
    """The softmax of every row over n; it takes the place of z."""
    if not reach < REACH:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (n * (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def _log_softmax(z: np.ndarray, reach: float, goal: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of every row at its goal; z is used up."""
    if not reach < REACH:
        z -= z.max(axis=1, keepdims=True)
    value = z[np.arange(len(z)), goal]
    return value - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _groups(classes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(classes.astype("int16") if side < 1 << 15 else classes, kind="stable")
    return order, np.searchsorted(classes[order], np.arange(side + 1))


def hidden(line: np.ndarray, at: np.ndarray, m: dict) -> np.ndarray:
    if not len(at):
        return np.zeros((0, WIDTH), "float32")
    lo, n = int(at.min()), int(at.max() - at.min()) + 1
    if n > 3 * len(at):  # places far apart
        lo, n, line, at = SPAN, len(at) * (2 * SPAN + 1) - 2 * SPAN, line[(at[:, None] + np.arange(-SPAN, SPAN + 1)).ravel()], np.arange(len(at)) * (2 * SPAN + 1) + SPAN
    near = line[lo - SPAN : lo + n + SPAN]
    left, right = np.take(m["left"], near, axis=0), np.take(m["right"], near, axis=0)
    total = np.repeat(m["bend"][None], n, axis=0)
    for k in range(1, SPAN + 1):
        total += left[SPAN - k : SPAN - k + n]
        total += right[SPAN + k : SPAN + k + n]
    total = total if len(at) == n else total[at - lo]
    return np.tanh(total, out=total)


def _with_one(h: np.ndarray) -> np.ndarray:
    """Rows with a last column of ones, which a bias goes with."""
    x = np.ones((len(h), h.shape[1] + 1), h.dtype)
    x[:, :-1] = h
    return x


def _with_bias(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of words, with their bias as the last column."""
    return tuple(np.concatenate([m[f"{k}_w"], m[f"{k}_b"][..., None]], axis=-1) for k in ("class", "word"))


def log_probabilities(line: np.ndarray, at: np.ndarray, m: dict) -> np.ndarray:
    """Log-probability of the token at each place given its neighbours."""
    out, side = np.empty(len(at)), len(m["class_b"])
    reach, reaches = _reach(m["class_w"], m["class_b"]), _reach(m["word_w"], m["word_b"])
    by_class, by_word = _with_bias(m)
    for lo in range(0, len(at), 1 << 15):
        some = at[lo : lo + (1 << 15)]
        x, goal = _with_one(hidden(line, some, m)), line[some]
        classes, value = goal // side, np.empty(len(some))
        for a in range(0, len(some), BATCH):
            value[a : a + BATCH] = _log_softmax(x[a : a + BATCH] @ by_class.T, reach, classes[a : a + BATCH])
        order, cuts = _groups(classes, side)
        x, goal, within = x[order], goal[order] - classes[order] * side, np.empty(len(some))
        for c in range(side):
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                within[a:b] = _log_softmax(x[a:b] @ by_word[c].T, reaches[c], goal[a:b])
        value[order] += within
        out[lo : lo + len(some)] = value
    return out


class Trainer:
    def __init__(self, model: dict):
        self.m = {k: model[k].copy() for k in SHAPES}
        self.gain = {k: np.full(v.shape, 1e-4, "float32") for k, v in self.m.items()}

    def _move(self, name: str, slope: np.ndarray) -> None:
        self.gain[name] += slope * slope
        self.m[name] -= RATE * slope / np.sqrt(self.gain[name])

    def learn(self, line: np.ndarray, at: np.ndarray) -> None:
        m, n, side = self.m, len(at), len(self.m["class_b"])
        h, goal = hidden(line, at, m), line[at]
        classes = goal // side
        x, (by_class, by_word) = _with_one(h), _with_bias(m)
        p = _softmax(x @ by_class.T, _reach(m["class_w"], m["class_b"]), n)
        p[np.arange(n), classes] -= 1 / n
        back = p @ m["class_w"]
        class_slope, word_slope, reaches = p.T @ x, np.zeros_like(by_word), _reach(m["word_w"], m["word_b"])
        order, cuts = _groups(classes, side)
        x, word, within = x[order], (goal - classes * side)[order], np.empty_like(h)
        for c in range(side):
            i, j = cuts[c], cuts[c + 1]
            if j > i:
                q = _softmax(x[i:j] @ by_word[c].T, reaches[c], n)
                q[np.arange(j - i), word[i:j]] -= 1 / n
                np.matmul(q, m["word_w"][c], out=within[i:j])
                np.matmul(q.T, x[i:j], out=word_slope[c])
        back[order] += within
        back = back * (1 - h * h)
        lo, hi = at[0] - SPAN, at[-1] + SPAN + 1
        near, spread = line[lo:hi], np.zeros((hi - lo + 2 * SPAN, WIDTH), "float32")
        spread[at - lo + SPAN] = back  # what each place of the line hears from the SPAN places on one side of it
        order = np.argsort(near, kind="stable")
        met, first = np.unique(near[order], return_index=True)
        sides = {}
        for name, sign in (("left", 1), ("right", -1)):
            heard = np.zeros((hi - lo, WIDTH), "float32")
            for k in range(1, SPAN + 1):
                heard += spread[SPAN + sign * k : SPAN + sign * k + hi - lo]
            sides[name] = np.zeros_like(m[name])
            sides[name][met] = np.add.reduceat(heard[order], first, axis=0)
        self._move("class_w", class_slope[:, :WIDTH])
        self._move("class_b", class_slope[:, WIDTH])
        self._move("word_w", word_slope[..., :WIDTH])
        self._move("word_b", word_slope[..., WIDTH])
        self._move("bend", back.sum(axis=0))
        for name, slope in sides.items():
            self._move(name, slope)


def share(w: W.Words, rounds: int) -> np.ndarray:
    """The round, 0 to rounds - 1, in which each position is learnt; it depends on the text alone."""
    place = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], np.diff(w.first))
    return W.mix(w.hashes ^ W.mix(place.astype("uint64"))) % np.uint64(rounds)


def train(docs: DataFrame, rounds: int = ROUNDS) -> dict:
    model = start(docs)
    learnt = 0
    for turn in range(rounds):
        shared: Broadcast = _sent(docs, model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            model = shared.value
            trainer, seen = Trainer(model), 0
            for batch in batches:
                for _, texts in W.blocks(batch.column(0)):
                    w = W.words_of(texts, lower=True, bodies=False)
                    line, at = _padded(tokens(w.hashes, model), w.first, model["side"] ** 2)
                    chosen = at[share(w, rounds) == turn]
                    for lo in range(0, len(chosen), BATCH):
                        trainer.learn(line, chosen[lo : lo + BATCH])
                    seen += len(chosen)
            if seen:
                flat = np.concatenate([trainer.m[k].ravel() for k in SHAPES]).astype("float64")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype="int32")), pa.array(np.r_[1.0, flat] * seen, pa.float32())], ["i", "weighted"])

        told = docs.select("text").mapInArrow(run, "i int, weighted float")  # -1: positions
        sums = told.groupBy("i").agg(F.sum("weighted").alias("value")).toArrow()  # the model's size
        if len(sums):
            flat = np.empty(len(sums))
            flat[sums["i"].to_numpy() + 1] = sums["value"].to_numpy()
            learnt += int(flat[0])
            flat, at = flat[1:] / flat[0], 0
            for k, s in shapes(model["side"]).items():
                size = int(np.prod(s))
                model = model | {k: flat[at : at + size].reshape(s).astype("float32")}
                at += size
    return model | {"learnt": learnt}


def _cut(words: np.ndarray, parts: int) -> list[int]:
    """Where each of `parts` ranges of hashes begins in sorted words, and the end."""
    edges = (np.arange(1, parts, dtype=object) * ((1 << 64) // parts)).astype("uint64")
    return [0, *np.searchsorted(words, edges).tolist(), len(words)]


BLOBS = "part int, asks int, words binary, number binary, text binary, keys binary, home long"
ANSWERS = "home long, keys binary, total binary, number binary"


def _blobs(words: np.ndarray, number: np.ndarray, text: np.ndarray | None, keys: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """Sorted words with a number each, and with the text each is asked for, a row for each range of hashes."""
    cuts, rows = _cut(words, parts), []
    home = None if keys is None else int(np.bitwise_xor.reduce(keys))  # those who ask are told together
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if b > a and text is None:
            rows.append((p, 0, W.pack(words[a:b]), W.pack(number[a:b]), None, None, None))
        elif b > a:
            used, at = np.unique(text[a:b], return_inverse=True)
            rows.append((p, 1, W.pack(words[a:b]), W.pack(number[a:b], 4), W.pack(at, 4), keys[used].tobytes(), home))
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in BLOBS.split(", ")])


def word_shares(docs: DataFrame, model: dict) -> DataFrame:
    """key (hash of a text) and mean (of the logarithm of the counts of its words in shared slots, each
    occurrence for itself) of all texts that have such words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = _sent(docs, model)
    own = model["side"] ** 2 * FREQUENT // SIZE

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).to_numpy().view("uint64"), batch.column(1).to_numpy()
            order = np.argsort(word)
            yield _blobs(word[order], n[order], None, None, parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            word, text = [], []
            for row, texts in W.blocks(batch.column(1)):
                w = W.words_of(texts, lower=True, bodies=False)
                new = np.zeros(len(texts), bool)
                for d, key in enumerate(keys[row : row + len(texts)].tolist()):
                    if key not in asked:
                        if len(asked) >= ASKED:
                            asked.clear()
                        asked.add(key)
                        new[d] = True
                of = np.repeat(np.arange(len(texts)), np.diff(w.first))
                some = new[of] & (tokens(w.hashes, shared.value) >= own)
                word.append(w.hashes[some])
                text.append(of[some] + row)
                if sum(map(len, word)) >= 1 << 21:
                    yield flush(word, text, keys)
            if word:
                yield flush(word, text, keys)

    def flush(words: list, texts: list, keys: np.ndarray) -> pa.RecordBatch:
        word, text = np.concatenate(words), np.concatenate(texts)
        words.clear()
        texts.clear()
        order = np.lexsort((text, word))
        word, text = word[order], text[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        return _blobs(word[first], np.diff(np.r_[first, len(word)]), text[first], keys, parts)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, []  # the counts of a range come before those who ask
        word, log_n = np.zeros(0, "uint64"), np.zeros(0)
        for batch in batches:
            for part, asks, words, number, text, keys, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, told, word, log_n = part, [], np.zeros(0, "uint64"), np.zeros(0)
                if not asks:
                    told.append((words, number))
                    continue
                if told:
                    word, n = (np.concatenate([W.unpack(x[k]) for x in told]) for k in (0, 1))
                    told, order = [], np.argsort(word)
                    word, log_n = word[order], np.log(n[order])
                of, n, at = W.unpack(words), W.unpack(number, 4).astype("int64"), W.unpack(text, 4).astype("int64")
                value = np.zeros(len(of))
                if len(word):
                    spot = np.minimum(np.searchsorted(word, of), len(word) - 1)
                    value = np.where(word[spot] == of, log_n[spot], 0.0)
                size = len(keys) // 8
                row = (home, keys, np.bincount(at, n * value, size).tobytes(), np.bincount(at, n, size).astype("int64").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] + [pa.binary()] * 3, strict=True)], [x.split()[0] for x in ANSWERS.split(", ")])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []  # the answers of one home lie together

        def flush() -> pa.RecordBatch:
            key, at = np.unique(np.frombuffer(b"".join(r[0] for r in rows), "int64"), return_inverse=True)
            total = np.bincount(at, np.frombuffer(b"".join(r[1] for r in rows)), len(key))
            n = np.bincount(at, np.frombuffer(b"".join(r[2] for r in rows), "int64"), len(key)).astype("int64")
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(total), pa.array(n)], ["key", "total", "n"])

        for batch in batches:
            for home, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and home != now:
                    yield flush()
                now = home
                rows.append(row)
        if rows:
            yield flush()

    rare = model["counts"].where("n > 1")  # log 1 is 0, as for a word that was not counted
    asks = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(ask, BLOBS)
    met = rare.mapInArrow(tell, BLOBS).unionAll(asks).repartition(parts, "part").sortWithinPartitions("part", "asks")
    home = met.mapInArrow(answer, ANSWERS).repartition(parts, "home").sortWithinPartitions("home")
    told = home.mapInArrow(gather, "key long, total double, n long")
    return told.groupBy("key").agg((F.sum("total") / F.sum("n")).alias("mean"))  # several tasks may ask for one text


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with n_tokens, log_likelihood (sum over tokens) and perplexity."""
    shared = _sent(docs, model)
    own = model["side"] ** 2 * FREQUENT // SIZE

    def run(texts: pa.Array) -> pa.Array:
        n, rare, total = [], [], []
        for _, block in W.blocks(texts):
            w = W.words_of(block, lower=True, bodies=False)
            m = shared.value
            ids = tokens(w.hashes, m)
            line, at = _padded(ids, w.first, m["side"] ** 2)
            few = ids >= own
            each = log_probabilities(line, at, m) - np.where(few, np.log(m["total"] + 1)[ids], 0.0)
            sums, fews = np.r_[0.0, np.cumsum(each)], np.r_[0, np.cumsum(few)]
            n += np.diff(w.first).tolist()
            rare += (fews[w.first[1:]] - fews[w.first[:-1]]).tolist()
            total += (sums[w.first[1:]] - sums[w.first[:-1]]).tolist()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(total, pa.float64())], ["n", "rare", "total"])

    got = docs.withColumns({"_lm": F.arrow_udf(run, "struct<n:long,rare:long,total:double>")("text"), "_lm_key": F.xxhash64("text")})
    shares = word_shares(docs, model).select(F.col("key").alias("_lm_key"), F.col("mean").alias("_lm_mean"))
    likely = F.col("_lm.total") + F.when(F.col("_lm.rare") > 0, F.col("_lm.rare") * F.col("_lm_mean")).otherwise(0.0)
    done = got.join(shares, "_lm_key", "left").withColumn("_lm_sum", likely)
    perplexity = F.when(F.col("_lm.n") > 0, F.exp(-F.col("_lm_sum") / F.col("_lm.n")))
    done = done.withColumns({"n_tokens": F.col("_lm.n"), "log_likelihood": F.col("_lm_sum"), "perplexity": perplexity})
    return done.drop("_lm", "_lm_key", "_lm_mean", "_lm_sum")
