"""Phrases whose words stand together more often than their parts would by chance.

Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into words.
Everything is counted per lang. The steps:

1. Words are counted over all documents: in each task in numpy, then summed by Spark.
2. For m = 2 to MAX_WORDS: the frequent phrases of m - 1 words become a double-array trie over word codes, with
   the langs as first symbols, and are broadcast. In the tasks, numpy advances the states of all text positions
   at once, word by word. A phrase of m words can only be frequent if both its parts of m - 1 words are: where
   two neighbouring positions accept, their pair of accepting states is such a candidate. Pairs are counted in
   the task and summed by Spark. So every candidate that is counted is Apriori-safe and occurs; those that
   joining the parts would give besides, most of which occur nowhere, are never written out.
3. Cuts, scores, containment and ranks are joins and aggregations over the frequent phrases.

A trie holds at most SHARD phrases: more are split by the hash of the phrase, and the rounds go over all pairs
of shards, so what the driver holds and broadcasts is bounded whatever the input.

Null texts have no words, a null lang is `und`, repeated rows count again, rows need no id. A phrase has no
longest size; an empty table gives no rows. Columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.stage import keep

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Phrases that one trie holds.
SHARD = 1 << 21
#: Counters that a task gathers before it sends them.
SEND = 1 << 19
#: Bytes of text that are worked on at once.
BLOCK = 1 << 19
#: Children of a state that share a base on average, and draws of bases until a double array grows.
PART, ROUNDS = 4, 64
#: Parts of a lang that are ranked by themselves before the lang is.
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_BREAK_TABLE = _BREAK.tobytes()
_WORD_BYTE = ~_BREAK
_WORD_BYTE[[0x20, 0x09]] = False


def _blocks(batch: pa.RecordBatch, bodies: bool) -> Iterator[tuple[W.Words, np.ndarray]]:
    """(words, document of each word), a block of texts at a time; documents count from the first row of the batch."""
    for row, texts in W.blocks(batch.column("text"), BLOCK):
        w = W.words_of(texts, True, _WORD_BYTE, bodies)
        yield w, row + np.repeat(np.arange(len(texts)), np.diff(w.first))


def _pieces(w: W.Words, doc: np.ndarray) -> np.ndarray:
    """The piece of each word."""
    breaks = np.frombuffer(w.raw.tobytes().translate(_BREAK_TABLE), bool)
    return np.searchsorted(np.flatnonzero(breaks), w.begin) + doc


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the place of one of each, and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "int64")
    return keys[begin], order[begin], np.add.reduceat(counts[order], begin) if len(keys) else counts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count) of the words of a task; a word of no bytes counts all words of its lang."""
    langs: dict[bytes, int] = {}
    held: list[tuple] = []
    totals: dict[int, int] = {}

    def merged() -> tuple:
        keys, counts, lang = (np.concatenate([h[i] for h in held]) for i in range(3))
        keys, at, counts = _sums(keys, counts)
        text = pa.concat_arrays([h[3] for h in held]).take(pa.array(at))
        return keys, counts, lang[at], text

    def rows(counts, lang, text) -> pa.RecordBatch:
        names = pa.array(list(langs), pa.binary())
        return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), text.cast(pa.binary()), pa.array(counts)], ["lang", "word", "c"])

    for batch in batches:
        own = [langs.setdefault(x, len(langs)) for x in batch.column("lang").cast(pa.binary()).to_pylist()]
        of_doc = np.array(own, "int64")
        for w, doc in _blocks(batch, True):
            if not len(doc):
                continue
            lang = of_doc[doc]
            for code, n in enumerate(np.bincount(lang)):
                totals[code] = totals.get(code, 0) + int(n)
            keys, at, counts = _sums(W.mix(w.hashes + lang.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)), np.ones(len(doc), "int64"))
            spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(w.start), pa.py_buffer(w.data)])
            held.append((keys, counts, lang[at], spaced.take(pa.array(at))))
            if sum(len(h[0]) for h in held) > 2 * SEND:
                held = [merged()]
                if len(held[0][0]) > SEND:
                    yield rows(*held.pop()[1:])
    if held:
        yield rows(*merged()[1:])
    if totals:
        yield rows(np.array(list(totals.values()), "int64"), np.array(list(totals), "int64"), pa.array([b""] * len(totals), pa.large_binary()))


@dataclass
class Trie:
    """Phrases of equally many words as a double array. The children of a state are dealt to parts by their codes,
    about PART to each; the child by code c of a part is at place base[part] + c if check there says part. States
    0, 1, ... are the langs; code len(alphabet) is any unknown word."""

    alphabet: np.ndarray  # sorted hashes of the words
    langs: dict[bytes, int]
    depth: int
    first: np.ndarray  # part that begins each state with children, and the number of parts
    base: np.ndarray
    check: np.ndarray
    child: np.ndarray  # state at each place
    term: np.ndarray  # phrase that ends in a state
    lang_of: pa.Array  # of each phrase
    phrases: pa.Array
    last: pa.Array  # word of each phrase
    spots: np.ndarray | None = None  # place in the alphabet of the least hash with given high bits; made in the tasks

    @staticmethod
    def build(lang_of: list[bytes] | pa.Array, phrases: list[bytes] | pa.Array) -> Trie:
        # Every worker holds a copy: no phrase is an object of its own.
        lang_of, phrases = (pa.array(x, pa.large_binary()) if isinstance(x, list) else x.cast(pa.large_binary()) for x in (lang_of, phrases))
        hashes, last = zip(*(_hashes_and_last(texts) for _, texts in W.blocks(phrases, BLOCK)), strict=True)
        alphabet, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        codes = codes.reshape(len(phrases), -1)
        named = lang_of.dictionary_encode()
        langs = {x: i for i, x in enumerate(named.dictionary.to_pylist())}
        state = named.indices.to_numpy().astype("int64")
        order = np.lexsort([*codes.T[::-1], state])
        codes, state = codes[order], state[order]
        states, edges = len(langs), []
        for c in codes.T:
            new = np.r_[True, (state[1:] != state[:-1]) | (c[1:] != c[:-1])]
            edges.append((state[new], c[new]))
            state = states + np.cumsum(new) - 1
            states = int(state[-1]) + 1
        parent, code = (np.concatenate(x) for x in zip(*edges, strict=True))
        parts = -(-np.bincount(parent) // PART)
        first = np.r_[0, np.cumsum(parts)].astype("int32")
        base, check, child = _placed(first[parent] + code % parts[parent], code, int(first[-1]), len(alphabet) + 1)
        term = np.full(states, -1, "int32")
        term[state] = order
        return Trie(alphabet, langs, codes.shape[1], first, base, check, child + np.int32(len(langs)), term, lang_of, phrases, pa.concat_arrays(last))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each word."""
        size = len(self.alphabet)
        bits = size.bit_length() + 1
        low = np.uint64(64 - bits)
        if self.spots is None:
            self.spots = np.searchsorted(self.alphabet, np.arange(1 << bits, dtype="uint64") << low).astype("int32")
        code = np.minimum(self.spots[hashes >> low], size - 1)
        later = np.flatnonzero(self.alphabet[code] < hashes)  # few words share the high bits of their hash
        while len(later):
            later = later[code[later] < size - 1]
            code[later] += 1
            later = later[self.alphabet[code[later]] < hashes[later]]
        code[self.alphabet[code] != hashes] = size
        return code

    def accepted(self, lang: np.ndarray, hashes: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The phrase that begins at each word, else -1; lang: the state of its lang, else -1."""
        code = self.codes(hashes)
        here = np.flatnonzero((lang >= 0) & (code < len(self.alphabet)))
        state = lang[here]
        for j in range(self.depth):
            if j:
                ok = here + j < len(hashes)
                ok[ok] = piece[here[ok] + j] == piece[here[ok]]
                here, state = here[ok], state[ok]
            c, part = code[here + j], self.first[state]
            part = part + c % (self.first[state + 1] - part)
            place = self.base[part] + c
            ok = self.check[place] == part
            here, state = here[ok], self.child[place[ok]]
        found = np.full(len(hashes), -1, "int64")
        found[here] = self.term[state]
        return found


def _hashes_and_last(phrases: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Hashes of the words of phrases of equally many words, and the last word of each."""
    w = W.words_of(phrases, word_byte=_WORD_BYTE)
    spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.hashes), [None, pa.py_buffer(w.start), pa.py_buffer(w.data)])
    depth = len(w.hashes) // len(phrases)
    return w.hashes, pc.binary_slice(spaced.take(pa.array(np.arange(depth - 1, len(w.hashes), depth))), 0, -1)


def _placed(part: np.ndarray, code: np.ndarray, parts: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base of each part, and check and edge of each place, for the edges (part, code) of a double array.

    Parts of one size draw their bases together; those that fall on free places stay and the others draw again,
    so the work follows the number of edges. The largest go first, while most places are free. A part of one edge
    takes any place that is left.
    """
    room = 2 * len(part)
    base = np.zeros(parts, "int32")
    check = np.full(room + codes, -1, "int32")
    edge = np.zeros(room + codes, "int32")
    draw = np.random.default_rng(len(part))
    order = np.argsort(part, kind="stable")
    size = np.bincount(part, minlength=parts)
    begin = np.cumsum(size) - size
    for k in np.unique(size[size > 1])[::-1]:
        left = np.flatnonzero(size == k)
        rounds = 0
        while len(left):
            rounds += 1
            if rounds % ROUNDS == 0:  # too dense for parts of this size
                more = room // 2
                check, edge = np.r_[check, np.full(more, -1, "int32")], np.r_[edge, np.zeros(more, "int32")]
                room += more
            of = order[begin[left][:, None] + np.arange(k)]
            start = draw.integers(0, room, len(left))
            at = start[:, None] + code[of]
            ok = (check[at] < 0).all(1)
            check[at[ok]] = left[ok, None]
            won = (check[at] == left[:, None]).all(1)
            lost = at[ok & ~won]  # two drew the same place: it stays with one of them, or is free again
            check[lost[check[lost] == left[ok & ~won][:, None]]] = -1
            base[left[won]], edge[at[won]] = start[won], of[won]
            left = left[~won]
    single = np.flatnonzero(size == 1)
    of = order[begin[single]]
    free = np.flatnonzero(check[:room] < 0)[: len(single)]
    base[single], check[free], edge[free] = free - code[of], single, of
    return base, check, edge


def _pair_counts(left, right) -> Callable:
    """Counts of the neighbouring phrases (one of `left`, one of `right`) of a task, as one number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = left.value, right.value
        raw: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def gather() -> None:
            held.append(np.unique(np.concatenate(raw), return_counts=True))
            raw.clear()
            if len(held) > 1:
                both = [np.concatenate(x) for x in zip(*held, strict=True)]
                held[:] = [_sums(*both)[::2]]

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "c"])

        for batch in batches:
            names = batch.column("lang").cast(pa.binary()).to_pylist()
            of_doc = [np.array([t.langs.get(x, -1) for x in names], "int64") for t in (a, b)]
            for w, doc in _blocks(batch, False):
                piece = _pieces(w, doc)
                first = a.accepted(of_doc[0][doc], w.hashes, piece)
                second = first if a is b else b.accepted(of_doc[1][doc], w.hashes, piece)
                here = np.flatnonzero((first[:-1] >= 0) & (second[1:] >= 0) & (piece[:-1] == piece[1:]))
                raw.append(first[here] * len(b.phrases) + second[here + 1])
                if sum(map(len, raw)) > SEND:
                    gather()
                    if len(held[0][0]) > SEND:
                        yield rows()
        if raw:
            gather()
        if held:
            yield rows()

    return run


def _named(left, right) -> Callable:
    """The phrase of each pair of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = left.value, right.value
        for batch in batches:
            i, j = (pa.array(x) for x in np.divmod(batch.column("pair").to_numpy(), len(b.phrases)))
            space = pa.scalar(b" ", pa.large_binary())
            phrase = pc.binary_join_element_wise(a.phrases.take(i), b.last.take(j), space).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([a.lang_of.take(i).cast(pa.binary()), phrase, batch.column("c")], ["lang", "phrase", "f"])

    return run


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def frequent_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase (one word), f; the row of an empty phrase holds the number of all words of its lang."""
    counts = docs.mapInArrow(W.tidy(_word_counts), "lang binary, word binary, c long")
    # The words come with the space that ends them; words hold none.
    word = F.rtrim(F.col("word").cast("string"))
    summed = counts.groupBy(_text("lang"), word.alias("phrase")).agg(F.sum("c").alias("f"))
    return keep(summed.where((F.col("f") >= min_count) | (F.col("phrase") == "")))


def _tries(frequent: DataFrame, shard: int) -> list:
    """Broadcast tries of the phrases, each of a bounded number of them."""
    spark = frequent.sparkSession
    parts = -(-frequent.count() // shard)
    part = F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(parts, 1)))
    tries = []
    for k in range(parts):
        rows = frequent.where(part == k).select(F.col("lang").cast("binary"), F.col("phrase").cast("binary")).toArrow()
        if rows.num_rows:
            tries.append(spark.sparkContext.broadcast(Trie.build(*(rows[c].combine_chunks() for c in ("lang", "phrase")))))
    return tries


def longer_phrases(docs: DataFrame, frequent: DataFrame, min_count: int = MIN_COUNT, shard: int = SHARD) -> DataFrame:
    """lang, phrase, f of the frequent phrases with one word more than those of `frequent`."""
    tries = _tries(frequent, shard)
    out = frequent.where("false").select("lang", "phrase", "f")
    for a in tries:
        for b in tries:
            pairs = docs.mapInArrow(W.tidy(_pair_counts(a, b)), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
            named = pairs.where(F.col("c") >= min_count).mapInArrow(W.tidy(_named(a, b)), "lang binary, phrase binary, f long")
            out = out.unionByName(named.select(_text("lang"), _text("phrase"), "f"))
    done = keep(out)
    for t in tries:
        t.unpersist()
    return done


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard: int = SHARD) -> DataFrame:
    """lang, phrase, m (its words, 1 to max_words; 0: the row that counts all words of the lang), f."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = frequent_words(rows, min_count)
    level = words.where(F.col("phrase") != "")
    out = words.select("lang", "phrase", (F.col("phrase") != "").cast("int").alias("m"), "f")
    for m in range(2, max_words + 1):
        level = longer_phrases(rows, level, min_count, shard)
        out = out.unionByName(level.select("lang", "phrase", F.lit(m).alias("m"), "f"))
    return out


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, m, a, l, r, n, score of every phrase of two words or more, by its lowest-scoring cut."""
    w = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("m") - 1))
    cuts = frequent.where("m > 1").withColumnRenamed("f", "a").withColumn("k", k)
    cuts = cuts.withColumns(
        {
            "_left": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "),
            "_right": F.array_join(F.slice(w, F.col("k") + 1, F.col("m") - F.col("k")), " "),
        }
    )
    part = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), "f")
    for side, name in (("_left", "l"), ("_right", "r")):
        own = part.withColumnRenamed("f", name)
        cuts = cuts.join(own, (cuts["lang"] == own["_lang"]) & (cuts[side] == own["_part"])).drop("_lang", "_part")
    totals = frequent.where("m = 0").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "n", "l", "r")}
    over = (F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]).alias("_over")
    under = (exact["l"] * exact["r"]).alias("_under")
    cuts = cuts.select("*", over, under).withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "n", "cut.score")


def without_contained(candidates: DataFrame) -> DataFrame:
    """Leave out the phrases that a longer candidate holds and that occur no more often than it."""
    w = F.split("phrase", " ")
    m = F.col("m")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), m - 1),
            lambda size: F.transform(F.sequence(F.lit(1), m - size + 1), lambda i: F.array_join(F.slice(w, i, size), " ")),
        )
    )
    held = candidates.where("m > 2").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_inner"), F.col("a").alias("_a"))
    most = held.groupBy("_lang", "_inner").agg(F.max("_a").alias("_most"))
    joined = candidates.join(most, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_inner")), "left")
    return joined.where(F.col("_most").isNull() | (F.col("_most") < F.col("a"))).drop("_lang", "_inner", "_most")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, m of the `top` best phrases of each lang."""
    best = without_contained(scored(frequent_phrases(docs, min_count, max_words, shard)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    # A lang may hold most phrases: parts of it are cut to `top` before they meet.
    for keys in (["lang", "_salt"], ["lang"]):
        best = best.withColumn("_salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        best = best.where(F.col("rank") <= top).drop("_salt")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "m")
