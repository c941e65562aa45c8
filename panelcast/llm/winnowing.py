"""Benchmark decontamination by winnowing, all in DataFrame functions.

Texts are cut into words; every GRAM consecutive words are hashed; of every WIN consecutive hashes the
least (leftmost of equals) is kept as a fingerprint. GRAM + WIN - 1 is the window length, so every shared
window has a shared fingerprint at the same place. Documents and items are joined on fingerprints, and
each alignment that they give is extended word by word to all windows it holds.

A null text has no words. Items of fewer words than a window, but not none, are one window: their whole
word sequence is the fingerprint. Repeated rows give the same result each. Null item ids count as an
item and mark words, but are not listed. Empty tables give no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.stage import keep, let, row_key, split_words

WINDOW, GRAM = 10, 5
#: A fingerprint is the upper bits of a hash over a position; no text holds 2^28 words.
POSITION_BITS = 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return split_words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT)


def _pack(value: Column, at: Column) -> Column:
    return F.shiftleft(F.shiftright(value, POSITION_BITS), POSITION_BITS).bitwiseOR(at.cast("long"))


def gram_at(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def fingerprints(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Packed fingerprints of a word array, with places from 0; none for fewer words than a window."""
    win = window - gram + 1

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - gram), lambda i: _pack(F.xxhash64(*[h[i + j] for j in range(gram)]), i))

    def least(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(g) - win), lambda i: F.least(*[g[i + j] for j in range(win)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    picked = F.array_distinct(let(let(hashes, grams), least))
    return F.when(F.size(words) >= window, picked).otherwise(F.array().cast("array<bigint>"))


def whole_grams(words: Column, n: int) -> Column:
    """Packed hashes of every n consecutive words, for items of n words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    all_at = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: _pack(F.xxhash64(*[h[i + j] for j in range(n)]), i)))
    return F.when(F.size(words) >= n, all_at).otherwise(F.array().cast("array<bigint>"))


def _hit_places(doc: Column, item: Column, shift: Column, window: int) -> Column:
    """Places of document words that item windows cover when the item's word 0 lies at `shift`.

    The overlap starts at `low` of the item; the result is empty where no whole window agrees.
    """
    n = F.least(F.size(item), F.lit(window))
    low = F.greatest(F.lit(0), -shift)
    length = F.least(F.size(item), F.size(doc) - shift) - low

    def windows(same: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), length - n), lambda i: F.forall(F.slice(same, i + 1, n), lambda x: x))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(shift + low + i, shift + low + i + n - 1))))

    same = F.zip_with(F.slice(doc, shift + low + 1, length), F.slice(item, low + 1, length), lambda a, b: a == b)
    return F.when(length >= n, let(same, windows)).otherwise(F.array().cast("array<int>"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (array<string>, sorted) and places (hit words) of every document, and
    key, which row_key gives for its doc_id and text."""
    work = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    bench = items.select(
        F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item_words")
    ).where(F.size("item_words") > 0)
    short = sorted(r[0] for r in bench.select(F.size("item_words").alias("n")).where(F.col("n") < window).distinct().collect())  # below the window
    shape = lambda w: F.struct(F.size(w).alias("n_words"), fingerprints(w, window, gram).alias("marks"), *[whole_grams(w, n).alias(f"whole_{n}") for n in short])
    base = keep(work.select("doc_id", "key", let(words_of(F.col("text")), shape).alias("w")).select("doc_id", "key", "w.*"))

    def candidates(marks: str, of: DataFrame, make) -> DataFrame:
        left = base.select("key", F.explode(marks).alias("mark")).select("key", gram_at(F.col("mark")).alias("gram"), place_of(F.col("mark")).alias("at"))
        right = of.select("item_id", "item_words", F.explode(make(F.col("item_words"))).alias("mark"))
        right = right.select("item_id", "item_words", gram_at(F.col("mark")).alias("gram"), place_of(F.col("mark")).alias("item_at"))
        return left.join(right, "gram").select("key", "item_id", "item_words", (F.col("at") - F.col("item_at")).alias("shift"))

    found = candidates("marks", bench.where(F.size("item_words") >= window), lambda w: fingerprints(w, window, gram))
    for n in short:
        found = found.unionByName(candidates(f"whole_{n}", bench.where(F.size("item_words") == n), lambda w, n=n: whole_grams(w, n)))
    found = keep(found.distinct())
    texts = work.join(found.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    pairs = texts.select("key", words_of(F.col("text")).alias("doc_words")).join(found, "key")
    hits = pairs.select("key", "item_id", _hit_places(F.col("doc_words"), F.col("item_words"), F.col("shift"), window).alias("places"))
    hits = hits.where(F.size("places") > 0)
    places = hits.select("key", F.explode("places").alias("place")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    names = hits.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per_doc = places.join(names, "key")
    out = base.select("doc_id", "key", "n_words").join(per_doc, "key", "left")
    return out.select(
        "doc_id",
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("places", F.array().cast("array<int>")).alias("places"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a window of an item; columns as they were."""
    found = decontaminate(docs, items).where("n_hit > 0").select(F.col("key").alias("_key")).distinct()
    return docs.join(found, row_key(docs["doc_id"], docs["text"]) == found["_key"], "left_anti")
