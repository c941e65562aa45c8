"""Plain versions of the contracts, for small tables, and tables with all odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType()), T.StructField("ids", T.StringType())])


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, parts=3):
    """documents with columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "x", "y", "z", "w") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def odd_documents(seed=1):
    """Nulls, empties, ties, copies, near copies, shared passages, repeated rows, a very long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "été", "x.", "#&", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(90)
    rows = [(None, passage, "a"), (0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "one two", "b"), (4, "ONE  two", "b"), (5, "one two three four five", "b")]
    for k in range(10, 22):
        near = base.split()
        near[rng.randrange(len(near))] = f"edit{k}"
        rows.append((k, " ".join(near), "hot"))
    for k in range(30, 42):
        rows.append((k, text(30) + "\n" + passage + "  \n" + text(20), rng.choice(["hot", "a", None])))
    for k in range(50, 60):
        rows.append((k, base.upper() if k % 2 else base, "hot"))
    rows += [(70 + k, text(rng.randrange(1, 200)), "c") for k in range(25)]
    rows += [(99, text(30_000) + " " + passage, "long"), (100, "a " * 300, "c"), (101, "a " * 300, "c")]
    rows += [(30, rows[19 + 0][1], "hot")] if rows[19][0] == 30 else []
    rows += [(k, text(9) + " so" * (40 + k) + " " + text(9), "c") for k in range(110, 114)]  # one word over and over
    rows += [rows[8], rows[8]]
    return rows


def repeats(rows, window):
    """(n_words, places that are marked) of each row."""
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((w, gone))
    return out


def hits(rows, items, window=10):
    """(n_words, hit places, names of items) of each row."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = []
    for name, t in items:
        w = cut(t)
        n = min(len(w), window)
        grams += [(name, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    out = []
    for _, t, _ in rows:
        w, where, names = cut(t), set(), set()
        for name, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    where.update(range(k, k + len(g)))
                    names.add(name)
        out.append((w, where, names))
    return out


def shingles(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def linked(rows):
    """doc_id -> smallest doc_id reachable; rows of one id have one text."""
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def counts(text):
    w = words(text)
    t = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeat = {j for k in range(len(w) - 2) if t[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)
