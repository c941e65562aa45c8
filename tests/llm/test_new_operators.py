"""Collocations, license scan and conversation repair against plain versions, with all odd cases and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import types as T

from panelcast.llm import collocations, conversations, licenses
from tests.llm import plain

# Collocations ------------------------------------------------------------------------------


def phrase_counts(rows):
    """lang -> (n, Counter of phrases) of (lang, text) rows."""
    found = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                found["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return {k: (sum(c for p, c in f.items() if len(p) == 1), f) for k, f in found.items()}


def plain_collocations(rows, least, top):
    out = []
    for lang, (n, f) in phrase_counts(rows).items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= 100 * a for q in longer):
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (score, a, p, l, r, n) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["ab", "c", "de", "É", "日本", "f"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in enumerate(base)]
    rows += [(100, None, "en"), (101, "", None), (102, "One two, one TWO. one\ttwo! one\ntwo three one two three", "en")]
    rows += [(103, "one two three. " * 8, "en")] * 2 + [(104, "so so so so so so so", "en"), (None, "one two", "fr")]
    rows += [(105, "ab c de " * 3000 + "one two three", "en")]
    return rows


DOCS = "doc_id long, text string, lang string, n_chars long, phrase string, rank string, c string, pair string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("shard", [collocations.SHARD, 40])
def test_collocations(spark, prose, shard):
    got = collocations.collocations(docs_of(spark, prose), top=12, min_count=4, shard=shard)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == plain_collocations([(x, t) for _, t, x in prose], 4, 12)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, " .\n", "en")])).count() == 0


def test_collocation_arithmetic_is_exact(spark):
    big = 9_007_199_254_740_993  # no double holds it
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 2), ("en", "b", 1, big + 4), ("en", "", 0, big + 6)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, m int, f long")).first()
    assert (got.a, got.l, got.r, got.n) == (big, big + 2, big + 4, big + 6)
    assert got.score == 1000 * big * (big + 6) // ((big + 2) * (big + 4))


def test_trie_walks_like_a_set():
    rng = random.Random(3)
    words = [f"w{k}".encode() for k in range(300)]
    phrases = sorted({b" ".join(rng.choice(words) for _ in range(3)) for _ in range(4000)})
    langs = [rng.choice([b"x", b"y"]) for _ in phrases]
    trie = collocations.Trie.build(langs, phrases)
    import numpy as np
    import pyarrow as pa

    from panelcast.llm import words as W

    text = [rng.choice(words) for _ in range(20_000)] + phrases[7].split() + [b"unknown"]
    w = W.words_of(pa.array([b" ".join(text)], pa.large_binary()))
    for lang in (b"x", b"y"):
        at = np.full(len(text), trie.langs[lang])
        got = trie.accepted(at, w.hashes, np.zeros(len(text), "int64"))
        own = {p: i for i, (p, x) in enumerate(zip(phrases, langs, strict=True)) if x == lang}
        assert got.tolist() == [own.get(b" ".join(text[i : i + 3]), -1) if i + 3 <= len(text) else -1 for i in range(len(text))]


def test_a_trie_takes_few_bytes_a_phrase():
    import pickle

    phrases = [f"word{k}".encode() for k in range(20_000)]
    trie = collocations.Trie.build([b"x"] * len(phrases), phrases)
    assert len(pickle.dumps(trie, protocol=5)) < 100 * len(phrases)  # a copy goes to every worker
    assert sorted(trie.term[trie.term >= 0].tolist()) == list(range(len(phrases)))


def test_a_trie_is_built_in_time_that_follows_its_phrases():
    import time

    import numpy as np
    import pyarrow as pa

    from panelcast.llm import words as W

    rng = random.Random(5)
    words = [f"w{k}".encode() for k in range(90_000)]
    few = [f"w{k}".encode() for k in range(40)]
    pairs = sorted({b" ".join((rng.choice(few), rng.choice(words))) for _ in range(60_000)} | {w + b" w7" for w in words[:30_000]})
    for phrases in (words, pairs):
        langs = [rng.choice([b"x", b"y", b"z"]) for _ in phrases]
        start = time.process_time()
        trie = collocations.Trie.build(langs, phrases)
        assert time.process_time() - start < 5  # a search from place to place took 27 s for 86,000 words
        assert sorted(trie.term[trie.term >= 0].tolist()) == list(range(len(phrases)))
        w = W.words_of(pa.array([b" ".join(phrases)], pa.large_binary()))
        depth = len(w.hashes) // len(phrases)
        at = np.repeat([trie.langs[x] for x in langs], depth)
        assert trie.accepted(at, w.hashes, np.zeros(len(at), "int64"))[::depth].tolist() == list(range(len(phrases)))
        assert trie.last.to_pylist() == [p.split()[-1] for p in phrases]


def test_places_of_a_trie_grow_where_draws_fail(monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "ROUNDS", 1)
    rng = np.random.default_rng(7)
    part, code = np.divmod(np.unique(rng.integers(0, 500 * 40, 6000)), 40)
    base, check, edge = collocations._placed(part, code, 500, 41)
    assert np.array_equal(check[base[part] + code], part)
    assert np.array_equal(edge[base[part] + code], np.arange(len(part)))
    known = set(zip(part.tolist(), code.tolist(), strict=True))
    asked = [(p, c) for p in np.unique(part).tolist() for c in range(41)]
    assert {(p, c) for p, c in asked if check[base[p] + c] == p} == known


# Licenses ----------------------------------------------------------------------------------


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower(text))


def plain_scan(text):
    """n_words, n_base, first, last, base labels, labels, score of one text."""
    w = license_words(text)
    starts, base, labels, best = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        own = license_words(t.text)
        votes = {(i - j, j) for i in range(len(w) - 2) for j in range(len(own) - 2) if w[i : i + 3] == own[j : j + 3]}
        if t.exact:
            at = [d for d in range(len(w)) if w[d : d + len(own)] == own]
            starts += at
            base |= {t.label} if at else set()
            continue
        chains, last = [], None
        for d, j in sorted(votes):
            if last is None or d - last > licenses.SLACK:
                chains.append(set())
            chains[-1] |= {j, j + 1, j + 2}
            last = d
        share = max((len(c) / len(own) for c in chains), default=0)
        best = max(best, share)
        labels |= {t.label} if share >= licenses.SHARE else set()
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(w), len(starts), *ends, sorted(base), sorted(base | labels), 1.0 if starts else best


def license_rows():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["the", "software", "license", "under", "of", "is", "été", "x9", "cc", "by"]) for _ in range(n))
    rows = [(None, "under the MIT license"), (1, None), (2, ""), (3, "cc by"), (4, "CC-BY-NC " * 5), (5, "Under the\nMIT. License! apache license, version 2")]
    for k, t in enumerate(licenses.NOTICES):
        w = t.text.split()
        rows.append((10 + k, filler(20) + " " + t.text + " " + filler(9)))
        cut = w[: len(w) // 3] + ["and", "so"] + w[len(w) // 3 :]  # words put in
        rows.append((40 + k, " ".join(cut)))
        rows.append((70 + k, " ".join(w[: len(w) // 2]) + " " + filler(3)))  # half of it
    rows += [(100, filler(30_000) + " " + licenses.NOTICES[0].text), (101, "of the software " * 400), rows[8], rows[8], (12, "other text of an id under the mit license")]
    return rows + [(200 + k, filler(rng.randrange(80))) for k in range(30)]


def test_license_scan(spark):
    rows = license_rows()
    table = spark.createDataFrame([(i, t, "a", 1, "b", "c") for i, t in rows], "doc_id long, text string, tag string, size int, label string, score string")
    got = licenses.scan(table.repartition(4))
    want = [(i, *plain_scan(t)) for i, t in rows]
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {x for row in want for x in row[6]} == {t.label for t in licenses.TEMPLATES}
    assert licenses.scan(table.where("false")).count() == 0


# Conversations -----------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one damaged conversation."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in turns:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    known = [r[1] for r in turns if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, left):
        """(cost, audit, roles) from turn i on, with `left` turns that may still be put in before it."""
        options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        for role in ("user", "assistant"):
            if left and role[0] in follow[state]:
                c, s, rest = best(i, role[0], left - 1)
                options.append((c + 3, "I" + s, ((role, None), *rest)))
        if i < len(turns):
            own, more = turns[i][2], 3 * (faults[i] == "truncated")
            c, s, rest = best(i + 1, state, 3)
            options.append((c + 4, "D" + s, rest))
            if faults[i] not in ("blank", "duplicate"):
                for letter, role, cost in [("K", own, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if role[:1] and role[:1] in follow[state]:
                        c, s, rest = best(i + 1, role[:1], 3)
                        options.append((c + cost + more, letter + s, ((role, i), *rest)))
        return min(options, default=(10**9, "", ()))

    cost, audit, roles = best(0, "", 3)
    text = "\n".join(f"{role}:{'' if i is None else turns[i][3]}" for role, i in roles)
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


CONV = T.StructType([T.StructField(n, t) for n, t in [("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("audit", T.StringType()), ("code", T.StringType()), ("gaps", T.StringType()), ("absent", T.StringType())]])


def conversation_rows(seed=4):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "No", " \n", "", None, "Why?", "so!\t", "a.b", "é."]
    rows = []
    for c in range(400):
        for _ in range(rng.randrange(1, 7)):
            turn = rng.choice([None, *range(6)])
            rows.append((c, turn, rng.choice(roles if c % 2 else roles[:3]), rng.choice(texts) if c % 3 else f"Line {rng.random()}."))
    rows += [(None, k, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(9)]
    rows += [(900, None, "user", "x."), (900, None, None, None), (901, 3, "user", "again."), (901, 3, "user", "again.")]
    return rows


def test_conversation_repair(spark):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], CONV).repartition(5)
    got = conversations.audited(table, damage=True)
    groups = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    want = [(c, *plain_repair(g)) for c, g in groups.items()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert conversations.audited(table.where("false"), damage=True).count() == 0


def test_repaired_turns_alternate(spark):
    rows = conversation_rows(6)
    table = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], CONV)
    shape = {}
    for r in conversations.repaired(table).orderBy("conv_id", "place").collect():
        shape[r.conv_id] = shape.get(r.conv_id, "") + r.role[:1]
        assert r.edit != "I" or r.text == ""
    assert shape and all(re.fullmatch(r"s?(ua)+", s) for s in shape.values())


def test_long_conversations_equal_a_plain_recursion():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 17, 300]:
        codes = bytes(rng.randrange(16) for _ in range(n))
        cost, audit = conversations.cheapest(codes)
        full = [conversations._END]
        for code in reversed(codes):
            full.append(conversations._before(code, full[-1]))
        assert cost == full[-1][0] and audit.replace("I", "").__len__() == n
    cost, audit = conversations.cheapest(bytes([1, 2] * 50_000))
    assert cost == 0 and audit == "K" * 100_000


def test_dropped_conversations_stay(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(7, turn, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    got = conversations.audited(table, damage=True).first()
    assert tuple(got) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
