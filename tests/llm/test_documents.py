"""Operators on documents against plain versions, on tables with all odd cases and on empty ones."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelcast.llm import fm_index, host_rules, pieces, prefix_join, suffix_array, winnowing
from panelcast.llm import words as W
from tests.llm import plain

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    return plain.odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return plain.table(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return plain.table(spark, [])


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pieces(docs, rows, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.tokenise(docs, MODEL).select("doc_id", "ids", "decoded")
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, ids, lib.decode(ids)))
    assert as_rows(got) == sorted(want, key=str)
    assert pieces.tokenise(none, MODEL).count() == 0


def test_pieces_on_hard_texts():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCodec(pieces.read_model(MODEL))
    rng = np.random.default_rng(2)
    alphabet = ["a", "e", "th", "er", " ", "  ", "\n", "\t", "é", "日", "😀", "▁", "1", ".", ",", "²", "<s>", "\u0000", "#", "-", "'"]
    texts = ["", " ", "  ", "\n", " a", "a ", "a\n b", "a \nb", "▁▁", " " * 40, "a" * 500, "<0x0A>"]
    texts += ["".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(2000)]
    for t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        own = np.frombuffer(codec.encode(t), "<u4")
        assert own.tolist() == ids
        assert codec.decode(own) == lib.decode(ids)
    # By a table that holds some of the words, in blocks of many texts.
    some = sorted({w for t in texts for w in t.replace("\n", " ").split(" ") if w and hash(w) % 3})
    columns = [w.encode() for w in some], [codec._encode_parts(pieces.SPACE + w) for w in some]
    table = pieces.Table.of(*(pa.array(c, pa.large_binary()) for c in columns))
    assert pieces.words_part(codec.model) and codec.parts is not None
    lines = ["\na", "a\n\nb", "a\n b", "a \nb", "a\n", "\n\n", "a b  c", "é 日本\n日本 ▁", "a\tb c"]
    block = pa.array(texts + lines, pa.large_string()).cast(pa.large_binary())
    got = [x for _, part in W.blocks(block, 1 << 12) for x in pieces.encode_block(codec, table, part)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_bos=True, add_eos=True) for t in texts + lines]
    for _ in range(300):
        ids = rng.integers(0, 32000, 40)
        assert codec.decode(ids) == lib.decode(ids.tolist())


@pytest.mark.parametrize("window", [5, 13])
def test_fm_index(docs, rows, none, window):
    want = [(i, len(w), len(g), plain.sha(" ".join(x for k, x in enumerate(w) if k not in g))) for (i, _, _), (w, g) in zip(rows, plain.repeats(rows, window), strict=True)]
    assert as_rows(fm_index.dedup(docs, window, 3)) == sorted(want, key=str)
    assert fm_index.dedup(none).count() == 0


@pytest.mark.parametrize("window", [8, 50])
def test_suffix_array(docs, rows, none, window):
    want = [(i, len(w), len(g)) for (i, _, _), (w, g) in zip(rows, plain.repeats(rows, window), strict=True) if g]
    got = suffix_array.repeated_documents(docs, window, 4).select("doc_id", "n_words", "n_removed")
    assert as_rows(got) == sorted(want, key=str)
    assert suffix_array.repeated_documents(none).count() == 0


@pytest.mark.parametrize("window", [8, 50])
def test_suffix_array_cuts_every_document(docs, rows, none, window):
    want = []
    for (i, _, _), (w, g) in zip(rows, plain.repeats(rows, window), strict=True):
        first = min((j for j, t, _ in rows if j is not None and plain.words(t) == w), default=None)
        copy_of = first if i is not None and len(w) >= window and first < i else None
        starts, ends = [k for k in sorted(g) if k - 1 not in g], [k + 1 for k in sorted(g) if k + 1 not in g]
        want.append((i, len(w), len(g), copy_of, list(zip(starts, ends, strict=True)), plain.sha(" ".join(x for k, x in enumerate(w) if k not in g))))
    got = [(*r[:4], [tuple(x) for x in r[4]], r[5]) for r in suffix_array.cut_documents(docs, window, 4).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_array.cut_documents(none).count() == 0


def test_hot_minimisers_change_nothing(docs, rows, monkeypatch):
    """All minimisers are split by whole windows: the results stay."""
    from panelcast.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 1)
    want = [(i, len(w), len(g)) for (i, _, _), (w, g) in zip(rows, plain.repeats(rows, 8), strict=True) if g]
    got = suffix_array.repeated_documents(docs, 8, 4).select("doc_id", "n_words", "n_removed")
    assert as_rows(got) == sorted(want, key=str)


def test_a_line_over_and_over_is_marked_as_one(spark):
    """A task that has sent a repeating passage marks its copies a span at a time, not a window at a time."""
    from panelcast.llm import repeats

    line = "one two three four five six seven eight nine ten eleven"
    table = [(i, f"w{i} " + " ".join([line] * 30) + f" x{i} y{i} " + " ".join([line] * 9), "en") for i in range(6)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").coalesce(1)
    keys = repeats._shared_keys(docs, 13, 4)
    texts = docs.join(F.broadcast(keys), "doc_id").select("doc_id", "text", "keys", "hot")
    at_once = repeats._segments(texts.coalesce(1).sortWithinPartitions("doc_id"), 13, 4).where("body is null")
    per_text = {r["doc_id"]: r["count"] for r in at_once.groupBy("doc_id").count().collect()}
    assert set(per_text) == {1, 2, 3, 4, 5} and max(per_text.values()) <= 2
    for window in (8, 13):
        want = [(i, len(w), len(g)) for (i, _, _), (w, g) in zip(table, plain.repeats(table, window), strict=True) if g]
        got = suffix_array.repeated_documents(docs, window, 4).select("doc_id", "n_words", "n_removed")
        assert as_rows(got) == sorted(want, key=str)


def test_small_shards_change_nothing(docs, rows, monkeypatch):
    from panelcast.llm import repeats

    monkeypatch.setattr(repeats, "SHARD_WORDS", 50)
    monkeypatch.setattr(repeats, "SENT", 3)
    want = [(i, len(w), len(g)) for (i, _, _), (w, g) in zip(rows, plain.repeats(rows, 13), strict=True)]
    assert as_rows(fm_index.dedup(docs).select("doc_id", "n_words", "n_removed")) == sorted(want, key=str)


def test_cut_passages(docs, rows, none):
    got = suffix_array.cut_repeats(docs)
    assert got.dtypes == docs.dtypes
    want = []
    for (i, _, s), (w, g) in zip(rows, plain.repeats(rows, 50), strict=True):
        left = [x for k, x in enumerate(w) if k not in g]
        if left or not w:
            want.append((i, left, s))
    have = [(r["doc_id"], plain.words(r["text"]), r["source"]) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())
    assert suffix_array.cut_repeats(none).count() == 0


def test_winnowing(spark, docs, rows, none):
    source = plain.words(rows[40][1])
    items = [("b1", " ".join(plain.words(rows[25][1])[35:60])), ("b2", "one two"), ("b3", "ONE two, three four"), ("b4", " ".join(source[:9])), ("b5", ""), ("b6", None), ("b7", "nothing like this is anywhere in all of these documents"), ("b1", " ".join(plain.words(rows[25][1])[35:60])), ("b8", "a a a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = winnowing.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "item_ids", "places")
    want = [(i, len(w), len(g), sorted(n), sorted(g)) for (i, _, _), (w, g, n) in zip(rows, plain.hits(rows, items), strict=True)]
    assert as_rows(got) == sorted(want, key=str)
    assert winnowing.decontaminate(none, bench).count() == 0
    free = winnowing.decontaminate(docs, bench.limit(0))
    assert free.count() == len(rows) and free.where("n_hit > 0").count() == 0
    left = winnowing.drop_contaminated(docs, bench)
    assert left.dtypes == docs.dtypes
    assert left.count() == sum(not g for _, g, _ in plain.hits(rows, items))


def test_prefix_join(docs, rows, none):
    known = plain.linked(rows)
    want = [(i, len(plain.shingles(t)), known[i][1] if i is not None else None) for i, t, _ in rows]
    assert as_rows(prefix_join.linked(docs)) == sorted(want, key=str)
    assert prefix_join.linked(none).count() == 0
    stay = prefix_join.keep_first(docs)
    assert stay.dtypes == docs.dtypes
    assert sorted(r[0] for r in stay.where("doc_id is not null").select("doc_id").collect()) == sorted({c for _, c in known.values()})
    assert stay.where("doc_id is null").count() == sum(i is None for i, _, _ in rows)


def test_prefix_join_needs_more_than_one_partner(spark):
    """A chain in which the ends don't link, and pairs just at and just under the limit."""
    w = [f"t{k}" for k in range(300)]
    rows = [(k, " ".join(w[12 * k : 12 * k + 104]), "c") for k in range(12)]  # neighbours: 88 of 112 shingles
    rows += [(100, " ".join(f"u{k}" for k in range(11)), "c"), (101, " ".join(f"u{k}" for k in range(10)) + " v", "c"), (102, " ".join(f"z{k}" for k in range(8)), "c"), (103, " ".join(f"z{k}" for k in range(7)), "c")]
    known = plain.linked(rows)
    assert len({c for _, c in known.values()}) < len(rows)
    got = prefix_join.linked(plain.table(spark, rows))
    assert as_rows(got) == sorted(((i, *known[i]) for i, _, _ in rows), key=str)


def test_host_rules(spark, docs, rows, none):
    got = {(r["doc_id"], r["n_words"]): r for r in host_rules.judge(docs).collect()}
    for i, t, _ in rows:
        n, chars, symbols, lines, repeat = plain.counts(t)
        r = got[i, n]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (chars, symbols, lines, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert host_rules.judge(none).count() == 0
    assert host_rules.judge(docs).count() == len(rows)


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"g{k}" for k in range(80))
    rows = [(k, good + str(k), "good") for k in range(40)] + [(100 + k, "a b c " * 40, "bad") for k in range(40)]
    rows += [(200, good, "bad"), (201, good, "seen once")]
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(plain.table(spark, rows)).collect()}
    assert all(kept[k] for k in range(40)) and kept[201]
    assert not any(kept[100 + k] for k in range(40)) and not kept[200]
    rates = host_rules.host_verdicts(host_rules.document_counts(plain.table(spark, rows)))
    one = {r["host"]: r for r in rates.collect()}
    assert 0 < one["seen once"]["rate_repeats"] < one["bad"]["rate_repeats"] < 1  # shrunken, not the raw rates


def test_native_plans_have_no_python(docs):
    for df in (host_rules.judge(docs), winnowing.decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_near_copies_are_not_paired_with_each_other(spark, monkeypatch):
    """500 near copies of one text and 60 texts that share half of it: few candidates are left to the last join."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{k}" for k in rng.integers(0, 5000, n)]
    base, rows = word(200), []
    for i in range(500):
        own = list(base)
        own[rng.integers(0, 200)] = f"x{i}"
        rows.append((i, " ".join(own), "a"))
    rows += [(1000 + i, " ".join(base[:100] + word(100)), "b") for i in range(60)]
    found, apart = [], prefix_join._apart

    def counted(*args):
        pairs = apart(*args)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(prefix_join, "_apart", counted)
    got = {r.doc_id: r.component_id for r in prefix_join.linked(plain.table(spark, rows, 6)).collect()}
    assert got == {i: component for i, (_, component) in plain.linked(rows).items()}
    assert found[0] < 2 * len(rows)


def test_an_encoder_goes_with_its_model():
    import gc
    import weakref

    class Shared:
        value = pieces.read_model(MODEL)

    codec = pieces._codec(Shared)
    text = "Größe  der Wörter\nund so"
    assert codec.decode(np.frombuffer(codec.encode(text), "<u4")) == text
    gone = weakref.ref(codec)
    gc.disable()
    try:
        del codec, Shared.value
        assert gone() is None  # without a collection, which a worker may never come to
    finally:
        gc.enable()
