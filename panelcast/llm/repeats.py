"""Passages that repeat across documents: what the two passage operators share.

A window is `window` consecutive words. A word is marked if a window over it also starts in a document
with a smaller doc_id. The steps:

1. Every document gets the SHA-256 of its words. Of documents with equal words only the one with the
   smallest id goes on; its copies are marked whole.
2. Windows are grouped by their least `gram`-word hash (minimiser), which equal windows share. Minimisers
   seen in one document only are dropped: they hold no repeat.
3. For each run of windows with one minimiser, its words (a segment) go to the task of that minimiser.
   A segment whose words the same task has already sent for a smaller id is marked at once, together
   with the marked ones that it meets.
4. There a kernel (an FM-index or a sparse suffix array) finds, for every window of every distinct
   segment, the smallest document that holds it.

A minimiser in very many documents would gather in one task. Above HOT documents, windows take the hash
of all their words in its place: equal windows still meet, and unlike ones spread over all tasks.

Null texts have no words. Documents with a null doc_id are neither compared nor marked. Rows that share
a doc_id are judged one by one and never against each other. Nothing is marked in an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.stage import keep

HOT = 2000
#: Words that a kernel works on at once; one minimiser's segments stay together.
SHARD_WORDS = 1 << 18
#: Segments that a task remembers as sent; forgetting costs time and changes nothing.
SENT = 200_000

#: (word ids, segment starts, anchor of each segment, document of each segment, window)
#: -> smallest document of each window, segment after segment.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _tag(body: bytes) -> int:
    return int.from_bytes(hashlib.sha256(body).digest()[:8], "little", signed=True)


def word_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sha (lowercase hex of all words joined by one space) and tag (its first eight
    bytes, which tell apart rows of one doc_id) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, tag = [], [], []
            for _, texts in W.blocks(batch.column(1)):
                w = W.words_of(texts)
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    n.append(b - a)
                    digest = hashlib.sha256(w.body(a, b)).digest()
                    sha.append(digest.hex())
                    tag.append(int.from_bytes(digest[:8], "little", signed=True))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(tag, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "sha", "tag"])

    return docs.select("doc_id", "text").mapInArrow(W.tidy(run), "doc_id long, n_words long, sha string, tag long")


class Minimisers:
    """Windows of a block and the minimiser of each."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.words = w = W.words_of(texts)
        g = W.grams(w.hashes, gram)
        at = W.least_at(g, window - gram + 1)
        self.window_at = np.flatnonzero(W.inside(w.first, window, len(at)))  # first words of windows
        self.least = at[self.window_at]
        self.key = g[self.least]
        self.row = np.searchsorted(w.first, self.window_at, "right") - 1


def _shared_keys(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id and its minimisers that two documents or more have: keys (sorted) and hot (a byte each)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, docs_of, seen = [], [], {}
            for row, texts in W.blocks(batch.column(1)):
                m = Minimisers(texts, window, gram)
                for d in range(len(texts)):  # of equal texts in a batch only the smallest id can go on
                    tag = _tag(m.words.body(m.words.first[d], m.words.first[d + 1]))
                    seen[tag] = min(seen.get(tag, (1 << 63, 0)), (int(ids[row + d]), row + d))
                first = np.ones(len(m.key), bool)
                first[1:] = (m.least[1:] != m.least[:-1]) | (m.row[1:] != m.row[:-1])
                keys.append(m.key[first])
                docs_of.append(m.row[first] + row)
            if not keys:
                continue
            alive = np.zeros(len(ids), bool)
            alive[[r for _, r in seen.values()]] = True
            key, row = np.concatenate(keys), np.concatenate(docs_of)
            key, row = key[alive[row]], row[alive[row]]
            order = np.argsort(key, kind="stable")
            key, doc = key[order], ids[row[order]].astype("int64").view("uint64")
            cuts = np.searchsorted(key, (np.arange(1, parts, dtype=object) * ((1 << 64) // parts)).astype("uint64"))
            cuts = [0, *cuts.tolist(), len(key)]
            full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([W.pack(key[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()),
                    pa.array([W.pack(doc[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()),
                ],
                ["part", "keys", "docs"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of: dict[int, list] = {}
        for batch in batches:
            for p, k, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts_of.setdefault(p, []).append((k, d))
        for pairs in parts_of.values():
            key = np.concatenate([W.unpack(k) for k, _ in pairs])
            doc = np.concatenate([W.unpack(d) for _, d in pairs])
            pairs.clear()
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            many = np.repeat(count, count)
            key, doc, many = key[many > 1], doc[many > 1], many[many > 1]
            hot = (many > HOT).astype("uint8")
            home = (doc.view("int64") % parts).astype("int32")
            order = np.argsort(home, kind="stable")
            key, doc, hot = key[order], doc[order], hot[order]
            cuts = np.searchsorted(home[order], np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([W.pack(key[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()),
                    pa.array([W.pack(doc[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()),
                    pa.array([hot[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()),
                ],
                ["part", "keys", "docs", "hot"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[int, list] = {}
        for batch in batches:
            for p, k, d, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                homes.setdefault(p, []).append((k, d, h))
        for rows in homes.values():
            key = np.concatenate([W.unpack(k) for k, _, _ in rows])
            doc = np.concatenate([W.unpack(d) for _, d, _ in rows])
            hot = np.concatenate([np.frombuffer(h, "uint8") for _, _, h in rows])
            rows.clear()
            order = np.lexsort((key, doc))
            key, doc, hot = key[order], doc[order], hot[order]
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            ends = np.r_[starts[1:], len(doc)]
            for lo in range(0, len(starts), 5000):
                s, e = starts[lo : lo + 5000], ends[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[s].view("int64")),
                        pa.array([key[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary()),
                        pa.array([hot[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "keys", "hot"],
                )

    asked = docs.mapInArrow(ask, "part int, keys binary, docs binary").repartition(parts, "part")
    met = asked.mapInArrow(answer, "part int, keys binary, docs binary, hot binary").repartition(parts, "part")
    return met.mapInArrow(W.tidy(gather), "doc_id long, keys binary, hot binary")


#: n windows from word `at` on; times: how often the segment follows itself, a word further each time.
SEGMENT = "key long, doc_id long, tag long, at int, n int, anchor int, times int, body binary"


def _joined(out: list[tuple], window: int) -> list[tuple]:
    """Segments in which those marked at once (without a body) that meet or touch in a text are one.

    A line over and over in a text, and passages of many documents, mark nearly every segment of a text.
    """
    done: list[tuple] = []
    open_, end = -1, 0  # the last marked segment, and where its words end
    for x in out:
        if x[7] is None:
            stop = x[3] + x[4] + x[6] - 2 + window
            if open_ >= 0 and done[open_][1:3] == x[1:3] and done[open_][3] <= x[3] <= end:
                end = max(end, stop)
                at = done[open_][3]
                done[open_] = (*done[open_][:4], end - at + 1 - window, x[5], 1, None)
                continue
            open_, end = len(done), stop
        done.append(x)
    return done


def _segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments of shared minimisers; texts: doc_id, text, keys, hot (as _shared_keys gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, hots = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, texts in W.blocks(batch.column(1)):
                m = Minimisers(texts, window, gram)
                w, out = m.words, []
                cuts = np.searchsorted(m.row, np.arange(len(texts) + 1))
                for d in range(len(texts)):
                    lo, hi = cuts[d], cuts[d + 1]
                    if lo == hi:
                        continue
                    shared = np.frombuffer(keys[row + d], "uint64")  # sorted
                    hot = np.frombuffer(hots[row + d], "uint8").astype(bool)
                    spot = np.minimum(np.searchsorted(shared, m.key[lo:hi]), len(shared) - 1)
                    ok = shared[spot] == m.key[lo:hi]
                    doc, base = ids[row + d], int(w.first[d])
                    tag = _tag(w.body(base, int(w.first[d + 1])))
                    at, least, key = m.window_at[lo:hi], m.least[lo:hi], m.key[lo:hi].view("int64")
                    one = hot[spot]  # each window of a hot minimiser stands alone
                    new = np.ones(hi - lo, bool)
                    new[1:] = (least[1:] != least[:-1]) | one[1:]
                    begins = np.flatnonzero(new)
                    stops = np.r_[begins[1:], hi - lo]
                    for b, e in zip(begins[ok[begins]].tolist(), stops[ok[begins]].tolist(), strict=True):
                        a, n = int(at[b]), e - b
                        body = w.body(a, a + n - 1 + window)
                        k = _tag(body) if one[b] else int(key[b])
                        last = out[-1] if out else None
                        if last and n == 1 and last[7] == body and last[1:3] == (doc, tag) and last[3] + last[6] == a - base:
                            out[-1] = (*last[:6], last[6] + 1, body)  # one word over and over
                        else:
                            out.append((k, doc, tag, a - base, n, int(least[b]) - a, 1, body))
                for i, x in enumerate(out):
                    before = sent.get(x[7])
                    if before is not None and before < x[1]:
                        out[i] = (x[2] ^ x[3], *x[1:7], None)
                    elif before is None or before > x[1]:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent[x[7]] = x[1]
                out = _joined(out, window)
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])

    return texts.mapInArrow(W.tidy(run), SEGMENT)


def _judge(rows: list[tuple], window: int, kernel: Kernel) -> list[tuple]:
    """(doc_id, tag, start, end) of marked runs of windows, as word ranges, of a shard's segments."""
    out, numbers = [], {}
    least: dict[tuple[int, bytes], int] = {}
    for key, doc, _, _, _, _, _, body in rows:
        if body is not None:
            k = (key, body)
            least[k] = min(doc, least.get(k, doc))
    flat: list[int] = []
    starts, anchors, docs, index = [0], [], [], {}
    for key, doc, _, _, _, anchor, _, body in rows:
        if body is None or (key, body) in index:
            continue
        index[key, body] = len(docs)
        flat += [numbers.setdefault(x, len(numbers) + 1) for x in body.split()]
        starts.append(len(flat))
        anchors.append(anchor)
        docs.append(least[key, body])
    if docs:
        starts = np.array(starts)
        smallest = kernel(np.array(flat, "int64"), starts, np.array(anchors), np.array(docs, "int64"), window)
        offsets = np.r_[0, np.cumsum(np.diff(starts) - window + 1)]
    for key, doc, tag, at, n, _, times, body in rows:
        if body is None or least[key, body] < doc:
            out.append((doc, tag, at, at + n + times - 2 + window))
            continue
        o = offsets[index[key, body]]
        hit = np.flatnonzero(smallest[o : o + n] < doc)
        if len(hit):
            gap = np.flatnonzero(np.diff(hit) > 1)
            for a, b in zip(np.r_[hit[0], hit[gap + 1]].tolist(), np.r_[hit[gap], hit[-1]].tolist(), strict=True):
                out.append((doc, tag, at + a, at + b + times - 1 + window))
    return out


MARKS = "home int, docs binary, tags binary, starts binary, ends binary"


def _marks(segments: DataFrame, window: int, kernel: Kernel) -> DataFrame:
    """doc_id, tag and spans (merged) of all marked words.

    Hot passages give a mark for every window of every copy, so a task's marks travel as blobs to the home of
    their document, and meet there.
    """
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            marks = np.array(_judge(rows, window, kernel), "int64").reshape(-1, 4)
            rows.clear()
            home = marks[:, 0] % parts
            order = np.argsort(home, kind="stable")
            marks, cuts = marks[order], np.searchsorted(home[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            blobs = [[W.pack(marks[cuts[p] : cuts[p + 1], i].view("uint64"), 8 if i < 2 else 4) for p in full] for i in range(4)]
            columns = [pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)]
            if len(full):
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MARKS.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_WORDS and row[0] != last:
                    yield from flush()
                    size = 0
                rows.append(row)
                last = row[0]
                size += row[4] + window - 1 if row[7] is not None else 1
        if rows:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the marks of a home lie together

        def flush() -> pa.RecordBatch:
            doc, tag, start, end = (np.concatenate(x).view("int64") for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, tag, doc))
            doc, tag, start, end = doc[order], tag[order], start[order], end[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
            spans = [merge_spans(list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True))) for a, b in zip(new, np.r_[new[1:], len(doc)], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            listed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
            return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(tag[new]), listed], ["doc_id", "tag", "spans"])

        for batch in batches:
            for home, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and home != now:
                    yield flush()
                now = home
                held.append([W.unpack(x, 8 if i < 2 else 4) for i, x in enumerate(blobs)])
        if held:
            yield flush()

    # Equal minimisers lie together in a task; sorting lets a shard end between two of them.
    ready = segments.repartition("key").sortWithinPartitions("key")
    sent = ready.mapInArrow(W.tidy(run), MARKS).repartition(parts, "home").sortWithinPartitions("home")
    return sent.mapInArrow(W.tidy(gather), "doc_id long, tag long, spans array<struct<start:int,end:int>>")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def mark_repeats(docs: DataFrame, window: int, gram: int, kernel: Kernel) -> DataFrame:
    """doc_id, n_words, sha, tag, copy_of (smallest id with the same words, if it is smaller and the document
    is marked whole for it) and spans (array of start and end words, merged) of every document."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(word_digests(work))
    known = F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    classes = rows.where(known).groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    keys = _shared_keys(work.where(F.col("doc_id").isNotNull()), window, gram)
    first = classes.select(F.col("first_id").alias("doc_id")).distinct()
    keys = keys.join(first, "doc_id", "left_semi")
    texts = work.join(keys, "doc_id").select("doc_id", "text", "keys", "hot")
    spans = _marks(_segments(texts, window, gram), window, kernel)
    out = rows.join(classes, "sha", "left").join(spans, ["doc_id", "tag"], "left")
    whole = F.col("first_id") < F.col("doc_id")
    return out.select(
        "doc_id",
        "n_words",
        "sha",
        "tag",
        F.when(whole, F.col("first_id")).alias("copy_of"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))))
        .otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
        .alias("spans"),
    )


#: What a cut text is: its words joined by one space, or the text as it was without the marked words.
KEPT = "doc_id long, tag long, n_removed long, kept_sha string, kept string"


def cut_words(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, tag, n_removed, kept_sha (of the kept words joined by one space) and kept (the text without
    the marked words, other white space as it was), for each doc_id and text that has marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, spans = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for row, texts in W.blocks(batch.column(1)):
                w = W.words_of(texts)
                for d in range(len(texts)):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if _tag(w.body(a, b)) != tags[row + d]:
                        continue  # another row of this doc_id
                    gone = merge_spans([(x["start"], x["end"]) for x in spans[row + d]])
                    stays, at = [], 0
                    for x, y in [*gone, (b - a, b - a)]:
                        if x > at:
                            stays.append(w.body(a + at, a + x))
                        at = y
                    raw = texts[d].as_py()
                    spots = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
                    text, at = [], 0
                    for x, y in gone:
                        text.append(raw[at : spots[x][0]])
                        at = spots[y][0] if y < len(spots) else len(raw)
                    text.append(raw[at:])
                    sha = hashlib.sha256(b" ".join(stays)).hexdigest()
                    out.append((ids[row + d], tags[row + d], sum(y - x for x, y in gone), sha, b"".join(text).decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])

    some = marks.where(F.size("spans") > 0).dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id")
    return texts.select("doc_id", "text", "tag", "spans").mapInArrow(W.tidy(run), KEPT).dropDuplicates(["doc_id", "tag"])
