"""Near-duplicate components by a grouped prefix join on word shingles.

A document is the set of its distinct SHINGLE-word shingles. Two documents link at a Jaccard similarity
of PERCENT or more. The steps:

1. Documents with equal sets are one class; the smallest id stands for it.
2. Shingles are counted over all documents. The rarest come first in one common order; a document whose
   prefix (its first n - ceil(PERCENT n / 100) + 1 shingles) holds only shingles of its own can link with
   nothing and is done.
3. Documents with the same size and the same shared part of the prefix are one group. Members are verified
   against the group's least document.
4. Groups meet over the shingles of their prefixes. In rounds, each document is verified against one
   likely partner of another component, chosen by the number of prefix shingles in common, as long as that
   links a fair share of those that asked.
5. What is left is exact: every pair of groups that have a prefix shingle in common, pass the filters by
   size and by place and have members in different components is expanded into its members, and these are
   verified. Documents that are already linked by others are never paired, so a group of copies isn't
   expanded into its pairs.

Null texts and texts without words have empty sets and link with nothing. Rows with a null doc_id keep a
null component. Rows that share a doc_id are one document: if their texts differ, each counts its own
shingles, and the one with the least digest is compared. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.components import components
from panelcast.llm.stage import keep

SHINGLE, PERCENT = 5, 75
#: Step 4 goes on while one in so many documents that asked finds a link.
ROUNDS_SHARE = 10
#: Shingles that a task gathers before it sends them, and bytes of text that it works on at once.
SEND, BLOCK = 1 << 19, 1 << 19
#: Shingles, each as often as classes have it, that a range of hashes holds on average.
RANGE = 1 << 20
#: Bytes of a shingle's hash that are sent.
SENT_BYTES = 7


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for row, part in W.blocks(texts, BLOCK):
        w = W.words_of(part, lower=True)
        g = W.grams(w.hashes, SHINGLE)
        for d in range(len(part)):
            a, b = int(w.first[d]), int(w.first[d + 1])
            own = W.grams(w.hashes[a:b], b - a) if 0 < b - a < SHINGLE else g[a : max(a, b - SHINGLE + 1)]
            yield row + d, np.unique(own >> np.uint64(64 - 8 * SENT_BYTES))


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), hashlib.sha256(s.tobytes()).digest()[:16]) for _, s in shingle_sets(batch.column(1))]
            columns = [batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest"])

    return docs.mapInArrow(W.tidy(run), "doc_id long, n long, digest binary")


def _shared_shingles(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n, shared (its shingles that others have, sorted) and prefix (the shared ones of its prefix,
    rarest first) of every class representative with a prefix that another document can match."""
    # Ranges of hashes follow what is counted, so a task gathers a bounded part whatever the session's setting.
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    width = 8 * SENT_BYTES

    def batch_of(kind: np.ndarray, **blobs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs.values())], ["part", *blobs])

    def send(sets: dict[bytes, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        token = np.concatenate([s for _, s in sets.values()])
        doc = np.repeat(np.array([i for i, _ in sets.values()], "int64"), [len(s) for _, s in sets.values()])
        sets.clear()
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order].view("uint64")
        cuts = np.searchsorted(token, np.array([(p << width) // parts for p in range(1, parts)], "uint64"))
        cuts = [0, *cuts.tolist(), len(token)]
        full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
        return batch_of(
            full,
            tokens=[W.pack(token[cuts[p] : cuts[p + 1]], SENT_BYTES) for p in full],
            docs=[W.pack(doc[cuts[p] : cuts[p + 1]]) for p in full],
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, tuple[int, np.ndarray]] = {}  # of equal sets only the smallest id can stand
        waiting = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, s in shingle_sets(batch.column(1)):
                tag = hashlib.sha256(s.tobytes()).digest()[:16]
                if len(s) and (tag not in sets or ids[row] < sets[tag][0]):
                    waiting += 0 if tag in sets else len(s)
                    sets[tag] = (int(ids[row]), s)
                    if waiting >= SEND:
                        yield send(sets)
                        waiting = 0
        if sets:
            yield send(sets)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list] = {}
        for batch in batches:
            for p, t, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(p, []).append((t, d))
        for pairs in pieces.values():
            token = np.concatenate([W.unpack(t, SENT_BYTES) for t, _ in pairs])
            doc = np.concatenate([W.unpack(d) for _, d in pairs])
            pairs.clear()
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]
            token, doc = token[new], doc[new]
            count = np.unique(token, return_counts=True)[1]
            many = np.repeat(count, count)
            token, doc = token[many > 1], doc[many > 1]
            rarity = np.minimum(np.log2(many[many > 1]), 255).astype("uint8")  # how rare, in powers of two
            home = (doc.view("int64") % parts).astype("int32")
            order = np.argsort(home, kind="stable")
            token, doc, rarity, home = token[order], doc[order], rarity[order], home[order]
            cuts = np.searchsorted(home, np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            yield batch_of(
                full,
                tokens=[W.pack(token[cuts[p] : cuts[p + 1]], SENT_BYTES) for p in full],
                docs=[W.pack(doc[cuts[p] : cuts[p + 1]]) for p in full],
                extra=[rarity[cuts[p] : cuts[p + 1]].tobytes() for p in full],
            )

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = (batch.column(i).to_numpy() for i in (0, 1))
            home = (doc % parts).astype("int32")
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(parts + 1))
            full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            yield batch_of(
                full,
                tokens=[None] * len(full),
                docs=[W.pack(doc[order[cuts[p] : cuts[p + 1]]]) for p in full],
                extra=[W.pack(n[order[cuts[p] : cuts[p + 1]]]) for p in full],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[int, list] = {}
        for batch in batches:
            for p, t, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                homes.setdefault(p, []).append((t, d, x))
        for rows in homes.values():
            own = [(W.unpack(d), W.unpack(x)) for t, d, x in rows if t is None]
            got = [(W.unpack(t, SENT_BYTES), W.unpack(d), np.frombuffer(x, "uint8")) for t, d, x in rows if t is not None]
            rows.clear()
            if not own or not got:
                continue
            ids, size = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(ids)
            ids, size = ids[order], size[order].astype("int64")
            token, doc, rarity = (np.concatenate(x) for x in zip(*got, strict=True))
            spot = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            ok = ids[spot] == doc
            token, spot, rarity = token[ok], spot[ok], rarity[ok]
            order = np.lexsort((token, rarity, spot))
            token, spot = token[order], spot[order]
            cuts = np.searchsorted(spot, np.arange(len(ids) + 1))
            shared = np.diff(cuts)
            long_ = size + (-PERCENT * size // 100) + 1  # size - ceil(PERCENT size / 100) + 1
            prefix = np.minimum(shared, long_ - (size - shared))
            live = np.flatnonzero(prefix > 0)
            for lo in range(0, len(live), 5000):
                some = live[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[some].view("int64")),
                        pa.array(size[some]),
                        pa.array([W.pack(np.sort(token[cuts[i] : cuts[i + 1]]), SENT_BYTES) for i in some], pa.binary()),
                        pa.array([token[cuts[i] : cuts[i] + prefix[i]].view("int64") for i in some], pa.list_(pa.int64())),
                        pa.array((size - shared)[some]),
                    ],
                    ["doc_id", "n", "shared", "prefix", "alone"],
                )

    asked = docs.mapInArrow(W.tidy(ask), "part int, tokens binary, docs binary").repartition(parts, "part")
    kind = "part int, tokens binary, docs binary, extra binary"
    met = asked.mapInArrow(W.tidy(answer), kind).union(classes.select("doc_id", "n").mapInArrow(stand, kind))
    return met.repartition(parts, "part").mapInArrow(W.tidy(gather), "doc_id long, n long, shared binary, prefix array<long>, alone long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of documents that link; sets: doc_id, n, shared."""

    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [len(np.intersect1d(W.unpack(x.as_py(), SENT_BYTES), W.unpack(y.as_py(), SENT_BYTES), assume_unique=True)) for x, y in zip(a, b, strict=True)]
        W.give_back()
        return pa.array(out, pa.int64())

    left = sets.select(F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("shared").alias("s_u"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("shared").alias("s_v"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v")
    both = both.withColumn("both", F.arrow_udf(common, "long")("s_u", "s_v"))
    return both.where(100 * F.col("both") >= PERCENT * (F.col("n_u") + F.col("n_v") - F.col("both"))).select("u", "v")


def _size_fits(a: Column, b: Column) -> Column:
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def _place_fits(x: str, y: str) -> Column:
    """Whether enough shingles can still be common from this one on: 175 common >= 75 (n_x + n_y)."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return (100 + PERCENT) * left >= PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the component of their doc_id; a document without links is one by itself."""
    found = components(links).select(F.col("node").alias("doc_id"), "component")
    return rows.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _mixed(postings: DataFrame) -> DataFrame:
    """Postings of shingles in documents of several components, with the main component of each."""
    sizes = postings.groupBy("token", "component").agg(F.count("*").alias("c"), F.min("doc_id").alias("least"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "component", "least")).alias("m"), F.count("*").alias("k"))
    main = main.where("k > 1").select("token", F.col("m.component").alias("main"), F.col("m.least").alias("least"))
    return postings.join(main, "token")


def _apart(sets: DataFrame, grouped: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (u, v) of documents in different components whose groups pass all filters.

    Members of a group that are in one component are a unit: they have one size and one prefix, so units are
    joined and filtered, and only the pairs of units that pass are expanded into pairs of members.
    """
    named = keep(_labelled(grouped, links))
    units = named.groupBy("g", "component").agg(F.min("doc_id").alias("unit"))
    members = named.join(units, ["g", "component"])
    alone = members.join(sets.select("doc_id", "alone"), "doc_id").groupBy("unit", "component").agg(F.min("alone").alias("alone"))
    heads = alone.join(sets.select(F.col("doc_id").alias("unit"), "n", "prefix"), "unit")
    places = heads.select(F.col("unit").alias("doc_id"), "component", "n", "alone", F.posexplode("prefix").alias("i", "token"))
    mixed = keep(_mixed(places.select("token", "doc_id", "component", "n", (F.col("alone") + F.col("i")).alias("place"))))
    x, y = mixed.where("component <> main").alias("x"), mixed.alias("y")
    apart = F.col("x.component") != F.col("y.component")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & once & _size_fits(F.col("x.n"), F.col("y.n")) & _place_fits("x", "y"))
    pairs = met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    left, right = (members.select(F.col("unit").alias(k), F.col("doc_id").alias(v)) for k, v in (("a", "u"), ("b", "v")))
    return pairs.join(left, "a").join(right, "b").select("u", "v")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(_digests(work))
    one = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("d"))
    classes = keep(one.groupBy("d.digest").agg(F.min("doc_id").alias("doc_id"), F.first("d.n").alias("n")))
    sets = keep(_shared_shingles(work.where("doc_id is not null"), classes))

    # Groups: same size, same shared part of the prefix. Members against the least.
    grouped = sets.select("doc_id", F.struct("n", "prefix").alias("g")).select("doc_id", F.xxhash64("g.n", "g.prefix").alias("g"))
    heads = grouped.groupBy("g").agg(F.min("doc_id").alias("head"), F.count("*").alias("c")).where("c > 1")
    links = keep(_verified(grouped.join(heads, "g").where("doc_id <> head").select(F.col("doc_id").alias("u"), F.col("head").alias("v")), sets))

    places = sets.select("doc_id", "n", "alone", F.posexplode("prefix").alias("i", "token"))
    postings = places.select("token", "doc_id", "n", (F.col("alone") + F.col("i")).alias("place"))
    size = sets.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"))
    asked, answered = 1, 1
    while asked and answered * ROUNDS_SHARE >= asked:
        mixed = _mixed(_labelled(postings, links)).where("component <> main").select(F.col("doc_id").alias("u"), F.col("least").alias("v"), "n")
        votes = mixed.groupBy("u", "v", "n").count().join(size, "v").where(_size_fits(F.col("n"), F.col("n_v")))
        chosen = keep(votes.groupBy("u").agg(F.max(F.struct("count", "v")).alias("m")).select("u", F.col("m.v").alias("v")))
        more = keep(_verified(chosen, sets))
        asked, answered = chosen.count(), more.count()
        links = links.union(more)

    links = links.union(_verified(_apart(sets, grouped, links), sets))

    found = components(links).select(F.col("node").alias("rep"), "component")
    reps = classes.select("digest", F.col("doc_id").alias("rep")).join(found, "rep", "left")
    known = one.select("doc_id", "d.digest").join(reps, "digest").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that with the smallest id; rows with a null id stay."""
    first = linked(docs).where("component_id = doc_id").select(F.col("doc_id").alias("_doc")).distinct()
    stay = docs.join(first, docs["doc_id"].cast("long") == first["_doc"], "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where(docs["doc_id"].isNull()))
