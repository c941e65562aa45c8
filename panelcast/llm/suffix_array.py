"""Suffix-array dedup with sparse suffix arrays.

Only the suffixes at content-selected positions (the minimiser of each window) are kept. Their words to
the right are sorted and neighbours compared; so are the words to the left, read backwards. The common
lengths of neighbours part each order into classes for every depth. A window that begins l words before
its position is the class of l words on the left together with that of the rest on the right, so equal
windows are found by extending matches both ways, with no pair of segments ever formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import repeats
from panelcast.llm.stage import keep

#: A passage is this many words or more.
WINDOW, GRAM = 50, 8


class SparseSuffixArray:
    """Sorted suffixes at chosen positions, read up to `depth` words in one direction."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, end: np.ndarray, step: int, depth: int):
        reach = np.arange(depth)
        spot = at[:, None] + step * reach
        open_ = spot < end[:, None] if step > 0 else spot >= end[:, None]
        rows = np.where(open_, ids[np.clip(spot, 0, max(len(ids) - 1, 0))], 0).astype(">u4")
        view = np.ascontiguousarray(rows).view(f"V{4 * depth}").ravel() if depth else np.zeros(len(at), "V1")
        self.order = np.argsort(view, kind="stable")
        ordered = rows[self.order]
        same = ordered[1:] == ordered[:-1]
        self.common = np.where(same.all(axis=1), depth, np.argmin(same, axis=1)) if depth else np.zeros(max(len(at) - 1, 0), "int64")
        self.rank = np.empty(len(at), "int64")
        self.rank[self.order] = np.arange(len(at))

    def classes(self, depth: int) -> np.ndarray:
        """A number for each suffix; equal where the first `depth` words are."""
        return np.r_[0, np.cumsum(self.common < depth)][self.rank]


def smallest_holders(ids: np.ndarray, starts: np.ndarray, anchors: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """The kernel of repeats.py: for each window, the smallest document with an occurrence of it."""
    at, n = starts[:-1] + anchors, np.diff(starts) - window + 1
    offset = np.r_[0, np.cumsum(n)]
    right = SparseSuffixArray(ids, at, starts[1:], 1, window)
    left = SparseSuffixArray(ids, at - 1, starts[:-1], -1, int(anchors.max(initial=0)))
    out = np.zeros(offset[-1], "int64")
    for l in range(int(anchors.max(initial=0)) + 1):  # noqa: E741
        i = np.flatnonzero((anchors >= l) & (anchors - l < n))  # segments with a window that begins l before
        if len(i):
            pair = left.classes(l)[i] * (len(docs) + 1) + right.classes(window - l)[i]
            _, of = np.unique(pair, return_inverse=True)
            least = np.full(int(of.max()) + 1, np.iinfo("int64").max)
            np.minimum.at(least, of, docs[i])
            out[offset[i] + anchors[i] - l] = least[of]
    return out


def mark(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Marks of repeats.mark_repeats, found with sparse suffix arrays."""
    return repeats.mark_repeats(docs, window, gram, smallest_holders)


def repeated_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, copy_of and spans of the documents that repeat a passage of a smaller one."""
    marks = mark(docs, window, gram).where(F.size("spans") > 0)
    merged = F.arrow_udf(_merge, "array<struct<start:int,end:int>>")
    out = marks.withColumn("spans", merged("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), "copy_of", "spans")


def cut_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, copy_of, spans and kept_sha (of the words that cut_words leaves, joined by one
    space) of every document, each row of a doc_id with its own text."""
    marks = keep(mark(docs, window, gram))
    cut = repeats.cut_words(docs, marks).select("doc_id", "tag", "n_removed", "kept_sha")
    done = marks.join(cut, ["doc_id", "tag"], "left")
    merged = F.arrow_udf(_merge, "array<struct<start:int,end:int>>")
    removed, sha = F.coalesce("n_removed", F.lit(0).cast("long")), F.coalesce("kept_sha", "sha")
    return done.select("doc_id", "n_words", removed.alias("n_removed"), "copy_of", merged("spans").alias("spans"), sha.alias("kept_sha"))


def _merge(rows):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    spans = [repeats.merge_spans([(x["start"], x["end"]) for x in r]) for r in rows.to_pylist()]
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with repeated passages taken out of all but the smallest document; n_chars follows the text.

    Documents of which nothing is left are dropped. All other columns stay.
    """
    marks = mark(docs, window, gram).where(F.size("spans") > 0)
    cut = repeats.cut_words(docs, marks).select(F.col("doc_id").alias("_doc"), "kept")
    kept = cut["kept"]
    both = docs.join(cut, docs["doc_id"].cast("long") == cut["_doc"], "left")
    gone = kept.isNotNull() & ~kept.rlike("[^\\x20\\x09-\\x0D]")
    new = {"text": F.coalesce(kept, docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNull(), docs["n_chars"]).otherwise(F.length(kept))
    return both.where(~gone).select(*[new.get(c, docs[c]).cast(t).alias(c) for c, t in docs.dtypes])
