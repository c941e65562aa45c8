"""Substring dedup with a compressed FM-index for each shard.

A shard's segments are one text. Its index holds the Burrows-Wheeler transform in a wavelet matrix
(bit rows with counts for each 64 bits). Segments are streamed against it from right to left: a backward
step adds a word in front, and an interval of the right length is widened to its parent, so every step
gives the matching statistic of one window, cut at the window length, and the interval of all its places.
The least document over that interval tells whether a smaller document holds the window.

Contexts are sorted as deep as a window, which is all that backward search of windows needs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import repeats

WINDOW, GRAM = 13, 4


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of non-negative columns, compared from the first column on."""
    value = columns[0].astype("int64")
    for c in columns[1:]:
        bits = int(c.max()).bit_length() if len(c) else 0
        if int(value.max(initial=0)).bit_length() + bits > 62:
            value = _ranks(value)
        value = (value << bits) | c
    order = np.argsort(value)
    new = np.r_[False, value[order][1:] != value[order][:-1]]
    out = np.empty(len(value), "int64")
    out[order] = np.cumsum(new)
    return out


def context_ranks(text: np.ndarray, depths: tuple[int, ...]) -> list[np.ndarray]:
    """For each depth, the rank of every position by its next `depth` symbols (0 beyond the end)."""

    def ahead(r: np.ndarray, by: int) -> np.ndarray:
        # beyond the end stands the least symbol, so ranks there are below all others
        return np.r_[r[by:] + 1, np.zeros(min(by, len(r)), "int64")] if by else r + 1

    known = {1: text}
    out = []
    for depth in depths:
        while True:
            have = max(d for d in known if d <= depth)
            if have == depth:
                break
            if have * 3 <= depth:
                known[have * 3] = _ranks(*(ahead(known[have], have * i) for i in range(3)))
            elif have * 2 <= depth:
                known[have * 2] = _ranks(*(ahead(known[have], have * i) for i in range(2)))
            else:
                known[depth] = _ranks(ahead(known[have], 0), ahead(known[have], depth - have))
        out.append(known[depth])
    return out


class BitRow:
    """Bits with the number of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, "uint8")
        padded[: len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.packed) + 1, "int64")
        np.cumsum(np.bitwise_count(self.packed), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype("uint64")) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.packed[block] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray):
        self.rows: list[tuple[BitRow, int]] = []
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            self.rows.append((BitRow(bit), int(len(bit) - bit.sum())))
            values = np.r_[values[bit == 0], values[bit == 1]]

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each of the ends."""
        spots = [np.zeros(len(symbol), "int64"), *ends]
        for level, (bits, zeros) in zip(reversed(range(self.levels)), self.rows, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            for i, at in enumerate(spots):
                ones = bits.ones(at)
                spots[i] = np.where(one, zeros + ones, at - ones)
        return [x - spots[0] for x in spots[1:]]


class FMIndex:
    """Index of a text of symbols from 0 on, for patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        short, deep = context_ranks(text, (depth - 1, depth))
        self.places = np.argsort(deep, kind="stable")
        self.wavelet = WaveletMatrix(text[self.places - 1])
        self.before = np.r_[0, np.cumsum(np.bincount(text))]
        # Where the places begin and end that share one symbol less than the depth.
        parents = short[self.places]
        edge = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        which = np.cumsum(np.r_[False, parents[1:] != parents[:-1]])
        self.low, self.high = edge[which], np.r_[edge[1:], len(text)][which]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns; empty where high <= low."""
        a, b = self.wavelet.rank(symbol, low, high)
        return self.before[symbol] + a, self.before[symbol] + b

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals without the last symbol, of patterns that are `depth` long."""
        return self.low[low], self.high[high - 1]

    def windows(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of every window of each segment of a streamed text, segment after segment; each
        segment must have one window or more. A window that isn't in the index gets an empty interval."""
        n = np.diff(starts) - self.depth + 1
        offset = np.r_[0, np.cumsum(n)]
        out_low, out_high = np.zeros(offset[-1], "int64"), np.zeros(offset[-1], "int64")
        live = np.arange(len(n))
        size = self.before[-1]
        low, high = np.zeros(len(n), "int64"), np.full(len(n), size)
        length = np.zeros(len(n), "int64")
        at = starts[1:] - 1  # the word that comes in next
        while len(live):
            full = length == self.depth
            if full.any():
                low[full], high[full] = self.parent(low[full], high[full])
                length[full] -= 1
            symbol = text[at]
            low, high = self.extend(symbol, low, high)
            length += 1
            miss = high <= low
            if miss.any():  # the match ends here; the next begins with the word before
                low[miss], high[miss], length[miss] = 0, size, 0
            done = length == self.depth
            spot = offset[live[done]] + at[done] - starts[live[done]]
            out_low[spot], out_high[spot] = low[done], high[done]
            at = at - 1
            go = at >= starts[live]
            live, low, high, length, at = live[go], low[go], high[go], length[go], at[go]
        return out_low, out_high


def smallest_holders(ids: np.ndarray, starts: np.ndarray, anchors: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """The kernel of repeats.py: for each window, the smallest document with an occurrence of it."""
    sizes = np.diff(starts)
    gaps = starts[1:] + np.arange(len(sizes))
    text = np.zeros(len(ids) + len(sizes), "int64")  # 0 ends a segment
    inside = np.ones(len(text), bool)
    inside[gaps] = False
    text[inside] = ids
    owner = np.full(len(text), np.iinfo("int64").max)
    owner[inside] = np.repeat(docs, sizes)
    index = FMIndex(text, window)
    low, high = index.windows(ids, starts)
    by_place = np.r_[owner[index.places], np.iinfo("int64").max]  # so that an interval may end with the text
    order = np.argsort(low, kind="stable")  # equal windows have one interval
    first = order[np.r_[True, low[order][1:] != low[order][:-1]]]
    least = np.minimum.reduceat(by_place, np.c_[low[first], high[first]].ravel())[::2]
    return least[np.searchsorted(low[first], low)]


def mark(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Marks of repeats.mark_repeats, found with FM-indexes."""
    return repeats.mark_repeats(docs, window, gram, smallest_holders)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha (of the kept words joined by one space) of every document."""
    marks = mark(docs, window, gram)  # one plan with what follows: its exchange of texts is used twice
    cut = repeats.cut_words(docs, marks.where(F.col("copy_of").isNull())).drop("kept")
    both = marks.join(cut, ["doc_id", "tag"], "left")
    whole = F.col("copy_of").isNotNull()
    return both.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
    )
