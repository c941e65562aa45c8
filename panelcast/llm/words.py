"""Words, hashes and least-hash positions over blocks of texts, in numpy inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_LOWER_TABLE = _LOWER.tobytes()
#: Powers are kept for a multiple of so many places.
STEP = 1 << 16
_ODD = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}


class Local(dict):
    """A cache that stays in its process: functions that are sent to tasks take it along empty."""

    def __reduce__(self):
        return (Local, ())


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and others share the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, giving memory back where a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_powers: dict[str, tuple[np.ndarray, np.ndarray]] = Local()


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = -(-n // STEP) * STEP
        odd = _ODD[kind]
        both = []
        for base in (odd, pow(odd, -1, 1 << 64)):
            row = np.full(size, base, "uint64")
            row[0] = 1
            both.append(np.cumprod(row, dtype="uint64"))
        have = _powers[kind] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    data: bytes  # each word followed by one space; empty without bodies
    start: np.ndarray  # of each word in data, and the end of data; empty without bodies
    first: np.ndarray  # word that begins each text, and the number of words
    hashes: np.ndarray
    raw: np.ndarray  # bytes of the texts, one after another
    ends: np.ndarray  # where each text begins in raw, and the end of raw
    begin: np.ndarray  # of each word in raw
    end: np.ndarray

    def body(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        return self.data[self.start[a] : self.start[b] - 1] if b > a else b""


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(row, texts from there) with few rows at a time, so that memory follows `size` bytes or one text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        yield row, texts.slice(row, stop - row)
        row = stop


def _word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every word, which begin at s and end before e."""
    n, step = len(data), 1 << 15
    up, down = _power("byte", n + 1)
    up = up[:n]
    total = np.empty(n + 1, "uint64")
    total[0] = 0
    for a in range(0, n, step):  # sums that stay in the processor's cache
        some = total[a : a + step + 1]
        np.add(data[a : a + step], 1, out=some[1:], dtype="uint64")
        some[1:] *= up[a : a + step]
        np.cumsum(some, out=some)
    return mix((total[e] - total[s]) * down[s])


def words_of(texts: pa.Array, lower: bool = False, word_byte: np.ndarray = _WORD_BYTE, bodies: bool = True) -> Words:
    """Words (runs of word_byte, else [^\\x20\\x09-\\x0D]+) of a large_binary array without nulls;
    lower: A-Z to a-z; bodies: whether the bytes of words are wanted besides their hashes."""
    ends = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, "uint8")[ends[0] : ends[-1]] if raw is not None else np.zeros(0, "uint8")
    ends = ends - ends[0]
    if lower:
        data = np.frombuffer(data.tobytes().translate(_LOWER_TABLE), "uint8")
    n = len(data)
    word = np.frombuffer(data.tobytes().translate(word_byte.astype("uint8").tobytes()), bool)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    begin, end = word.copy(), word.copy()
    if n:
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    flat, start = b"", np.zeros(0, "int64")
    if bodies:
        size = e - s
        start = np.zeros(len(s) + 1, "int64")
        np.cumsum(size + 1, out=start[1:])
        spaced = np.full(start[-1], 32, "uint8")
        spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(s)), size)] = data[word]
        flat = spaced.tobytes()
    return Words(flat, start, np.searchsorted(s, ends), _word_hashes(data, s, e), data, ends, s, e)


def piece_hashes(w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of bytes first to last (exclusive) of w.raw."""
    up, down = _power("byte", len(w.raw) + 1)
    total = np.zeros(len(w.raw) + 1, "uint64")
    np.cumsum((w.raw.astype("uint64") + np.uint64(1)) * up[: len(w.raw)], out=total[1:])
    return mix((total[last] - total[first]) * down[first])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, "uint64")
    up, down = _power("word", n + 1)
    total = np.zeros(n + 1, "uint64")
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value of every `width` consecutive ones, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, "int64")
    at, span = np.arange(len(values)), 1

    def both(shift: int) -> np.ndarray:
        a, b = at[:-shift], at[shift:]
        return np.where(values[b] < values[a], b, a)

    while span * 2 <= width:
        at, span = both(span), span * 2
    return both(width - span) if width > span else at


def inside(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the first `count` starts of n consecutive words stay within one text."""
    ok = np.zeros(count, bool)
    owner_end = np.repeat(first[1:], np.diff(first))[:count]
    ok[: len(owner_end)] = np.arange(len(owner_end)) + n <= owner_end
    return ok


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """The low bytes of 64-bit values, first bytes first: planes of like bytes compress well."""
    return values.astype("<u8").view("uint8").reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, "uint8").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "uint8")
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
