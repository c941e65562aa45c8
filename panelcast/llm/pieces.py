"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A text's encoding is the one sequence of pieces in which every adjacent pair stays a pair when it is
merged anew. So the encoder walks from left to right: it tries the longest piece at a position (found
by an Aho-Corasick automaton), keeps it if it is compatible with the piece before, else tries shorter
ones, and steps back when none fits. A bitfield of failed positions keeps a position from being tried
twice, so the work is linear in the text.

Words recur, so each of the most frequent words of the corpus is encoded once for the whole job: words are
counted over all texts, the first TABLE of them are encoded by the tasks that share them out, and the table goes
to every task. What is not in it is encoded where it occurs, and remembered for a while.

A null text counts as empty. Empty texts give only the begin and end ids and decode to ''.
"""

from __future__ import annotations

import hashlib
import re
import sys
import weakref
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from panelcast.llm import words as W
from panelcast.llm.stage import keep

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of a generation of each memo table; forgetting costs time and changes nothing.
MEMO = 50_000
#: The same for words and parts, which the table of frequent words leaves few of.
MEMO_WORDS = 5_000
#: Words that are encoded once for all, and the longest of them in bytes; others are encoded where they occur.
TABLE, TABLE_BYTES = 500_000, 24
#: Different words that a task counts before it sends them.
SEND = 1 << 19


def read_model(path: str) -> dict:
    """What encoding needs from a model file; its size is that of the vocabulary."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
    if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
        raise ValueError("only merge-type (BPE) models are encoded here")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are encoded here")
    if USER_DEFINED in kinds or UNUSED in kinds or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("user-defined or unused pieces and suffix spaces are not handled")
    return {
        "pieces": [p.piece for p in proto.pieces],
        "scores": [p.score for p in proto.pieces],
        "kinds": kinds,
        "prefix": spec.add_dummy_prefix,
        "byte_fallback": proto.trainer_spec.byte_fallback,
        "unk_surface": proto.trainer_spec.unk_surface,
        "bos": proto.trainer_spec.bos_id,
        "eos": proto.trainer_spec.eos_id,
        "unk": proto.trainer_spec.unk_id,
    }


def words_part(model: dict) -> bool:
    """Whether no piece spans a space or a line end, so that texts can be encoded word by word."""
    normal = (p for p, k in zip(model["pieces"], model["kinds"], strict=True) if k == NORMAL)
    return bool(model["prefix"]) and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal)


assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are packed as the machine holds them"


class Memo(dict):
    """Values of a function by argument. Two generations: what is asked for again outlives a full table."""

    def __init__(self, function, most: int = MEMO):
        self.function, self.most, self.old = function, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value


class PieceCodec:
    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        # Nothing here leads back to the encoder or to a model that holds it: it goes with its broadcast.
        self.model, self.pieces, me = dict(model), pieces, weakref.proxy(self)
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("each character of a piece must be a piece")
        self.score = {p: model["scores"][i] for p, i in self.ids.items()}
        self.size = [len(p) for p in pieces]
        # Merges in the order in which they are made; characters stand before all. Pieces whose score
        # another piece has too are told apart by place alone, so their pairs are merged outright.
        scores = sorted({self.score[p] for p in self.ids if len(p) > 1}, reverse=True)
        order = {x: i + 1 for i, x in enumerate(scores)}
        self.rank = [order[self.score[p]] if p in self.ids and len(p) > 1 else 0 for p in pieces]
        shared = {r for r, n in Counter(self.rank).items() if n > 1 and r}
        self.tied = [r in shared for r in self.rank]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        if self.ids:
            self.automaton.make_automaton()
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.known, self.most = set("".join(self.ids)), max(map(len, self.ids), default=1)
        # The automaton's path through a text ends with a prefix of some piece; fit has the longest piece in it.
        self.fit = Memo(lambda s: next(me.ids[s[:n]] for n in range(len(s), 0, -1) if s[:n] in me.ids))
        self.shorter, self.pair, self.halves = Memo(lambda p: me._shorter(p)), Memo(lambda k: me._pair_stays(k)), Memo(lambda p: me._halves(p))
        self.encoded = Memo(lambda part: array("I", me.encode_part(part)).tobytes(), MEMO_WORDS)
        self.parts = self._part_pattern()
        self.by_word = words_part(model)
        self.words = Memo(lambda w: me._encode_parts(w if w[:1] == "\n" else SPACE + w), MEMO_WORDS)
        self.surface = [self._surface(p, k) for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in kinds], bool)
        self.is_control = np.array([k == CONTROL for k in kinds], bool)

    def _part_pattern(self) -> re.Pattern | None:
        """Cuts a text where no piece can span: before spaces, around line ends, and between letters or
        digits and those marks that no piece joins to them. None if a piece has a space inside."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return None
        letters = "0-9A-Za-z\u00c0-\u024f"
        letter = re.compile(f"[{letters}]")
        marks = {c for p in self.ids for c in p if c.isascii() and not letter.match(c)}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                marks -= {a} if letter.match(b) else {b} if letter.match(a) else set()
        kinds = re.escape("".join(sorted(marks))) or SPACE
        line = "" if any("\n" in p for p in self.ids) else "\n"
        ways = [
            rf"{SPACE}*[{letters}]+(?=[{kinds}{SPACE}{line}]|\Z)",
            rf"{SPACE}*[{kinds}]+(?=[{letters}{SPACE}{line}]|\Z)",
            f"{SPACE}*[^{SPACE}{line}]+",
            f"{SPACE}+",
        ]
        return re.compile("|".join(ways + [line] * bool(line)))

    def merge(self, text: str) -> list[str]:
        """Best-scored merge first, leftmost of equals: the definition, for short texts."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        parts, last = list(text), ("", "")
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes a piece last; None if merging its text doesn't give it."""
        parts, (a, b) = self._merge(self.pieces[piece])
        return (self.ids[a], self.ids[b]) if len(parts) == 1 and a else (piece, piece) if len(parts) == 1 else None

    def _pair_stays(self, key: int) -> bool:
        """Whether merging the text of two adjacent pieces gives just these two.

        The merges inside both are undone, the latest first; the pair stays if no merge across the
        boundary would have come before the next one undone.
        """
        first, second = (key >> 32) - 1, key & 0xFFFFFFFF
        if self.halves[second] is None or (first >= 0 and self.halves[first] is None):
            return False
        if first < 0:
            return True
        rank, pieces = self.rank, self.pieces
        if self.tied[first] or self.tied[second]:
            return self.merge(pieces[first] + pieces[second]) == [pieces[first], pieces[second]]
        limit = len(pieces) + 1
        while True:
            across = self.ids.get(pieces[first] + pieces[second])
            if across is not None and rank[across] < limit:
                return False
            if rank[first] > rank[second]:
                limit, first = rank[first], self.halves[first][1]
            elif rank[second]:
                limit, second = rank[second] + 1, self.halves[second][0]
            else:
                return True

    def _shorter(self, piece: int) -> int:
        """The longest piece that begins this one; -1 for a character."""
        text = self.pieces[piece]
        return next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)

    def encode_part(self, text: str) -> list[int]:
        """Ids of one part. Characters that are no pieces merge with nothing and part what is between."""
        if self.known.issuperset(text):
            return self.backtrack(text)
        known, out, begin = self.known, [], 0
        for at, c in enumerate(text):
            if c not in known:
                out += self.backtrack(text[begin:at])
                out += [self.bytes_at[b] for b in c.encode()] if self.model["byte_fallback"] else [self.model["unk"]]
                begin = at + 1
        return out + self.backtrack(text[begin:])

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters, by longest matches and steps back."""
        n = len(text)
        if not n:
            return []
        size, pair, shorter = self.size, self.pair, self.shorter
        reach, fit, most = self.automaton.longest_prefix, self.fit, self.most
        open_at = bytearray(b"\x01") * (n + 1)
        chosen: list[int] = []
        at, last, i = 0, 0, fit[text[: reach(text[:most])]]  # last: the piece before plus one, in the upper bits
        while at < n:
            while i >= 0:
                end = at + size[i]
                if open_at[end] and pair[last | i]:
                    break
                i = shorter[i]
            if i >= 0:
                chosen.append(i)
                at, last = end, (i + 1) << 32
                if at < n:
                    i = fit[text[at : at + reach(text[at : at + most])]]
            else:
                open_at[at] = 0
                i = chosen.pop()
                at -= size[i]
                last = (chosen[-1] + 1) << 32 if chosen else 0
        return chosen

    def _encode_parts(self, text: str) -> bytes:
        parts = self.parts.findall(text) if self.parts else [text] if text else []
        return b"".join(map(self.encoded.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers, with begin and end."""
        text = text or ""
        if text and self.by_word and text[0] != " " and "  " not in text and SPACE not in text:
            # Words between single spaces; a line end begins a word too, and only that word has no space before.
            body = b"".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
        else:
            text = (" " + text if text and self.model["prefix"] else text).replace(" ", SPACE)
            body = self._encode_parts(text)
        bos, eos = (np.array([self.model[k]], "<u4").tobytes() for k in ("bos", "eos"))
        return bos + body + eos

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.model["unk_surface"] if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[~self.is_control[ids]]
        text = b"".join(map(self.surface.__getitem__, ids.tolist()))
        plain = np.flatnonzero(~self.is_byte[ids]) if len(ids) else ids
        if len(plain) and plain[0] == 0 and self.model["prefix"] and self.model["pieces"][ids[0]].startswith(SPACE):
            text = text[1:]  # the space that encoding has put before the text
        try:
            return text.decode()
        except UnicodeDecodeError:
            return "".join(_utf8(text))


def _utf8(data: bytes) -> Iterable[str]:
    """Characters; each byte that begins none gives one replacement character."""
    at = 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                yield data[at : at + n].decode()
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            yield "�"
            at += 1


@dataclass
class Table:
    """Ids of words behind a space: sorted hashes of the words, where the ids of each begin and end, and the ids."""

    hashes: np.ndarray
    ends: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(words: pa.Array, ids: pa.Array) -> Table:
        """From large_binary arrays; no word becomes an object of its own."""
        hashes = W.words_of(words, word_byte=_WORD_BYTE).hashes
        order = np.argsort(hashes)
        ids = ids.take(pa.array(order))
        ends = np.frombuffer(ids.buffers()[1], "int64")[ids.offset : ids.offset + len(ids) + 1] // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")
        return Table(hashes[order], ends - ends[0], flat[ends[0] : ends[-1]].copy())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it isn't here."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def encode_block(codec: PieceCodec, table: Table, texts: pa.Array) -> list[bytes]:
    """Ids of a block of texts (large_binary), those of all words in the table taken from it at once.

    What stands in a text, in order: words behind a space (the first word counts as one), words behind a line
    end, line ends, and spaces with no word behind them. Texts that words don't part are encoded one by one.
    """
    w = W.words_of(texts, word_byte=_WORD_BYTE)
    raw, ends, n = w.raw, w.ends, len(w.raw)
    begins = ends[:-1][np.diff(ends) > 0]
    before = np.full(n, 32, "uint8")  # a text begins behind a space that isn't written
    before[1:] = raw[:-1]
    before[begins] = 32
    after = np.full(n, 10, "uint8")  # as before a line end, nothing follows a space at the end
    after[:-1] = raw[1:]
    after[ends[1:][np.diff(ends) > 0] - 1] = 10
    spaced = before[w.begin] == 32
    words, lined = np.flatnonzero(spaced), np.flatnonzero(~spaced)
    lines, bare = np.flatnonzero(raw == 10), np.flatnonzero((raw == 32) & (after == 10))
    first = begins[raw[begins] == 10]
    # Ids that aren't in the table follow it: of a line end, of a bare space, of other words.
    known, size = table.find(w.hashes[words]), len(table.hashes)
    own: list[bytes] = [codec._encode_parts("\n"), codec._encode_parts(SPACE)]
    for some, places in ((words[known < 0], known), (lined, None)):
        _, at, back = np.unique(w.hashes[some], return_index=True, return_inverse=True)
        texts_of = [w.body(k, k + 1).decode() for k in some[at].tolist()]
        refs = size + len(own) + back
        own += [codec.words[x] for x in texts_of] if places is not None else [codec._encode_parts(x) for x in texts_of]
        if places is not None:
            known[known < 0] = refs
        else:
            behind_line = refs
    key = np.concatenate([2 * w.begin[words] + 1, 2 * w.begin[lined] + 1, 2 * lines + 1, 2 * bare + 1, 2 * first])
    ref = np.concatenate([known, behind_line, np.full(len(lines), size), np.full(len(bare) + len(first), size + 1)])
    order = np.argsort(key, kind="stable")
    key, ref = key[order], ref[order]
    own_ends = np.cumsum([0, *(len(x) // 4 for x in own)])
    own_ids = np.frombuffer(b"".join(own), "<u4")
    length = np.empty(len(ref), "int64")
    out_of = {}
    for name, some, base, stops in (("table", ref < size, 0, table.ends), ("own", ref >= size, size, own_ends)):
        r = ref[some] - base
        length[some] = stops[r + 1] - stops[r]
        out_of[name] = (some, stops[r])
    stop = np.cumsum(length)
    out = np.empty(int(stop[-1]) if len(stop) else 0, "<u4")
    for name, ids in (("table", table.ids), ("own", own_ids)):
        some, source = out_of[name]
        size_of = length[some]
        inside = np.arange(int(size_of.sum())) - np.repeat(np.cumsum(size_of) - size_of, size_of)
        out[np.repeat((stop - length)[some], size_of) + inside] = ids[np.repeat(source, size_of) + inside]
    cuts = np.r_[0, stop][np.searchsorted(key, 2 * ends)]
    bos, eos = (np.array([codec.model[k]], "<u4").tobytes() for k in ("bos", "eos"))
    done = []
    for d, text in enumerate(texts):
        data = text.as_buffer().to_pybytes()
        if data and (data[0] == 32 or b"  " in data or _MARK in data):
            done.append(codec.encode(data.decode()))
        else:
            done.append(bos + out[cuts[d] : cuts[d + 1]].tobytes() + eos)
    return done


_MARK = SPACE.encode()
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, 0x0A]] = False


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short words of a task's texts with their counts."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        hashes, at, back = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c, _ in held]), len(hashes)).astype("int64")
        return hashes, counts, pa.concat_arrays([t for _, _, t in held]).take(pa.array(at))

    def rows(_: np.ndarray, counts: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for _, texts in W.blocks(batch.column(0), SEND):
            w = W.words_of(texts, word_byte=_WORD_BYTE)
            short = np.flatnonzero(np.diff(w.start) <= TABLE_BYTES + 1)  # with the space that ends it
            hashes, at, counts = np.unique(w.hashes[short], return_index=True, return_counts=True)
            spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.hashes), [None, pa.py_buffer(w.start), pa.py_buffer(w.data)])
            held.append((hashes, counts, spaced.take(pa.array(short[at]))))
            if sum(len(h) for h, _, _ in held) > 2 * SEND:
                held = [merged()]
                if len(held[0][0]) > SEND:
                    yield rows(*held.pop())
    if held:
        yield rows(*merged())


def frequent_words(docs: DataFrame, text: str = "text", most: int = TABLE) -> DataFrame:
    """The `most` most frequent words of at most TABLE_BYTES bytes that occur more than once; words lie between
    spaces and line ends."""
    counts = docs.select(text).mapInArrow(W.tidy(_counted), "word binary, n long")
    word = F.rtrim(F.col("word").cast("string")).alias("word")  # they come with the space that ends them
    summed = counts.groupBy(word).agg(F.sum("n").alias("n")).where((F.col("n") > 1) & ~F.contains("word", F.lit("\0")))
    return summed.orderBy(F.desc("n"), "word").limit(most).select("word")


def word_table(docs: DataFrame, model: Broadcast, text: str = "text") -> Table:
    """The table of the most frequent words, encoded by tasks; at most TABLE short rows come to the driver."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = _codec(model)
            ids = [codec._encode_parts(SPACE + w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(ids, pa.binary())], ["word", "ids"])

    parts = docs.sparkSession.sparkContext.defaultParallelism
    found = keep(frequent_words(docs, text)).repartition(parts).mapInArrow(W.tidy(encode), "word binary, ids binary").toArrow()
    columns = (found[c].cast(pa.large_binary()).combine_chunks() for c in ("word", "ids"))
    table = Table.of(*(c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.large_binary()) for c in columns))
    del found
    W.give_back()  # the driver goes on with other jobs
    return table


def _codec(shared: Broadcast) -> PieceCodec:
    """One codec for each Python worker: it stays with the broadcast value, and so do its memos from task to task."""
    model = shared.value
    if "codec" not in model:
        model["codec"] = PieceCodec(model)
    return model["codec"]


def _shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary, broadcast: its size doesn't depend on the data."""
    return spark.sparkContext.broadcast(read_model(path))


def _encoded(codec: PieceCodec, table: Table | None, texts: pa.Array) -> list[bytes]:
    if table is None:
        return [codec.encode(t.as_py()) for t in texts]
    return [x for _, part in W.blocks(texts, SEND) for x in encode_block(codec, table, part)]


def _listed(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_column(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int> of ids of a text column, with begin and end ids."""
    model = _shared(spark, path)

    def encode(texts: pa.Array) -> pa.Array:
        return _listed(_encoded(_codec(model), None, texts))

    return F.arrow_udf(encode, "array<int>")(text)


def decode_column(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of a column of ids. Null ids give null."""
    model = _shared(spark, path)

    def decode(rows: pa.Array) -> pa.Array:
        codec = _codec(model)
        return pa.array([codec.decode(np.asarray(r.values)) if r.is_valid else None for r in rows], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` (array<int>), `ids_sha256` (see `ids_digest`) and `decoded` (string); columns of these
    names are replaced. A text is encoded once for all three."""
    spark = docs.sparkSession
    model = _shared(spark, path)
    # Where words can't be told by spaces alone, there is no table to fill.
    known = spark.sparkContext.broadcast(word_table(docs, model)) if words_part(model.value) else None

    def run(texts: pa.Array) -> pa.Array:
        codec = _codec(model)
        ids = _encoded(codec, None if known is None else known.value, texts)
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
        decoded = pa.array([codec.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string())
        W.give_back()
        return pa.StructArray.from_arrays([_listed(ids), digests, decoded], ["ids", "ids_sha256", "decoded"])

    kind = "struct<ids:array<int>,ids_sha256:string,decoded:string>"
    done = docs.withColumn("_pieces", F.arrow_udf(run, kind)(F.col("text")))
    return done.withColumns({c: F.col(f"_pieces.{c}") for c in ("ids", "ids_sha256", "decoded")}).drop("_pieces")


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of ids as little-endian unsigned 32-bit integers."""

    def packed(rows: pa.Array) -> pa.Array:
        return pa.array([np.asarray(r.values).astype("<u4").tobytes() if r.is_valid else b"" for r in rows], pa.binary())

    return F.sha2(F.arrow_udf(packed, "binary")(ids), 256)
