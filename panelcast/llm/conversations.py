"""Least edits that turn damaged conversations into alternating ones.

A repaired conversation has the role initials `(s?(ua)+)?`. Edits in order of its turns: Keep (costs nothing),
Rerole to user or assistant, Delete (required for blank and duplicate turns), Insert an empty turn of the user or
the assistant anywhere; a truncated turn that stays costs TRUNCATED more. Of the cheapest edits those stand whose
initials are ASCII-least.

1. Turns are hashed by conversation and sorted by turn (null first), role and text. A turn is then one byte: its
   role's initial and its first fault.
2. Backwards over these bytes goes the least cost from each of four states (start, after s, u, a). Only every
   sqrt(n)-th vector is stored. Forwards, each block is computed again from the vector at its end and walked by
   the ASCII-least edit that keeps to the least cost.
3. The edits meet the texts, which stream in the same order: a task holds a batch of texts and one
   conversation's edits.

A conversation's edits and its digest are one cell each and must be made in order, so one task does a whole
conversation; what it holds of it is a byte for each turn, no more than that cell of the result, and no texts.

Null roles and texts are one space (so such texts are blank); a null conv_id is a conversation of its own; turns
that are alike in all columns count as often as they occur. Rows with equal turns stand by role, then text. An
empty table gives no rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Conversations of up to so many turns are remembered with their edits.
SHORT, MEMO = 64, 1 << 16
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3
#: Bytes of a turn: its initial (s, u, a, other) and 4 times its fault; a turn that is not there.
BLANK, DUPLICATE, TRUNC = 1, 2, 3
ABSENT = 255
_FAR = 1 << 60
_NAMES = {USER: b"user", ASSISTANT: b"assistant"}
#: State after one more turn of the user or the assistant; the initials' own moves.
_NEXT = (USER, USER, ASSISTANT, USER)
_OWN = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}


def _moves(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state, (initial, cost, next state) of the edits of such a turn, in the order of the initials."""
    initial, fault = code % 4, code // 4
    extra = TRUNCATED if fault == TRUNC else 0
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in _OWN:
                edits.append(("K", KEEP + extra, _OWN[state, initial]))
            edits.append(("R", REROLE + extra, _NEXT[state]))
        out.append(tuple(edits))
    return tuple(out)


_MOVES = [_moves(code) for code in range(16)]


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs where turns may be inserted first; two are enough, as user follows assistant again."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[_NEXT[s]]) for s in range(4)]
    return costs


_END = _with_inserts([0, _FAR, _FAR, 0])


def _before(code: int, after: list[int]) -> list[int]:
    return _with_inserts([min(cost + after[to] for _, cost, to in edits) for edits in _MOVES[code]])


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the edits of one conversation."""
    n = len(codes)
    step = isqrt(n) + 1
    stored = {n: _END}
    costs = _END
    for i in range(n - 1, -1, -1):
        costs = _before(codes[i], costs)
        if i % step == 0:
            stored[i] = costs
    state, audit = START, []
    for begin in range(0, n, step):
        end = min(begin + step, n)
        block = [stored[end]]
        for i in range(end - 1, begin - 1, -1):
            block.append(_before(codes[i], block[-1]))
        block.reverse()
        for i in range(begin, end):
            here, after, done = block[i - begin], block[i - begin + 1], False
            while not done:
                # D comes before I, and I before K and R.
                edits = _MOVES[codes[i]][state]
                first = [e for e in edits if e[1] + after[e[2]] == here[state]]
                if first and first[0][0] == "D":
                    audit.append("D")
                    done = True
                elif INSERT + here[_NEXT[state]] == here[state]:
                    audit.append("I")
                    state = _NEXT[state]
                else:
                    letter, _, state = first[0]
                    audit.append(letter)
                    done = True
    while state not in (START, ASSISTANT):
        audit.append("I")
        state = _NEXT[state]
    return stored[0][START], "".join(audit)


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _illegal(codes: bytes) -> int:
    initial = np.frombuffer(codes, "uint8") % 4
    return int((~_LEGAL[initial[:-1], initial[1:]]).sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts and edits for each conversation, whose turns come in order."""
    memo: dict[bytes, tuple] = {}
    done: list[tuple] = []

    def summary(codes: bytes) -> tuple:
        got = memo.get(codes)
        if got is None:
            faults = np.bincount(np.frombuffer(codes, "uint8") // 4, minlength=4)
            got = (*(int(faults[k]) for k in (BLANK, DUPLICATE, TRUNC)), _illegal(codes), *cheapest(codes))
            if len(codes) <= SHORT and len(memo) < MEMO:
                memo[codes] = got
        return got

    def flush(key, codes: bytearray, low, high, distinct) -> None:
        gaps = high - low + 1 - distinct if distinct else 0
        done.append((key, gaps, *summary(bytes(codes))))

    def rows(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 8
        done.clear()
        types = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    open_, key, kind = False, None, None
    codes, low, high, distinct = bytearray(), None, None, 0
    for batch in batches:
        kind = batch.column("conv_id").type
        turns = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code")), strict=True)
        for new, group in groupby(turns, lambda r: r[0]):
            if not open_ or new != key:
                if open_:
                    flush(key, codes, low, high, distinct)
                open_, key, codes, low, high, distinct = True, new, bytearray(), None, None, 0
            for _, turn, code in group:
                if code == ABSENT:
                    continue
                codes.append(code)
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
        if len(done) > 10_000:
            yield rows(kind)
    if open_:
        flush(key, codes, low, high, distinct)
    if done:
        yield rows(kind)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation's row of counts, place, role, text, edit) of the repaired turns in order; where a conversation
    begins, a place of None. Deleted turns come too, with a place of -1."""
    head, audit, at, state, place = None, "", 0, START, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _NEXT[state]
            place += 1
            yield head, place - 1, _NAMES[state], b"", "I"

    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r = dict(zip(names, row, strict=True))
            if r["audit"] is not None:
                yield from inserted()
                head, audit, at, state, place = r, r["audit"], 0, START, 0
                yield head, None, b"", b"", ""
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                yield head, -1, r["role"], r["text"], edit
                continue
            if edit == "R":
                state = _NEXT[state]
                role = _NAMES[state]
            else:
                role = r["role"]
                state = _OWN[state, b"sua".index(role[:1])]
            place += 1
            yield head, place - 1, role, r["text"], edit
    yield from inserted()


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_STATS_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and the digest of the repaired text of each conversation."""
    done: list[tuple] = []
    head, digest, kind = None, hashlib.sha256(), None

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.column("conv_id").type
            yield batch

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *_STATS, "repaired_sha256"])

    for new, place, role, text, _ in _edited(typed()):
        if place is None:
            if head is not None:
                done.append((head["conv_id"], *(head[c] for c in _STATS), digest.hexdigest()))
            head, digest = new, hashlib.sha256()
            if len(done) > 10_000:
                yield rows()
        elif place >= 0:
            digest.update((b"\n" if place else b"") + role + b":" + text)
    if head is not None:
        done.append((head["conv_id"], *(head[c] for c in _STATS), digest.hexdigest()))
        yield rows()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each conversation."""
    kind = None

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.column("conv_id").type
            yield batch

    done: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        types = [kind, pa.int64(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "role", "text", "edit"])

    for head, place, role, text, edit in _edited(typed()):
        if place is not None and place >= 0:
            done.append((head["conv_id"], place, role, text, edit))
            if len(done) >= 1000:
                yield rows()
    if done:
        yield rows()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20 (0 drops a turn, 1 empties its text, 2
    takes its stop marks, 3 repeats it, 4 makes it the user's); dropped turns stay with `absent` set."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("absent"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _as_damaged(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.lit(False).alias("absent"))


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _codes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, code of every turn, conversations whole and in order."""
    alike = Window.partitionBy("conv_id", "role", "text", "absent").orderBy(F.col("turn").asc_nulls_first())
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") != "") & (initial >= 0), initial).otherwise(OTHER)
    fault = (
        F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), BLANK)
        .when(F.row_number().over(alike) > 1, DUPLICATE)
        .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), TRUNC)
        .otherwise(0)
    )
    code = F.when(F.col("absent"), ABSENT).otherwise(initial + 4 * fault)
    dealt = turns.repartition("conv_id").withColumn("code", code.cast("int"))
    return dealt.sortWithinPartitions(*_order()).select("conv_id", "turn", "code")


def _with_edits(turns: DataFrame) -> DataFrame:
    """Turns in order behind their conversation's row of counts and edits."""
    key = turns.schema["conv_id"].dataType.simpleString()
    counts = _codes(turns).mapInArrow(_counts, f"conv_id {key}, {_STATS_DDL}")
    texts = turns.where(~F.col("absent")).select("conv_id", "turn", F.col("role"), F.col("text"))
    both = counts.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    order = [F.col("conv_id"), F.col("audit").isNull(), *_order()[1:]]
    binary = [F.col(c).cast("binary").alias(c) for c in ("role", "text")]
    return both.sortWithinPartitions(*order).select("conv_id", *_STATS, *binary)


def audited(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of what
    the edits leave. With `damage`, turns are damaged first (see `damaged`)."""
    turns = damaged(conversations) if damage else _as_damaged(conversations)
    key = turns.schema["conv_id"].dataType.simpleString()
    return _with_edits(turns).mapInArrow(_digests, f"conv_id {key}, {_STATS_DDL}, repaired_sha256 string")


def repaired(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """The turns after the edits: conv_id, place (from 0), role, text, edit (K, R or I)."""
    turns = damaged(conversations) if damage else _as_damaged(conversations)
    key = turns.schema["conv_id"].dataType.simpleString()
    out = _with_edits(turns).mapInArrow(_turns, f"conv_id {key}, place long, role binary, text binary, edit string")
    return out.select("conv_id", "place", F.col("role").cast("string"), F.col("text").cast("string"), "edit")
