"""Conversation structure repair by a dynamic program over runs of equal symbols.

Each turn becomes a symbol: its role's kind and whether it must go or costs
extra to stay. A conversation is right when its roles read as an optional
system turn and then pairs of user and assistant, or when it is empty. Edits
keep, rename, delete or insert turns, each at a cost.

A symbol moves the four states of that pattern by a min-plus matrix. Equal
neighbours are one run; a run's matrix is composed from cached powers of two,
so the cheapest cost behind every run follows in logarithmic time. Then the
choices are unrolled from the front: a run is halved with the same powers until
single turns are left, the smallest edit that keeps the optimum is taken, and
halves already seen are reused.

Turns are sorted over ranges of conversation and turn, so a conversation can be
spread over many tasks; what is gathered for one is its symbols, one byte a
turn, as many as its audit has. Repaired turns are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sweepfield.llm.common import broadcast_if_counted, written

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the repaired turns so far end in
FITS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ROLES, FAULTS = "suao", 3  # kinds of roles; sound, truncated, to be deleted
PIECE = 1 << 17  # turns whose symbols are gathered at first
REUSED, CHOICES = 256, 20_000  # longest run whose choices are remembered, and how many of them
# What counts as blank and what ends a text.
BLANK, ENDING = r"[\x20\x09-\x0D]", r"[.!?]"


def symbol(role: str, fault: int) -> str:
    return chr(65 + ROLES.index(role) * FAULTS + fault)


def _times(a, b):
    return tuple(tuple(min(min(x + y for x, y in zip(row, column)), NEVER) for column in zip(*b)) for row in a)


def _apply(a, v):
    return tuple(min(min(x + y for x, y in zip(row, v)), NEVER) for row in a)


def _filler() -> dict[int, int]:
    """State after an inserted or renamed turn: the one role that fits there."""
    return {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}


def _inserts():
    """Cheapest way from state to state by inserted turns alone."""
    cost = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        at, spent = state, 0
        while cost[state][at] == NEVER:
            cost[state][at] = spent
            at, spent = _filler()[at], spent + INSERT
    return tuple(map(tuple, cost))


INSERTS = _inserts()
FINISH = _apply(INSERTS, (0, NEVER, NEVER, 0))


def _level(costs):
    """Costs without their common part, so equal choices are found again."""
    low = min(costs)
    return tuple(c - low if c < NEVER else NEVER for c in costs)


def runs(symbols: str) -> list[tuple[str, int]]:
    data = np.frombuffer(symbols.encode("latin-1"), np.uint8)
    heads = np.flatnonzero(np.append(True, data[1:] != data[:-1])) if len(data) else np.zeros(0, np.int64)
    return [(chr(data[h]), int(n)) for h, n in zip(heads, np.diff(np.append(heads, len(data))))]


class Solver:
    """The program over runs, with the powers and choices met so far."""

    def __init__(self):
        self.powers, self.choices = {}, {}

    def power(self, sign: str, k: int):
        """The transition of 2**k equal symbols."""
        found = self.powers.get((sign, k))
        if found is None:
            if k:
                half = self.power(sign, k - 1)
                found = _times(half, half)
            else:
                found = _times(INSERTS, _turn_costs(sign))
            self.powers[sign, k] = found
        return found

    def behind(self, sign: str, length: int, after):
        """Cheapest costs from before a run to the end, given those from behind it."""
        k = 0
        while length:
            if length & 1:
                after = _apply(self.power(sign, k), after)
            length, k = length >> 1, k + 1
        return after

    def one(self, sign: str, state: int, after) -> tuple[str, int]:
        """Edits of one turn and the state behind it; smaller edits first."""
        role, fault = ROLES[(ord(sign) - 65) // FAULTS], (ord(sign) - 65) % FAULTS
        before, edits = _apply(self.power(sign, 0), after), ""
        while True:
            best, filler, kept = before[state], _filler()[state], FITS[role].get(state)
            if DELETE + after[state] == best:
                return edits + "D", state
            if INSERT + before[filler] == best:
                edits, state = edits + "I", filler
            elif kept is not None and fault < 2 and KEEP + TRUNCATED * fault + after[kept] == best:
                return edits + "K", kept
            else:
                return edits + "R", filler

    def unroll(self, sign: str, length: int, state: int, after) -> tuple[str, int]:
        """Edits of a run and the state behind it."""
        after = _level(after)
        found = self.choices.get((sign, length, state, after))
        if found is None:
            if length == 1:
                found = self.one(sign, state, after)
            else:
                first = 1 << (length - 1).bit_length() - 1
                edits, state_between = self.unroll(sign, first, state, self.behind(sign, length - first, after))
                more, end = self.unroll(sign, length - first, state_between, after)
                found = edits + more, end
            if length <= REUSED:
                if len(self.choices) >= CHOICES:
                    self.choices.clear()
                self.choices[sign, length, state, after] = found
        return found

    def solve(self, symbols: str) -> tuple[int, str]:
        """Least cost, and the ASCII-least edits that reach it."""
        parts = runs(symbols)
        costs = [FINISH]
        for sign, length in reversed(parts):
            costs.append(self.behind(sign, length, costs[-1]))
        costs.reverse()
        state, edits = START, []
        for (sign, length), after in zip(parts, costs[1:]):
            made, state = self.unroll(sign, length, state, after)
            edits.append(made)
        return costs[0][START], "".join(edits) + "I" * (FINISH[state] // INSERT)


def _turn_costs(sign: str):
    """Cheapest way of one turn from state to state."""
    role, fault = ROLES[(ord(sign) - 65) // FAULTS], (ord(sign) - 65) % FAULTS
    cost = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        cost[state][state] = DELETE
        if fault < 2:
            for to, spent in ((_filler()[state], RENAME), (FITS[role].get(state), KEEP)):
                if to is not None:
                    cost[state][to] = min(cost[state][to], spent + TRUNCATED * fault)
    return tuple(map(tuple, cost))


def illegal_pairs(symbols: str) -> int:
    """Neighbours that are not system-user, user-assistant or assistant-user."""
    role = (np.frombuffer(symbols.encode("latin-1"), np.uint8).astype(np.int64) - 65) // FAULTS
    pair = role[:-1] * len(ROLES) + role[1:]
    return int((~np.isin(pair, [ROLES.index(a) * len(ROLES) + ROLES.index(b) for a, b in ("su", "ua", "au")])).sum())


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_col, turn_col, role_col, text_col)`` with faults by a checksum of the row's conversation and turn.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it and 4 makes it a user turn. Null role and text, and
    null ids in the checksum, count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce(F.col(text_col), space)
    rows = turns.select(
        F.col(conv_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col), space)).alias(role_col),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, ENDING, "")).otherwise(text).alias(text_col),
        F.when(kind == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1))).alias("_times"), (kind == 0).alias("_gone"))
    return rows.filter(~F.col("_gone")).select(conv_col, turn_col, role_col, text_col, F.explode("_times").alias("_")).drop("_")


def ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, text, pos)``, written: ``pos`` grows along each conversation by turn, nulls first, then role and text.

    Ranges of that order are dealt to the tasks, so a large conversation is
    spread; rows equal in all of it are told apart by an arbitrary number.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_n"))
    order = ["conv", "turn", "role", "text", "_n"]
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return written(dealt.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "turns")


def marked(rows: DataFrame) -> DataFrame:
    """``(conv, pos, fault, sign)`` of ``ordered`` rows; a row's first fault counts: blank, duplicate, truncated."""
    solid = F.regexp_replace("text", BLANK, "")
    row_key = F.sha2(F.concat_ws("\x01", F.coalesce(F.col("conv").cast("string"), F.lit("\x02")), F.length("role").cast("string"), "role", "text"), 256)
    seen = rows.select(
        "conv", "pos", "role", (solid == "").alias("blank"), (~F.coalesce(F.right(solid, F.lit(1)).rlike(ENDING), F.lit(False))).alias("cut"),
        row_key.alias("k"))
    twice = seen.filter(~F.col("blank")).groupBy("k").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = broadcast_if_counted(written(twice.select(F.col("k").alias("_k"), "first"), "repeated"))
    kind = F.left("role", F.lit(1))
    place = F.when(kind == "s", 0).when(kind == "u", 1).when(kind == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(F.col("pos") > F.col("first"), F.lit(False)), "duplicate").when(F.col("cut"), "truncated")
    rank = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    return seen.join(twice, F.col("k") == F.col("_k"), "left").withColumn("fault", fault).select(
        "conv", "pos", "fault", F.char(F.lit(65) + place * FAULTS + rank).alias("sign"))


def _joined(pairs: Column) -> Column:
    """Texts of ``(place, sign)`` structs in the order of their places."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["sign"]), "")


def plan(rows: DataFrame) -> DataFrame:
    """``(conv, blank, duplicate, truncated, illegal, cost, audit)`` of ``ordered`` rows."""
    counts = lambda: [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    pieces = marked(rows).groupBy("conv", F.floor(F.col("pos") / PIECE).alias("piece")).agg(
        *counts(), _joined(F.collect_list(F.struct("pos", "sign"))).alias("sign"))
    whole = pieces.groupBy("conv").agg(
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")], _joined(F.collect_list(F.struct("piece", "sign"))).alias("symbols"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            symbols = batch.column(4).to_pylist()
            solved = [solver.solve(s) for s in symbols]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([illegal_pairs(s) for s in symbols], pa.int64()), pa.array([c for c, _ in solved], pa.int64()),
                 pa.array([a for _, a in solved], pa.string())],
                names=["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    schema = StructType([StructField("conv", whole.schema["conv"].dataType)])
    for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
        schema = schema.add(name, "long")
    return written(whole.mapInArrow(run, schema.add("audit", "string")), "plans")


def _streams(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, next to each other in one partition."""
    empty = F.lit(None).cast("string")
    both = plans.select("conv", F.lit(-1).cast("long").alias("pos"), F.col("audit").alias("role"), empty.alias("text")).unionByName(
        rows.select("conv", "pos", "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "pos")


class _Editor:
    """Applies one conversation's edits to its turns as they pass."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state, self.place = conv, audit, 0, START, 0

    def _turn(self, edit: str, role: str, text: str, state: int):
        self.state, self.place, self.at = state, self.place + 1, self.at + 1
        return self.place, edit, role, text

    def _fill(self, edit: str, text: str):
        state = _filler()[self.state]
        return self._turn(edit, "user" if state == USER else "assistant", text, state)

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._fill("I", "")

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "K":
            yield self._turn("K", role, text, FITS[role[0]][self.state])
        elif edit == "R":
            yield self._fill("R", text)
        else:
            self.at += 1


def _edited(batches: Iterator[pa.RecordBatch]):
    """``(editor, turns)`` as the stream passes; ``turns`` is None when the editor's conversation ends."""
    editor = None
    for batch in batches:
        for conv, pos, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if pos < 0:
                if editor:
                    yield editor, editor.inserted()
                    yield editor, None
                editor = _Editor(conv, role)
            else:
                yield editor, editor.row(role, text)
    if editor:
        yield editor, editor.inserted()
        yield editor, None


def _turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv, place, edit, role, text)``, the repaired turns."""
    conv = StructField("conv", rows.schema["conv"].dataType)
    arrow = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, convs, made, size = None, [], [], 0

        def out():
            columns = zip(*made)
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), *[pa.array(c, f.type) for c, f in zip(columns, arrow)]], names=["conv", *arrow.names])

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for editor, turns in _edited(watched()):
            for turn in turns or ():
                convs.append(editor.conv)
                made.append(turn)
                size += len(turn[3])
                if len(made) >= 10_000 or size > 8_000_000:
                    yield out()
                    convs, made, size = [], [], 0
        if made:
            yield out()

    return _streams(rows, plans).mapInArrow(run, StructType([conv]).add("place", "long").add("edit", "string").add("role", "string").add("text", "string"))


def _hashes(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of ``role:text`` lines, hashed turn by turn."""
    conv = StructField("conv", rows.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found, digest = None, [], hashlib.sha256()

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for editor, turns in _edited(watched()):
            for place, _, role, text in turns or ():
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if turns is None:
                found.append((editor.conv, digest.hexdigest()))
                digest = hashlib.sha256()
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], kind), pa.array([h for _, h in found])], names=["conv", "repaired_sha256"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], kind), pa.array([h for _, h in found])], names=["conv", "repaired_sha256"])

    return _streams(rows, plans).mapInArrow(run, StructType([conv]).add("repaired_sha256", "string"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The plans ``(conv_col, blank, duplicate, truncated, illegal, cost, audit)`` and the repaired turns
    ``(conv_col, place, edit, role, text)``.

    Turns go by ``turn_col``, nulls first, then by role and text, so ties have
    one order. Null role and text count as one space, which is no known role
    and blank. Repeated rows are duplicates of their first. A null conversation
    id is a conversation. Conversations and texts may be very long: turns are
    streamed. An empty table gives empty results; other columns are ignored.
    """
    rows = ordered(turns, conv_col, turn_col, role_col, text_col)
    plans = plan(rows)
    return plans.withColumnRenamed("conv", conv_col), _turns(rows, plans).withColumnRenamed("conv", conv_col)


def summary(
    original: DataFrame, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation of ``original``: the plan of its ``turns``, its gaps in numbering, and the hash of its repaired turns.

    A conversation without turns has zeros, an empty audit and the hash of the
    empty text. Nulls, ties, repeated rows and empty tables as in ``repair``.
    """
    rows = ordered(turns, conv_col, turn_col, role_col, text_col)
    plans = plan(rows)
    gaps = rows.filter("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    found = original.select(F.col(conv_col).alias("_c")).distinct()
    for part in (plans, gaps, _hashes(rows, plans)):
        own = part.withColumnRenamed("conv", "_p")
        found = found.join(own, F.col("_c").eqNullSafe(F.col("_p")), "left").drop("_p")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return found.select(
        F.col("_c").alias(conv_col), zero("gaps"), *[zero(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
