"""Operator 12: repair of conversation structure by a run-length dynamic programme.

Rows of a conversation become symbols of role and fault, and equal consecutive symbols one run. Keeping, reroling or deleting a row and
inserting one are steps of a small automaton for the role order `(s?(ua)+)?`; the cheapest costs over a row are a min-plus matrix, and
those over a run the power of that matrix, put together from cached binary powers. Costs go backward from the end; the choices are
then unrolled forward, taking the least letter that stays on a cheapest way.

Rows are range-partitioned by conversation and turn. A conversation that lies within a partition is done there; one that is cut
leaves a row a piece with its min-plus matrix, from whose products the costs behind each piece follow, so a conversation may
span many tasks. Only the hash of its repaired text has to pass through one, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.llm.common import parts, tuned, written

# Costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States of the role order: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
INF = 1 << 60

#: Symbols are 3 * role + fault.
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
SOUND, CUT_OFF, UNFIT = range(3)

#: The state after a user or assistant row put at each state, and after a kept row of each role.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({0: SYSTEM, 1: USER}, {1: USER}, {2: ASSISTANT}, {1: USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: Rows and bytes of text of a piece at most, one row more; rows unrolled at once.
PIECE_ROWS, PIECE_TEXT, UNROLLED = 1 << 16, 4 << 20, 1 << 10
#: Pieces of a conversation that a task holds before it lets them go as rows.
HELD = 8

# Min-plus steps -----------------------------------------------------------------------------------------------------------

Vector = tuple[int, ...]


def inserted(costs: Vector) -> Vector:
    """Costs to the end from each state where rows may be inserted first; more than two never pay."""
    for _ in range(2):
        costs = tuple(min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES)
    return costs


#: Costs at the end of a conversation.
END = inserted((0, INF, INF, 0))


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, by letter."""
    role, fault = divmod(symbol, 3)
    out = [("D", DELETE, state)]
    if fault != UNFIT:
        extra = TRUNCATED if fault == CUT_OFF else 0
        if role in KEPT[state]:
            out.append(("K", extra, KEPT[state][role]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def before(symbol: int, costs: Vector) -> Vector:
    """Costs before a row, from those behind it."""
    return inserted(tuple(min(cost + costs[q] for _, cost, q in edits(symbol, state)) for state in STATES))


def applied(matrix: tuple[Vector, ...], costs: Vector) -> Vector:
    return tuple(min(INF, *(a + b for a, b in zip(row, costs))) for row in matrix)


UNITS = tuple(tuple(0 if i == j else INF for i in STATES) for j in STATES)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2**k rows of a symbol."""
    if k == 0:
        columns = [before(symbol, unit) for unit in UNITS]
    else:
        half = power(symbol, k - 1)
        columns = [applied(half, applied(half, unit)) for unit in UNITS]
    return tuple(zip(*columns))


def advanced(symbol: int, n: int, costs: Vector) -> Vector:
    """Costs before a run of `n` rows, from those behind it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs = applied(power(symbol, k), costs)
    return costs


def matrix_of(runs: list[tuple[int, int]]) -> tuple[Vector, ...]:
    columns = []
    for costs in UNITS:
        for symbol, n in reversed(runs):
            costs = advanced(symbol, n, costs)
        columns.append(costs)
    return tuple(zip(*columns))


@lru_cache(maxsize=1 << 16)
def _step(symbol: int, relative: Vector) -> tuple[int, Vector, tuple[tuple[str, int], ...]]:
    """Costs before a row as (least, relative), and from each state the letters of its cheapest least edits and the state behind them."""
    costs = before(symbol, relative)
    choices = []
    for state in STATES:
        letters, at = "", state
        while True:
            ways = [(letter, cost, q, relative[q]) for letter, cost, q in edits(symbol, at)] + [("I", INSERT, NEXT[at], costs[NEXT[at]])]
            letter, _, q, _ = min(way for way in ways if way[1] + way[3] == costs[at])
            letters, at = letters + letter, q
            if letter != "I":
                break
        choices.append((letters, at))
    least = min(costs)
    return least, tuple(c - least for c in costs), tuple(choices)


def _relative(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(c - least for c in costs)


def unrolled(runs: list[tuple[int, int]], behind: Vector, state: int) -> Iterator[tuple[str, int]]:
    """For each row the letters of its edits and the state behind them; `behind` are the costs after the last run."""
    ends = [behind]
    for symbol, n in reversed(runs[1:]):
        ends.append(advanced(symbol, n, ends[-1]))
    for (symbol, n), end in zip(runs, reversed(ends)):
        while n:
            some = min(n, UNROLLED)
            n -= some
            relative, steps = _relative(advanced(symbol, n, end)), []
            for _ in range(some):
                _, earlier, choices = _step(symbol, relative)
                steps.append(choices)
                relative = earlier
            for choices in reversed(steps):
                letters, state = choices[state]
                yield letters, state


def last_inserts(state: int) -> str:
    """Rows still to be inserted at the end."""
    return {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


# Pieces of conversations --------------------------------------------------------------------------------------------------

COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")
_PIECE = (
    "at long, matrix array<long>, roles array<string>, texts array<string>, copies array<long>, symbols array<long>, low long, high long, "
    "first string, last string, n long, turns long, blank long, duplicate long, truncated long, illegal long"
)
_DONE = "gaps long, cost long, audit string, repaired_sha256 string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
RESULT = f"conv string, conv_id long, {_PIECE}, {_DONE}"
LEGAL = {"su", "ua", "au"}


class Piece:
    """Consecutive rows of one conversation with their symbols and counts."""

    def __init__(self, conv: str, conv_id: int | None):
        self.conv, self.conv_id = conv, conv_id
        self.roles, self.texts, self.copies, self.symbols = [], [], [], []
        self.low = self.high = self.first = self.last = None
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.size = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        """A row and its adjacent repetitions; `seen`: the conversation has had its role and text before."""
        initial = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first, self.last = initial if self.first is None else self.first, initial
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        solid = text.rstrip(" \t\n\v\f\r")
        if not solid:
            self.blank, fault = self.blank + copies, UNFIT
        elif seen:
            self.duplicate, fault = self.duplicate + copies, UNFIT
        else:
            fault = SOUND if solid[-1] in ".!?" else CUT_OFF
            self.duplicate += copies - 1
            self.truncated += fault == CUT_OFF
        self.n += copies
        self.roles.append(role)
        self.texts.append(None if fault == UNFIT else text)
        self.copies.append(copies)
        self.symbols.append(3 * ROLES.get(initial, OTHER) + fault)
        self.size += len(text)

    def runs(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for symbol, copies in zip(self.symbols, self.copies):
            for s, n in ((symbol, 1), (symbol - symbol % 3 + UNFIT, copies - 1)):  # repetitions are blank or duplicates
                if n and out and out[-1][0] == s:
                    out[-1] = (s, out[-1][1] + n)
                elif n:
                    out.append((s, n))
        return out


class Repair:
    """The result of a conversation whose pieces come in order, each with the costs behind it."""

    def __init__(self):
        self.state, self.sha, self.audit, self.bare = EMPTY, hashlib.sha256(), [], True
        self.low = self.high = self.last = self.cost = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def _emit(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.bare else chr(10)}{role}:{text}".encode())
        self.bare = False

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self._emit(NAMES[self.state], "")

    def add(self, piece: Piece, behind: Vector) -> None:
        runs = piece.runs()
        if self.cost is None:
            costs = behind
            for symbol, n in reversed(runs):
                costs = advanced(symbol, n, costs)
            self.cost = costs[EMPTY]
        for name in ("turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(piece, name))
        if piece.low is not None:
            self.turns -= self.high == piece.low
            self.low, self.high = piece.low if self.low is None else self.low, piece.high
        if piece.n:
            self.illegal += self.last is not None and self.last + piece.first not in LEGAL
            self.last = piece.last
        steps = unrolled(runs, behind, self.state)
        for role, text, copies in zip(piece.roles, piece.texts, piece.copies):
            for _ in range(copies):
                letters, state = next(steps)
                self.audit.append(letters)
                for _ in range(len(letters) - 1):
                    self._insert()
                if letters[-1] != "D":
                    self._emit(role if letters[-1] == "K" else NAMES[state], text)
                self.state = state

    def row(self) -> dict:
        rest = last_inserts(self.state)
        for _ in rest:
            self._insert()
        return {
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost or 0, "audit": "".join(self.audit) + rest,
            "repaired_sha256": self.sha.hexdigest(),
        }


def _repaired(found: list[Piece]) -> dict:
    """The result of a conversation from all of its pieces."""
    behind = [END]
    for piece in reversed(found[1:]):
        costs = behind[-1]
        for symbol, n in reversed(piece.runs()):
            costs = advanced(symbol, n, costs)
        behind.append(costs)
    out = Repair()
    for piece, costs in zip(found, reversed(behind)):
        out.add(piece, costs)
    return {"conv": found[0].conv, "conv_id": found[0].conv_id} | out.row()


def _rows(rows: list[dict]) -> pa.RecordBatch:
    fields = [c.split(" ") for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _TYPES[kind]) for name, kind in fields], [f[0] for f in fields])


def _cut(piece: Piece, at: int) -> dict:
    """A piece as a row."""
    matrix = [c for row in matrix_of(piece.runs()) for c in row]
    names = ("conv", "conv_id", "roles", "texts", "copies", "symbols", "low", "high", "first", "last", *COUNTS)
    return {name: getattr(piece, name) for name in names} | {"at": at, "matrix": matrix}


SORTED = ("conv", "known", "order", "role", "prefix", "text")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted as SORTED: results of the conversations within the partition, pieces of those at its ends."""
    at = TaskContext.get().partitionId() << 32
    rows, size = [], 0
    found: list[Piece] = []
    cutting = True  # the first conversation may have begun in the partition before
    marked, place, previous = set(), None, None

    def pieces_of() -> list[dict]:
        nonlocal at, size
        out = []
        for piece in found:
            out.append(_cut(piece, at))
            at, size = at + 1, size + piece.size
        return out

    names = ("conv", "conv_id", "known", "order", "role", "prefix", "text", "digest", "copies")
    for batch in batches:
        for conv, conv_id, known, order, role, prefix, text, digest, copies in zip(*[batch.column(c).to_pylist() for c in names]):
            if not found or found[0].conv != conv:
                if found:
                    rows.extend(pieces_of() if cutting else [_repaired(found)])
                    cutting = False
                found = [Piece(conv, conv_id)]
            if text is None:  # a mark: this role and text of the turn has been seen in an earlier one
                spot = (conv, known, order, role, prefix)
                marked, place = (marked, place) if spot == place else (set(), spot)
                marked.add(digest)
                continue
            if not copies:
                continue
            if len(found[-1].roles) >= PIECE_ROWS or found[-1].size >= PIECE_TEXT:
                if cutting or len(found) >= HELD:
                    rows.extend(pieces_of())
                    cutting, found = True, []
                found.append(Piece(conv, conv_id))
            again = (conv, known, order, role, text) == previous
            seen = again or ((conv, known, order, role, prefix) == place and hashlib.md5(text.encode()).hexdigest() in marked)
            previous = (conv, known, order, role, text)
            found[-1].add(order if known else None, role, text, copies, seen)
            if len(rows) >= 64 or size >= PIECE_TEXT:
                yield _rows(rows)
                rows, size = [], 0
    if found:
        rows.extend(pieces_of())  # the last one may go on in the partition behind
    while rows:
        yield _rows(rows[:HELD])
        rows = rows[HELD:]


def _behind(table: pa.Table) -> pa.Table:
    """Costs behind each piece of one conversation."""
    at = table.column("at").to_pylist()
    matrices = table.column("matrix").to_pylist()
    costs, out = END, [None] * len(at)
    for i in sorted(range(len(at)), key=at.__getitem__, reverse=True):
        out[i] = list(costs)
        costs = applied(tuple(tuple(matrices[i][4 * q : 4 * q + 4]) for q in STATES), costs)
    return pa.table({"conv": table.column("conv"), "at": table.column("at"), "behind": pa.array(out, pa.list_(pa.int64()))})


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of cut conversations from their pieces in order."""
    now, out, rows = None, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if now is None or row["conv"] != now["conv"]:
                if now is not None:
                    rows.append(now | out.row())
                now, out = {"conv": row["conv"], "conv_id": row["conv_id"]}, Repair()
            piece = Piece(row["conv"], row["conv_id"])
            for name in ("roles", "texts", "copies", "symbols", "low", "high", "first", "last", *COUNTS):
                setattr(piece, name, row[name])
            out.add(piece, tuple(row["behind"]))
            if len(rows) >= 64:
                yield _rows(rows)
                rows = []
    if now is not None:
        rows.append(now | out.row())
    if rows:
        yield _rows(rows)


def _or_blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    `rows` has conv_id, turn, role, text and copies: so many times the row stands there, 0 for a row that only names its conversation.
    Rows go by turn, null turns first, and within a turn by role and text. Null roles and texts count as one space, so such texts are
    blank; rows without a conversation id are one conversation with a null id. Other columns are ignored. No rows: no result.
    """
    spark = tuned(rows.sparkSession)
    text, role = _or_blank("text"), _or_blank("role")
    rows = rows.select(
        _or_blank("conv_id").alias("conv"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().cast("int").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("order"),
        role.alias("role"), F.substring(text, 1, 32).alias("prefix"), text.alias("text"), F.md5(text).alias("digest"),
        F.col("copies").cast("long").alias("copies"),
    )
    # later turns with a role and text that the conversation has had: marks without the texts
    turn = F.struct("known", "order")
    same = ["conv", "role", "digest"]
    said = rows.where("copies > 0")
    twice = said.groupBy(*same).agg(F.min(turn).alias("since"), F.max(turn).alias("until")).where("since < until").drop("until")
    marks = said.select(*same, "conv_id", "known", "order", "prefix").join(twice, same).where(turn > F.col("since")).drop("since").distinct()
    dealt = rows.unionByName(marks, allowMissingColumns=True).repartitionByRange(parts(spark), "conv", "known", "order", "role", "prefix")
    found = written(dealt.sortWithinPartitions(*SORTED).mapInArrow(_scan, RESULT), "conversations")
    cut = found.where("at is not null")
    behind = cut.select("conv", "at", "matrix").groupBy("conv").applyInArrow(_behind, "conv string, at long, behind array<long>")
    order = cut.drop("matrix").join(behind, ["conv", "at"]).repartition(parts(spark), "conv").sortWithinPartitions("conv", "at")
    out = found.where("at is null").union(order.mapInArrow(_stream, RESULT))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn: (conv_id, turn, role, text, copies)."""
    code = F.crc32(F.concat(_or_blank("conv_id"), F.lit(":"), _or_blank("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(_or_blank("text"), ".!?", "")).otherwise(_or_blank("text"))
    return conversations.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(_or_blank("role")).alias("role"), text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def op12_repair(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations))
