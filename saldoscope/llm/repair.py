"""Repair of conversation structure: Hirschberg's divide and conquer over four states.

A conversation should have the roles ``(system? (user assistant)+)?``. Its rows, in order, are
kept (K, cost 0), given another role (R, 1), deleted (D, 2), and turns are inserted (I, 5); a
truncated row that stays costs 5 more, blank and repeated rows must go. Of the cheapest lists
of edits (the *audit*) the one that is least as a string is taken.

The roles so far are one of four states: nothing, system, user, assistant. Seen from one side,
rows are a vector of four costs. A forward vector of the first half and a backward vector of
the second half meet in the middle: states whose sum is the total are the optimal crossings.
The first half is solved towards them and returns the audit-least one (two different audits of
one half never are prefixes of each other: both end with the same row), from where the second
half goes on. Only vectors are kept, never a table of rows and states. Steps of a vector are
looked up: up to a constant there are few vectors.

The top of the recursion is spread over tasks, so a conversation may be of any length: rows are
dealt by range of (conversation, turn) and become blocks of one byte a row; blocks return their
4 x 4 costs; the backward vectors at block ends follow from these; then all blocks are solved
side by side for each entry state, and a chain through the blocks picks the audit. Texts take
no part in that. Only ``repaired_turns`` and its digest read them, as a stream in order.

Repeats are found without gathering equal texts: a minimum (combined before the shuffle) names
the first turn of each text, and travels with the rows as a marker in front of that turn.

Defined results: null roles and texts are one space. Rows are in the order of turn (nulls first),
role and a 64-bit hash of the text, which is compared within one conversation only. Rows that
repeat are repeats. A null conversation id is a conversation of its own. Other roles than
the three named, by their first letter, can only be changed or deleted. An empty table gives no
rows, an empty conversation cannot occur.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, tune

BLANKS = "\t\n\u000b\u000c\r "
#: Costs of the edits (fixed values).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a block.
BLOCK_ROWS = 4096
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
_NEXT = (2, 2, 3, 2)
_INF = 1 << 40
_CUT_OFF, _GO = 1, 2

Vector = tuple[int, int, int, int]
ACCEPT: Vector = (0, _INF, _INF, 0)


def symbol(initial: str, kind: int) -> int:
    """One byte for a row: its role and whether it is sound, truncated or to go."""
    return 48 + 4 * kind + INITIALS.find(initial or "?") + 1


@lru_cache(None)
def _moves(sym: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what may be done with a row."""
    kind, role = divmod(sym - 48, 4)
    out = [("D", DELETE, state)]
    if kind != _GO:
        extra = TRUNCATED if kind == _CUT_OFF else 0
        if role and (role == _NEXT[state] or role == 1 and state == 0):
            out.append(("K", KEEP + extra, role))
        out.append(("R", REROLE + extra, _NEXT[state]))
    return tuple(out)


def _inserted(v: list[int]) -> Vector:
    """Backward costs if turns may be inserted first."""
    for _ in range(3):
        v = [min(v[s], INSERT + v[_NEXT[s]]) for s in range(4)]
    return tuple(min(x, _INF) for x in v)


@lru_cache(1 << 16)
def _back(sym: int, v: Vector) -> tuple[Vector, int]:
    out = _inserted([min(c + v[t] for _, c, t in _moves(sym, s)) for s in range(4)])
    low = min(out)
    return tuple(min(x - low, _INF) if x < _INF else _INF for x in out), low


@lru_cache(1 << 16)
def _forth(sym: int, v: Vector) -> tuple[Vector, int]:
    v = list(v)
    for _ in range(3):
        for s in range(4):
            v[_NEXT[s]] = min(v[_NEXT[s]], v[s] + INSERT)
    out = [_INF] * 4
    for s in range(4):
        for _, c, t in _moves(sym, s):
            out[t] = min(out[t], v[s] + c)
    low = min(out)
    return tuple(x - low if x < _INF else _INF for x in out), low


def backward(rows: bytes, v: Vector) -> tuple[Vector, int]:
    """Costs before ``rows`` of reaching ``v`` behind them, less a constant, and the constant."""
    total = 0
    for sym in reversed(rows):
        v, low = _back(sym, v)
        total += low
    return v, total


def forward(rows: bytes, state: int) -> tuple[Vector, int]:
    v, total = tuple(0 if s == state else _INF for s in range(4)), 0
    for sym in rows:
        v, low = _forth(sym, v)
        total += low
    return v, total


@lru_cache(1 << 16)
def _leaf(sym: int, state: int, v: Vector) -> tuple[str, int]:
    """Audit-least cheapest edits of one row from ``state`` towards ``v``, and the state behind it."""
    before, low = _back(sym, v)
    left, audit = before[state] + low, ""
    while True:
        moves = {x: (c, t, v[t]) for x, c, t in _moves(sym, state)}
        moves["I"] = (INSERT, _NEXT[state], before[_NEXT[state]] + low)
        x, (cost, to, _) = next((x, m) for x, m in sorted(moves.items()) if m[0] + m[2] == left)
        audit, left, state = audit + x, left - cost, to
        if x != "I":
            return audit, state


def solve(rows: bytes, state: int, v: Vector) -> tuple[str, int]:
    """Audit-least cheapest edits of ``rows`` from ``state`` towards costs ``v``, and the state behind them."""
    if not rows:
        return "", state
    if len(rows) == 1:
        return _leaf(rows[0], state, v)
    half = len(rows) // 2
    ahead, _ = backward(rows[half:], v)
    behind, _ = forward(rows[:half], state)
    best = min(a + b for a, b in zip(ahead, behind))
    meet = tuple(a if a + b == best else _INF for a, b in zip(ahead, behind))
    first, state = solve(rows[:half], state, meet)
    second, state = solve(rows[half:], state, v)
    return first + second, state


def closing(state: int) -> str:
    """Turns to insert behind the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _plain(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    return turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Pieces of conversations, in order of ``block``, without texts."""
    end = stripped(F.col("text"))
    kind = F.when(end == "", 3).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    narrow = rows.select("conv_id", "turn", "role", "h", F.lit(1).alias("mark"), kind.alias("kind"))
    first = narrow.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("at"))
    marks = first.select("conv_id", "at.turn", "role", "h", F.lit(0).alias("mark"), F.lit(0).alias("kind"))
    order = ["conv_id", "turn", "role", "h"]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.union(marks).repartitionByRange(width, *order).sortWithinPartitions(*order, "mark")
    fields = [("conv_id", pa.int64()), ("block", pa.int64()), ("rows", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("begins", pa.string()),
              ("ends", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40  # partitions are in the order of their ranges
        done, seen, marked = [], bytearray(), None
        now = low = high = begins = ends = None
        turns = blank = duplicate = truncated = illegal = 0
        for batch in batches:
            for c, t, r, h, mark, kind in zip(*(batch.column(n).to_pylist() for n in (*order, "mark", "kind"))):
                if not mark:
                    marked = (c, t, r, h)
                    continue
                if seen and (c != now or len(seen) >= block_rows):
                    done.append((now, block, seen.decode(), low, high, turns, begins, ends, blank, duplicate, truncated, illegal))
                    block, seen = block + 1, bytearray()
                if not seen:
                    now, low, high, begins, ends = c, None, None, r[:1], None
                    turns = blank = duplicate = truncated = illegal = 0
                fresh, marked = marked == (c, t, r, h), None  # the first of equal rows uses the marker up
                if kind == 3:
                    blank += 1
                elif not fresh:
                    kind, duplicate = 2, duplicate + 1
                elif kind:
                    truncated += 1
                illegal += ends is not None and ends + r[:1] not in LEGAL
                ends = r[:1]
                if t is not None:
                    turns += t != high
                    low, high = t if low is None else low, t
                seen.append(symbol(ends, min(kind, _GO)))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*done), fields)], names=[n for n, _ in fields])
                done = []
        if seen:
            done.append((now, block, seen.decode(), low, high, turns, begins, ends, blank, duplicate, truncated, illegal))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*done), fields)], names=[n for n, _ in fields])

    names = {pa.int64(): "long", pa.string(): "string"}
    return dealt.mapInArrow(run, ", ".join(f"{n} {names[k]}" for n, k in fields))


def _of_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` added, which ``fn`` computes from a row (a dict)."""
    names = [part.split()[0] for part in schema.split(", ")]
    target = df.limit(0).selectExpr("*", *[f"cast(null as {part.split()[1]}) as {part.split()[0]}" for part in schema.split(", ")]).schema

    def run(batches):
        for batch in batches:
            made = [fn(row) for row in batch.to_pylist()]
            kinds = [pa.list_(pa.int64()) if "array<long" in k else pa.list_(pa.string()) if "array<string" in k else pa.string() if k == "string" else pa.int64() for k in (p.split()[1] for p in schema.split(", "))]
            added = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, target)


def _matrix(row: dict) -> tuple[list[int]]:
    """Costs from each state before a block to each state behind it."""
    rows = row["rows"].encode()
    columns = []
    for t in range(4):
        v, low = backward(rows, tuple(0 if s == t else _INF for s in range(4)))
        columns.append([x + low if x < _INF else _INF for x in v])
    return ([columns[t][s] for s in range(4) for t in range(4)],)


def _behind(row: dict) -> tuple[list[int]]:
    """Of a conversation's matrices in order: the backward vector behind each block, one after the other."""
    v, out = list(_inserted(list(ACCEPT))), []
    for piece in reversed(row["pieces"]):
        out.append(v)
        m = piece["matrix"]
        v = [min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4)]
        v = [min(x - min(v), _INF) for x in v]
    return ([x for v in reversed(out) for x in v],)


def _solved(row: dict) -> tuple[list[str], list[int]]:
    """Audit and exit of a block for each entry state; a conversation's only block is entered from state 0."""
    rows = row["rows"].encode()
    ahead = tuple(row["ahead"]) if row["ahead"] else _inserted(list(ACCEPT))
    reach = backward(rows, ahead)[0]
    found = [solve(rows, s, ahead) if reach[s] < _INF and (row["ahead"] or not s) else ("", 0) for s in range(4)]
    return [a for a, _ in found], [e for _, e in found]


def _chained(row: dict) -> tuple:
    """Everything about a conversation from its solved blocks."""
    state, audit, before = 0, [], None
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = None
    for p in row["pieces"]:
        audit.append(p["audits"][state])
        state = p["exits"][state]
        for k in sums:
            sums[k] += p[k]
        if before:
            sums["illegal"] += before["ends"] + p["begins"] not in LEGAL
            sums["turns"] -= before["high"] is not None and before["high"] == p["low"]
        low, high = p["low"] if low is None else low, p["high"] if p["high"] is not None else high
        before = p
    audit = "".join(audit) + closing(state)
    return audit, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], high - low + 1 - sums["turns"] if low is not None else 0


def _audited(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    blocks = cut(_blocks(rows, block_rows))
    long = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    # conversations in several blocks: the vectors behind each block
    parts = _of_rows(blocks.join(long, blocks["conv_id"].eqNullSafe(long["conv_id"]), "left_semi").select("conv_id", "block", "rows"), _matrix, "matrix array<long>")
    behind = _of_rows(parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("pieces")), _behind, "v array<long>")
    ahead = behind.select(F.posexplode("pieces.block").alias("i", "_block"), "v").select("_block", F.slice("v", 4 * F.col("i") + 1, 4).alias("ahead"))
    solved = _of_rows(blocks.join(ahead, F.col("block") == F.col("_block"), "left").drop("_block"), _solved, "audits array<string>, exits array<long>").drop("rows", "ahead")
    pieces = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", *[c for c in solved.columns if c not in ("conv_id", "block")]))).alias("pieces"))
    return _of_rows(pieces, _chained, "audit string, blank long, duplicate long, truncated long, illegal long, gaps long").drop("pieces")


def audits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, audit, blank, duplicate, truncated, illegal, gaps) of every conversation."""
    tune(turns.sparkSession)
    return _audited(_plain(turns, conv, turn, role, text), block_rows)


class _Replay:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.cost = 0

    def _step(self, letter: str, role: str, text: str, cut_off: bool) -> tuple[str, str, str]:
        self.cost += {"K": KEEP, "R": REROLE, "I": INSERT}[letter] + (TRUNCATED if cut_off else 0)
        self.state = INITIALS.index(role[:1]) + 1 if letter == "K" else _NEXT[self.state]
        return role if letter == "K" else ("user" if self.state == 2 else "assistant"), text, letter

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._step("I", "", "", False)

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            self.cost += DELETE
        else:
            yield self._step(letter, role, text, text.rstrip(BLANKS)[-1:] not in (".", "!", "?"))


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation, then its rows in order; a conversation in one task, as a stream."""
    head = found.select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("h"))
    body = rows.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "text", "h")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return head.union(body).repartition(width, "conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "h")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, _Replay, tuple[str, str, str] | None]]:
    """(conversation, replay, turn) of every repaired turn; the turn is None where a conversation ends."""
    conv, replay = None, None
    for batch in batches:
        for c, tag, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "tag", "role", "text"))):
            if tag:
                for item in replay.row(role, text):
                    yield conv, replay, item
                continue
            if replay:
                for item in replay.inserted():
                    yield conv, replay, item
                yield conv, replay, None
            conv, replay = c, _Replay(text)
    if replay:
        for item in replay.inserted():
            yield conv, replay, item
        yield conv, replay, None


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, text, edit): the repaired conversations, from position 0 on."""
    tune(turns.sparkSession)
    rows = _plain(turns, conv, turn, role, text)
    names, kinds = ["conv_id", "position", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        out, position = [], 0
        for c, _, item in _replayed(batches):
            if item is None:
                position = 0
                continue
            out.append((c, position, *item))
            position += 1
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return _stream(rows, _audited(rows)).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: gaps, faults, cost and audit of the repair, and a digest of the repaired turns."""
    tune(turns.sparkSession)
    rows = _plain(turns, conv, turn, role, text)
    found = cut(_audited(rows))

    def run(batches):
        out, digest, first = [], hashlib.sha256(), True
        for c, replay, item in _replayed(batches):
            if item is not None:
                digest.update(("" if first else "\n").encode() + f"{item[0]}:{item[1]}".encode())
                first = False
                continue
            out.append((c, replay.cost, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["_conv", "cost", "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["_conv", "cost", "repaired_sha256"])

    digests = _stream(rows, found).mapInArrow(run, "_conv long, cost long, repaired_sha256 string")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows spoilt by a fixed rule, to show and test the repair: some dropped, emptied, cut off, repeated, given to the user."""
    rows = _plain(turns, conv, turn, role, text).drop("h")
    key = F.concat(*(F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    rows = rows.withColumn("_how", F.crc32(key.cast("binary")) % 20).where("_how != 0")
    rows = rows.withColumn("text", F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.expr("sequence(0, if(_how = 3, 1, 0))"))).drop("_how", "_copy")
