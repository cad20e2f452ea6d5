"""Operator 11: repair of the turn structure of conversations by a run-length DP.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Each row is kept (K),
given the other role (R, cost 1) or deleted (D, cost 2; required for blank rows and
repetitions), empty rows may be inserted (I, cost 5), and a truncated row that is not
deleted costs 5 more.  The cheapest edits are taken; ties go to the audit (the edits'
initials in order) that is least in ASCII.

A row is one of nine symbols (four kinds of role, whole or truncated, or "to be
deleted"), and a symbol is a 4 x 4 min-plus transition between the grammar's states.
Equal consecutive symbols form a run; a run of L rows advances the costs-to-go by the
binary powers of its transition, which are cached for all conversations.  A forward
pass then unrolls the choices: in a given state every letter leads to one state, so
the least letter that keeps the cheapest cost gives the least audit.

Scale: conversations are dealt by id and sorted by turn, and a task streams them, one
at a time.  A conversation of more than ``hot_rows`` rows goes another way: repeated
rows are counted first, rows are range-partitioned by (conversation, turn) into
blocks, a block sends one 4 x 4 matrix, the matrices give the costs-to-go behind each
block, and blocks unroll on their own for all four entry states.  Only its last pass
(texts in order beside the finished audit) is one stream, which a digest over the whole
conversation demands; it holds the audit, not the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import prepared, scratch_path

HOT_ROWS = 10_000          # rows beyond which a conversation is cut into blocks
BLOCK_ROWS = 50_000        # most rows of a block

# States of the grammar, named by what came last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)           # state after one more user or assistant turn
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5  # costs
TO_DELETE = 8                                   # symbol; others are kind of role + 4 if truncated
KINDS = {"s": 0, "u": 1, "a": 2}                # other initials are kind 3
AT_END = (0, 10, 5, 0)                          # cost of inserts that end a conversation in each state
FAR = 1 << 60

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


# ------------------------------------------------------------------ transitions
def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: (letter, cost, state behind it), letters ascending."""
    out = [("D", DELETE, state)]
    if symbol != TO_DELETE:
        kind, more = symbol % 4, TRUNCATED if symbol >= 4 else 0
        if kind == 0 and state == START:
            out.append(("K", more, SYSTEM))
        elif kind == 1 and state != USER:
            out.append(("K", more, USER))
        elif kind == 2 and state == USER:
            out.append(("K", more, ASSISTANT))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def transition(symbol: int) -> Matrix:
    """Cheapest cost between states over one row, with the inserts before it."""
    rows = []
    for state in range(4):
        best, at, cost = [FAR] * 4, state, 0
        for _ in range(3):                      # three inserts return to a state at a cost
            for _, more, to in moves(symbol, at):
                best[to] = min(best[to], cost + more)
            at, cost = NEXT[at], cost + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


class Transitions:
    """Binary powers of the symbols' transitions and their effect on costs-to-go, cached."""

    def __init__(self) -> None:
        self._powers = {s: [transition(s)] for s in range(9)}
        self._steps: dict[tuple[int, int, Vector], tuple[Vector, int]] = {}
        self._choices: dict[tuple[int, int, Vector], tuple[str, int]] = {}

    def power(self, symbol: int, k: int) -> Matrix:
        """The transition of 2^k equal rows."""
        own = self._powers[symbol]
        while len(own) <= k:
            own.append(times(own[-1], own[-1]))
        return own[k]

    def _step(self, symbol: int, k: int, v: Vector) -> tuple[Vector, int]:
        """Costs-to-go before 2^k rows, from those behind them (smallest entry 0): vector and what it lost."""
        found = self._steps.get((symbol, k, v))
        if found is None:
            out = [min(m + c for m, c in zip(row, v)) for row in self.power(symbol, k)]
            low = min(out)
            found = self._steps[symbol, k, v] = (tuple(c - low for c in out), low)
        return found

    def before(self, symbol: int, length: int, v: Vector) -> tuple[Vector, int]:
        """The same before a run of any length, by its binary powers."""
        total, k = 0, 0
        while length:
            if length & 1:
                v, low = self._step(symbol, k, v)
                total += low
            length, k = length >> 1, k + 1
        return v, total

    def matrix(self, runs: Iterable[tuple[int, int]]) -> Matrix:
        """The transition of a sequence of runs."""
        out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
        for symbol, length in runs:
            k = 0
            while length:
                if length & 1:
                    out = times(out, self.power(symbol, k))
                length, k = length >> 1, k + 1
        return out

    def choice(self, symbol: int, state: int, v: Vector) -> tuple[str, int]:
        """Least letters among the cheapest for one row with costs-to-go ``v`` behind it, and the state then."""
        found = self._choices.get((symbol, state, v))
        if found is None:
            here, low = self._step(symbol, 0, v)
            letters, at = "", state
            while True:
                goal = here[at] + low
                edits = {letter: to for letter, cost, to in moves(symbol, at) if cost + v[to] == goal}
                if here[NEXT[at]] + low + INSERT == goal:
                    edits["I"] = NEXT[at]
                letter = min(edits)
                letters, at = letters + letter, edits[letter]
                if letter != "I":
                    break
            found = self._choices[symbol, state, v] = (letters, at)
        return found

    def unroll(self, runs: list[tuple[int, int]], state: int, end: Vector) -> tuple[str, int]:
        """Letters of all rows from ``state`` on, with costs-to-go ``end`` behind them, and the state then."""
        behind = []
        v = end
        for symbol, length in reversed(runs):
            behind.append(v)
            v, _ = self.before(symbol, length, v)
        out = []
        for (symbol, length), v in zip(runs, reversed(behind)):
            if length > 1:                      # costs-to-go behind each row of the run
                inside = [v]
                for _ in range(length - 1):
                    inside.append(self._step(symbol, 0, inside[-1])[0])
                for v in reversed(inside):
                    letters, state = self.choice(symbol, state, v)
                    out.append(letters)
            else:
                letters, state = self.choice(symbol, state, v)
                out.append(letters)
        return "".join(out), state


def closing(state: int) -> str:
    """Inserts that end a conversation in a state."""
    return "I" * (AT_END[state] // INSERT)


def add_row(runs: list[tuple[int, int]], symbol: int, copies: int = 1) -> None:
    """Append equal symbols to the runs."""
    if copies and runs and runs[-1][0] == symbol:
        runs[-1] = (symbol, runs[-1][1] + copies)
    elif copies:
        runs.append((symbol, copies))


def symbol_of(role: str, truncated: bool) -> int:
    return KINDS.get(role[:1], 3) + (4 if truncated else 0)


# ------------------------------------------------------------------ rows
def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20``, null ids and turns being one space there:
    0 drops a row (``copies`` 0), 1 empties its text, 2 removes its end marks, 3 repeats it (``copies`` 2), 4 makes it the user's."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return conversations.withColumn("__d", F.crc32(key.cast("binary")) % 20).select(
        "conv_id", "turn", F.when(F.col("__d") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
        .alias("text"), F.when(F.col("__d") == 0, 0).when(F.col("__d") == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with their copies, a text digest that orders ties, and whether they are blank or truncated."""
    space = " \t\n\x0b\x0c\r"
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    body = F.rtrim(F.col("text"), F.lit(space))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies")) \
        .withColumns({"digest": F.sha2("text", 256), "blank": body == "",
                      "truncated": (body != "") & ~F.substring(body, -1, 1).isin(".", "!", "?")})


ORDER = ["turn", "role", "digest"]               # of a conversation's rows; null turns come first
EDIT_FIELDS = "position long, edit string, turn long, role string, text string"
REPORT_FIELDS = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                 "repaired_sha256 string")
LEGAL = {"su", "ua", "au"}


class _Reader:
    """One conversation read in order beside its audit; gives its edits or its report."""

    def __init__(self, audit: str, counts: tuple[int, int, int], edits: bool):
        self.audit, self.counts, self.at, self.state, self.cost = audit, counts, 0, START, 0
        self.turns: list = [None, None, 0]       # smallest, largest, distinct
        self.initial, self.illegal = None, 0
        self.edits: list | None = [] if edits else None
        self.sha, self.empty = hashlib.sha256(), True

    def _put(self, letter: str, turn: int | None, role: str, text: str) -> None:
        if self.edits is not None:
            self.edits.append((self.at, letter, turn, role, text))
        elif letter != "D":
            line = f"{role}:{text}" if self.empty else f"\n{role}:{text}"
            self.sha.update(line.encode("utf-8", "surrogatepass"))
            self.empty = False

    def _insert(self) -> None:
        self.at, self.state, self.cost = self.at + 1, NEXT[self.state], self.cost + INSERT
        self._put("I", None, ROLE_OF[self.state], "")

    def row(self, turn: int | None, role: str, text: str, truncated: bool) -> None:
        initial = role[:1] or " "
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:                     # turns ascend
            low, high, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != high)]
        while self.audit[self.at] == "I":
            self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            self.cost += DELETE
        else:
            self.state = SYSTEM if letter == "K" and self.state == START and initial == "s" else NEXT[self.state]
            self.cost += (REROLE if letter == "R" else 0) + (TRUNCATED if truncated else 0)
            role = ROLE_OF[self.state] if letter == "R" else role
        self._put(letter, turn, role, text)

    def end(self) -> list[tuple]:
        while self.at < len(self.audit):
            self._insert()
        if self.edits is not None:
            return self.edits
        low, high, n = self.turns
        gaps = high - low + 1 - n if n else 0
        return [(gaps, *self.counts, self.illegal, self.cost, self.audit, self.sha.hexdigest())]

    def take(self) -> list[tuple]:
        """Edits so far (none for a report)."""
        out, self.edits = self.edits or [], [] if self.edits is not None else None
        return out


def _audit_of(rows: list[tuple], known: Transitions) -> tuple[str, tuple[int, int, int]]:
    """Audit and counted faults of a whole conversation: rows of (turn, role, text, copies, blank, truncated)."""
    runs: list[tuple[int, int]] = []
    seen: set[tuple[str, str]] = set()
    blanks = repeats = cut = 0
    for _, role, text, copies, blank, truncated in rows:
        if blank:
            blanks += copies
            add_row(runs, TO_DELETE, copies)
        elif copies:
            new = (role, text) not in seen
            if new:
                seen.add((role, text))
                cut += truncated
                add_row(runs, symbol_of(role, truncated))
            repeats += copies - new
            add_row(runs, TO_DELETE, copies - new)
    letters, state = known.unroll(runs, START, AT_END)
    return letters + closing(state), (blanks, repeats, cut)


class _Sink:
    """Output rows in batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2000, size: int = 8 << 20):
        self.schema, self.rows, self.size, self.held, self.bytes = schema, rows, size, [], 0

    def add(self, key: object, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            self.held.append((key, *row))
            self.bytes += sum(len(v) for v in row if isinstance(v, str))
        if len(self.held) >= self.rows or self.bytes >= self.size:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = zip(*self.held)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema)],
                                             schema=self.schema)
            self.held, self.bytes = [], 0


def _out_schema(key: pa.DataType, edits: bool) -> pa.Schema:
    fields = (EDIT_FIELDS if edits else REPORT_FIELDS).split(", ")
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([pa.field("conv_id", key)] + [pa.field(n, kinds[k]) for n, k in (f.split(" ") for f in fields)])


def _stream(rows: DataFrame, edits: bool) -> DataFrame:
    """Conversations of bounded size: dealt by id, sorted, repaired one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sink, now, held = Transitions(), None, None, []

        def done() -> list[tuple]:
            audit, counts = _audit_of(held, known)
            reader = _Reader(audit, counts, edits)
            for turn, role, text, copies, _, truncated in held:
                for _ in range(copies):
                    reader.row(turn, role, text, truncated)
            return reader.end()

        for batch in batches:
            sink = sink or _Sink(_out_schema(batch.schema.field("conv_id").type, edits))
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and conv != now:
                    yield from sink.add(now, done())
                    held = []
                now = conv
                held.append(row)
        if held:
            yield from sink.add(now, done())
        if sink:
            yield from sink.rest()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER) \
        .select("conv_id", "turn", "role", "text", "copies", "blank", "truncated") \
        .mapInArrow(run, f"conv_id {kind}, " + (EDIT_FIELDS if edits else REPORT_FIELDS))


# ------------------------------------------------------------------ large conversations
BLOCK_SCHEMA = ("key string, part int, seq long, symbols array<int>, lengths array<long>, matrix array<long>, "
                "blank long, duplicate long, truncated long")


def _blocks(rows: DataFrame, path: str, block_rows: int) -> DataFrame:
    """Runs of symbols of consecutive rows, written to ``path``: blocks in the order (part, seq)."""
    same = ["key", "turn", "role", "digest", "blank", "truncated"]
    once = rows.where("copies > 0").groupBy(*same).agg(F.sum("copies").alias("copies"))
    first = once.groupBy("key", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("first"))
    flagged = once.join(first, ["key", "role", "digest"]).select(
        *same, "copies", F.col("turn").eqNullSafe(F.col("first.turn")).alias("new"))
    placed = flagged.repartitionByRange("key", *ORDER).sortWithinPartitions("key", *ORDER) \
        .select("key", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "copies", "new")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, known = TaskContext.get().partitionId(), 0, Transitions()
        now, runs, faults, held = None, [], [0, 0, 0], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "key": pa.array([now]), "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
                "symbols": pa.array([[s for s, _ in runs]], pa.list_(pa.int32())),
                "lengths": pa.array([[n for _, n in runs]], pa.list_(pa.int64())),
                "matrix": pa.array([[c for line in known.matrix(runs) for c in line]], pa.list_(pa.int64())),
                "blank": pa.array([faults[0]], pa.int64()), "duplicate": pa.array([faults[1]], pa.int64()),
                "truncated": pa.array([faults[2]], pa.int64())})

        for batch in batches:
            for key, initial, blank, truncated, copies, new in zip(*[c.to_pylist() for c in batch.columns]):
                if held and key != now:
                    yield block()
                    seq, runs, faults, held = seq + 1, [], [0, 0, 0], 0
                now = key
                kept = int(new and not blank)
                faults[2] += int(kept and truncated)
                todo = [(symbol_of(initial, truncated), 1)] * kept + [(TO_DELETE, copies - kept)]
                for symbol, n in todo:
                    while n:
                        if held == block_rows:
                            yield block()
                            seq, runs, faults, held = seq + 1, [], [0, 0, 0], 0
                        m = min(n, block_rows - held)
                        add_row(runs, symbol, m)
                        faults[0 if blank else 1] += m if symbol == TO_DELETE else 0
                        n, held = n - m, held + m
        if held:
            yield block()

    placed.mapInArrow(cut, BLOCK_SCHEMA).write.parquet(path)
    return rows.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def _costs_behind(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs-to-go behind every block of a conversation, from the blocks' matrices."""
    v, out = list(AT_END), []
    pdf = pdf.sort_values(["part", "seq"], ascending=False)
    for flat in pdf["matrix"]:
        low = min(v)
        out.append([c - low for c in v])
        v = [min(int(flat[4 * i + k]) + v[k] for k in range(4)) for i in range(4)]
    return pdf[["key", "part", "seq"]].assign(behind=out)


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which every block of a conversation begins, and the inserts behind the last one."""
    state, out = START, []
    pdf = pdf.sort_values(["part", "seq"])
    for exits in pdf["exits"]:
        out.append(state)
        state = int(exits[state])
    return pdf[["key", "part", "seq"]].assign(entry=out, tail=[""] * (len(pdf) - 1) + [closing(state)])


def _large(rows: DataFrame, edits: bool, block_rows: int) -> DataFrame:
    """Conversations of any size, by blocks."""
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.to_json(F.struct("conv_id")))
    blocks = _blocks(rows, scratch_path(spark, "turn-blocks"), block_rows)
    at = ["key", "part", "seq"]
    behind = blocks.select(*at, "matrix").groupBy("key").applyInPandas(
        _costs_behind, "key string, part int, seq long, behind array<long>")

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Transitions()
        for batch in batches:
            for i in range(batch.num_rows):      # one block at a time: its audits are as long as its rows
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                ways = [known.unroll(list(zip(row["symbols"], row["lengths"])), s, tuple(row["behind"])) for s in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [one.column(c) for c in (*at, "blank", "duplicate", "truncated")] +
                    [pa.array([[s for _, s in ways]], pa.list_(pa.int32())), pa.array([[a for a, _ in ways]], pa.list_(pa.string()))],
                    names=[*at, "blank", "duplicate", "truncated", "exits", "audits"])

    path = scratch_path(spark, "turn-audits")
    blocks.join(behind, at).select(*blocks.columns, "behind").mapInArrow(
        unrolled, "key string, part int, seq long, blank long, duplicate long, truncated long, exits array<int>, "
                  "audits array<string>").write.parquet(path)
    audits = spark.read.parquet(path)
    entry = audits.select(*at, "exits").groupBy("key").applyInPandas(
        _entries, "key string, part int, seq long, entry int, tail string")
    pieces = audits.join(entry, at).select(
        "key", "part", "seq", F.concat(F.col("audits")[F.col("entry")], "tail").alias("piece"),
        F.struct("blank", "duplicate", "truncated").alias("faults"))
    nothing = F.lit(None)
    both = pieces.select("key", F.lit(0).alias("kind"), "part", "seq", "piece", "faults", nothing.cast(rows.schema["conv_id"].dataType).alias("conv_id"),
                         nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("digest"),
                         nothing.cast("string").alias("text"), nothing.cast("long").alias("copies"), nothing.cast("boolean").alias("cut")) \
        .unionByName(rows.select("key", F.lit(1).alias("kind"), nothing.cast("int").alias("part"), nothing.cast("long").alias("seq"),
                                 nothing.cast("string").alias("piece"), nothing.cast(pieces.schema["faults"].dataType).alias("faults"),
                                 "conv_id", "turn", "role", "digest", "text", "copies", F.col("truncated").alias("cut")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = now = reader = conv_now = None
        audit, faults = [], [0, 0, 0]
        for batch in batches:
            sink = sink or _Sink(_out_schema(batch.schema.field("conv_id").type, edits))
            for key, piece, fault, conv, turn, role, text, copies, truncated in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    if now is not None:
                        yield from sink.add(conv_now, reader.end())
                    now, reader, audit, faults = key, None, [], [0, 0, 0]
                if piece is not None:
                    audit.append(piece)
                    faults = [a + fault[f] for a, f in zip(faults, ("blank", "duplicate", "truncated"))]
                    continue
                conv_now = conv
                reader = reader or _Reader("".join(audit), tuple(faults), edits)
                for _ in range(copies):
                    reader.row(turn, role, text, truncated)
                    if edits:
                        yield from sink.add(conv_now, reader.take())
        if now is not None:
            yield from sink.add(conv_now, reader.end())
        if sink:
            yield from sink.rest()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return both.repartition("key").sortWithinPartitions("key", "kind", "part", "seq", *ORDER) \
        .select("key", "piece", "faults", "conv_id", "turn", "role", "text", "copies", "cut") \
        .mapInArrow(read, f"conv_id {kind}, " + (EDIT_FIELDS if edits else REPORT_FIELDS))


def _repaired(rows: DataFrame, edits: bool, hot_rows: int, block_rows: int) -> DataFrame:
    rows = _marked(prepared(rows))
    hot = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > hot_rows) \
        .select(F.col("conv_id").alias("hot_id")).checkpoint(eager=True)   # at most rows / hot_rows ids
    if hot.isEmpty():
        return _stream(rows, edits)
    same = rows["conv_id"].eqNullSafe(hot["hot_id"])
    return _stream(rows.join(hot, same, "left_anti"), edits) \
        .unionByName(_large(rows.join(hot, same, "left_semi"), edits, block_rows))


def repair(rows: DataFrame, *, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edits that repair every conversation, one row per edit: conv_id, position (from 1), edit (K, R, D or I),
    turn (null for inserts), role and text (those of the repaired row; of the deleted one for D).

    Input: conv_id, turn, role, text and, if there, ``copies`` (how often a row stands
    there; 0 names the conversation only).  Null roles and texts are one space; null
    turns come first and null ids are one conversation.  Rows of one turn are in the
    order of role and text digest.  An empty role is no initial of the grammar.  Repeated
    rows are duplicates of the first one.  An empty table gives no rows; other columns
    are ignored.  In conversations above ``hot_rows`` texts count as equal by SHA-256.
    """
    return _repaired(rows, True, hot_rows, block_rows)


def report(rows: DataFrame, *, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal (numbers of faults before the
    repair), cost, audit and repaired_sha256 (of ``role:text`` lines).  Odd rows as in ``repair``; a conversation of
    which no row is there has zeros, an empty audit and the hash of an empty text."""
    return _repaired(rows, False, hot_rows, block_rows)
