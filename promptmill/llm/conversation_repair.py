"""Repair of conversation structure by an integer-minimum path over a graph of edits.

A conversation is legal when the initials of its roles read `(s?(ua)+)?`. Nodes of the graph are places between
rows together with a state of that pattern; edges are edits. The weight of a path is one whole number: its high
digits hold the cost, its low digits the letters of the edits, the first one highest, a fixed number of them, with zeros after the
last. The smallest number is thus the cheapest repair, of those the one with the least letters.

Long conversations are solved in runs of RUN rows from the end: a run needs only what the rest costs from each state. Two different
ways through a run that are equally cheap differ in a letter of the run, since each of them ends with the letter of its last row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.sources.storage import materialize

# White space, cost of each edit, and what a truncated row adds when it stays.
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Rows that are solved together; it bounds the digits of a weight.
RUN = 512

# Letters of edits in ASCII order; a digit of three bits is the place in this list from 1, and 0 ends.
LETTERS = " DIKR"
_BITS = 3
_D, _I, _K, _R = 1, 2, 3, 4

# States: nothing yet, after a system row, after a user row, after an assistant row.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}
_TURN = (2, 2, 3, 2)  # where an inserted or re-roled row leads; state 2 wants the assistant
_NEVER = 1 << 60

# A row as one byte: its initial as place in "?sua", plus 4 if truncated; 8 for a row that must go.
_INITIALS = "?sua"
MUST_GO = 8


def damage(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` with faults planted by crc32(`conv_id:turn`) modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes it the user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    damaged = rows.where("fault != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )
    return damaged.drop("copy")


def _symbol(role: Column, text: Column) -> Column:
    """The byte of a row before repeats are known."""
    ended = F.rtrim(text, F.lit(SPACE))
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    open_end = F.when(F.right(ended, F.lit(1)).isin(".", "!", "?"), 0).otherwise(4)
    return place + F.when(ended == "", F.lit(MUST_GO)).otherwise(open_end)


def _weights(symbol: int) -> list[list[tuple[int, int, int]]]:
    """Edits of a row for each state: cost, letter, next state."""
    out = []
    extra = TRUNCATED if symbol & 4 else 0
    for state in range(4):
        edits = [(DELETE, _D, state)]
        if symbol < MUST_GO:
            edits.append((REROLE + extra, _R, _TURN[state]))
            if state in (keep := _NEXT[_INITIALS[symbol & 3]]):
                edits.append((extra, _K, keep[state]))
        out.append(edits)
    return out


_EDITS = {symbol: _weights(symbol) for symbol in range(12)}


def _run(symbols: bytes, rest: list[int] | None) -> tuple[list[int], int]:
    """The least weight from each state at the start of a run of rows to its end, and the number of low bits.

    `rest` has the cost of what follows, by state; None at the end of the conversation.
    """
    low = _BITS * (2 * len(symbols) + 4)
    first, mask = low - _BITS, (1 << low) - 1

    def prepend(cost: int, letter: int, weight: int) -> int:
        return ((cost + (weight >> low)) << low) | (letter << first) | ((weight & mask) >> _BITS)

    def insert(at: list[int]) -> list[int]:
        # of two inserted rows the second leads on from where the first one led
        once = [prepend(INSERT, _I, at[_TURN[s]]) for s in range(4)]
        twice = [prepend(INSERT, _I, once[_TURN[s]]) for s in range(4)]
        return [min(at[s], once[s], twice[s]) for s in range(4)]

    if rest is None:
        best = insert([0, _NEVER << low, _NEVER << low, 0])
    else:
        best = [cost << low for cost in rest]
    for symbol in reversed(symbols):
        edits = _EDITS[symbol]
        best = insert([min(prepend(c, letter, best[to]) for c, letter, to in edits[s]) for s in range(4)])
    return best, low


def solve(symbols: bytes, run: int = RUN) -> tuple[int, str]:
    """Cost and letters of the best repair of the rows of a conversation."""
    cuts = list(range(0, len(symbols), run)) or [0]
    solved, rest = [], None
    for lo in reversed(cuts):
        best, low = _run(symbols[lo : lo + run], rest)
        solved.append((lo, best, low))
        rest = [w >> low for w in best]
    state, audit = 0, []
    for lo, best, low in reversed(solved):
        letters = best[state] & ((1 << low) - 1)
        row = lo
        for shift in range(low - _BITS, -1, -_BITS):
            letter = letters >> shift & 7
            if not letter:
                break
            audit.append(LETTERS[letter])
            if letter == _I:
                state = _TURN[state]
            else:
                state = {e[1]: e[2] for e in _EDITS[symbols[row]][state]}[letter]
                row += 1
    return rest[0], "".join(audit)


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True


def _stats(symbols: np.ndarray, turns: tuple[int, int, int]) -> tuple:
    """`symbols` of one conversation in order, 16 added to those of repeats; least and largest turn and number of turns."""
    least, most, several = turns
    repeated = symbols >= 16
    initials = symbols & 3
    symbols = np.where(repeated, MUST_GO + initials, symbols)
    gone = symbols >= MUST_GO
    illegal = int(np.count_nonzero(~_LEGAL[initials[:-1], initials[1:]])) if len(initials) > 1 else 0
    cost, audit = solve(symbols.astype(np.uint8).tobytes())
    gaps = most - least + 1 - several if several else 0
    return (
        gaps, int(np.count_nonzero(gone & ~repeated)), int(np.count_nonzero(repeated)),
        int(np.count_nonzero(~gone & (symbols & 4 > 0))), illegal, cost, audit,
    )


def _runs(batches: Iterator[pa.RecordBatch], column: str = "conv_id") -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """Parts of sorted batches that hold one conversation each, and whether it is a new one."""
    last, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(column).dictionary_encode(null_encoding="encode")
        at = codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            conv = codes.dictionary[int(at[lo])].as_py()
            yield conv, not begun or conv != last, batch.slice(lo, hi - lo)
            last, begun = conv, True


def _solved(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _STATS.split(", ")]
    convs: list = []
    rows: list[tuple] = []
    parts: list[np.ndarray] = []
    turns: list = [None, None, 0]

    def finish():
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        rows.append(_stats(symbols, tuple(turns)))

    def flush():
        columns = [pa.array(convs[: len(rows)], conv_type), *(pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*rows)))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

    size = 0
    for conv, new, part in _runs(batches):
        if new:
            if convs:
                finish()
                size += len(rows[-1][-1])
                if len(rows) >= 10_000 or size > 1 << 22:
                    yield flush()
                    convs, rows, size = [], [], 0
            convs.append(conv)
            parts, turns = [], [None, None, 0]
        n = part.column("n").to_numpy()
        symbol = part.column("symbol").to_numpy().astype(np.uint8)
        first = ~part.column("repeat").to_numpy(zero_copy_only=False)
        # of equal rows one is the first, unless the same words came in an earlier turn
        which = np.repeat(np.arange(len(n)), n)
        leading = np.ones(len(which), bool)
        leading[1:] = which[1:] != which[:-1]
        words = symbol[which] < MUST_GO
        parts.append(np.where(words & ~(leading & first[which]), 16 + (symbol[which] & 3), symbol[which]).astype(np.uint8))
        seen = part.column("turn").filter(pc.greater(part.column("n"), 0)).drop_null()
        if len(seen):
            values = seen.to_numpy()
            several = 1 + int(np.count_nonzero(values[1:] != values[:-1]))
            turns = [values[0].item() if turns[0] is None else turns[0], values[-1].item(), turns[2] + several - (turns[1] == values[0])]
    if convs:
        finish()
        yield flush()


def solve_all(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """`conv_id`, counts of faults, cost and audit of each conversation; only digests of texts are moved."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    keys = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), _symbol(role, text).alias("symbol")
    )
    # rows equal in all are one row with their number, counted before the shuffle
    counted = materialize(keys.groupBy("conv_id", "turn", "role", "digest", "symbol").agg(F.count(F.lit(1)).alias("n")), "turns")
    first = counted.where(F.col("symbol") < MUST_GO).groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")
    )
    # few words come again in another turn; both sides are plain tables, in which Spark splits a large group
    again = materialize(first.where("turns > 1"), "repeats").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    repeat = F.col("c").isNotNull() | F.col("r").isNotNull()
    marked = counted.join(again, same, "left").select(
        "conv_id", "turn", "role", "digest", "symbol", "n",
        (repeat & ~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("repeat"),
    )
    if ids is not None:
        none = ids.select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).alias("symbol"),
            F.lit(0).cast("long").alias("n"), F.lit(False).alias("repeat"),
        )
        marked = marked.unionByName(none)
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    kind = dict(rows.dtypes)["conv_id"]
    return ordered.mapInArrow(lambda b: _solved(b, _arrow_type(kind)), f"conv_id {kind}, {_STATS}")


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


_INSERTED = {2: "user", 3: "assistant"}


class _Edits:
    """Walks along the rows of one conversation with its letters; gives repaired rows as (role, edit, row or None)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _TURN[self.state]
            yield _INSERTED[self.state], "I"

    def row(self, role: str) -> tuple[str, str] | None:
        """The role under which the next row stays, and its edit; None if it goes."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return None
        self.state = _TURN[self.state] if letter == "R" else _NEXT[role[:1]][self.state]
        return (_INSERTED[self.state] if letter == "R" else role), letter


def _with_audits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows in order behind a row of their conversation's results; a conversation is read as a stream."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    stats = [c for c in solved.columns if c != "conv_id"]
    nothing = [F.lit(None).cast(solved.schema[c].dataType).alias(c) for c in stats]
    blank = F.lit(None).cast("string")
    head = solved.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), blank.alias("role"), blank.alias("digest"), blank.alias("text"), *stats
    )
    body = rows.select(
        "conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"), *nothing
    )
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of each conversation with the hash of its repaired rows; holds one row at a time."""
    out: list[tuple] = []
    current = None

    def finish(head, edits, digest, lines):
        for role, _ in edits.inserted():
            digest.update((b"\n" if lines else b"") + role.encode() + b":")
            lines += 1
        return (*head, digest.hexdigest())

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    stats = [f.name for f in schema][1:-1]
    for conv, new, part in _runs(batches):
        if new:
            if current is not None:
                out.append(finish(*current))
                if len(out) >= 10_000:
                    yield flush()
                    out = []
            head = (conv, *(part.column(c)[0].as_py() for c in stats))
            current = [head, _Edits(head[1 + stats.index("audit")]), hashlib.sha256(), 0]
            part = part.slice(1)
        edits, digest = current[1], current[2]
        for role, text in zip(part.column("role"), part.column("text")):
            role = role.as_py()
            lines = [f"{made}:" for made, _ in edits.inserted()]
            stays = edits.row(role)
            if stays:
                lines.append(f"{stays[0]}:{text.as_py()}")
            for line in lines:
                digest.update((b"\n" if current[3] else b"") + line.encode())
                current[3] += 1
    if current is not None:
        out.append(finish(*current))
    if out:
        yield flush()


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation; reads `conv_id, turn, role, text`, and `conv_id` of `ids`.

    Returns `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`. Rows come in order of turn, nulls
    first; rows of one turn in order of role, then of the SHA-256 of their text. A null role or text counts as one
    space, null conv_ids are one conversation. A role without initial is never legal. Rows that repeat turn, role and text are
    duplicates of the first of them. Conversations that only `ids` has get zeros, an empty audit and the hash of nothing.
    Other columns are not read. An empty table gives no rows.

    The letters of a conversation, a byte for each row, are in one task, as they are one cell of the result; its texts pass through one
    task as a stream, since a hash of the whole has no parts.
    """
    solved = materialize(solve_all(rows, ids), "repairs")
    kind = dict(rows.dtypes)["conv_id"]
    fields = [("conv_id", _arrow_type(kind))]
    fields += [(c, pa.string() if c == "audit" else pa.int64()) for c in solved.columns if c != "conv_id"]
    schema = pa.schema([*fields, ("repaired_sha256", pa.string())])
    return _with_audits(rows, solved).mapInArrow(lambda b: _hashed(b, schema), f"conv_id {kind}, {_STATS}, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """`conv_id, place, turn, role, text, edit` of every row of the repaired conversations, places from 0.

    Inserted rows have a null turn and an empty text. Nulls, ties and empty tables as for `repair`.
    """
    kind = dict(rows.dtypes)["conv_id"]
    schema = pa.schema(
        [("conv_id", _arrow_type(kind)), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        edits, place, owner = None, 0, None

        def put(turn, role, text, edit):
            nonlocal place
            out.append((owner, place, turn, role, text, edit))
            place += 1

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for conv, new, part in _runs(batches):
            if new:
                if edits is not None:
                    for role, edit in edits.inserted():
                        put(None, role, "", edit)
                edits, place, owner = _Edits(part.column("audit")[0].as_py()), 0, conv
                part = part.slice(1)
            for turn, role, text in zip(part.column("turn"), part.column("role"), part.column("text")):
                for made, edit in edits.inserted():
                    put(None, made, "", edit)
                stays = edits.row(role.as_py())
                if stays:
                    put(turn.as_py(), stays[0], text.as_py(), stays[1])
                if len(out) >= 10_000:
                    yield flush()
                    out = []
        if edits is not None:
            for role, edit in edits.inserted():
                put(None, role, "", edit)
        if out:
            yield flush()

    solved = materialize(solve_all(rows), "repairs")
    return _with_audits(rows, solved).mapInArrow(run, f"conv_id {kind}, place long, turn long, role string, text string, edit string")
