"""Repair of conversations at least cost: which turns to keep, rename, delete or insert so that roles alternate.

Every choice of edits has one weight, an integer: its high digits are the cost, its low digits, of a fixed number, spell the edits in
order, one digit a letter, with zeros at the end.  The least weight is then the cheapest choice and, of several, the one whose
letters come first; a plain minimum over integers on an acyclic graph of (row, state) decides everything.

A conversation may be far longer than a task should hold, so rows are dealt out by ranges of (conversation, turn) and cut
into pieces.  A piece gives the least weight from every state to every state.  Inserted rows stand in front of the row
that follows them, so the letters of a piece end with its last row, and no two different strings of one piece begin alike:
pieces can be compared by themselves and joined from the end to the front by cost alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from ..session import cut_lineage
from .common import small_batches

PIECE_ROWS = 256  # rows whose weights are found together
BITS = 3  # bits of a digit
LETTERS = "DIKR"  # in their order as text; digit 0 is the end of the string
RENAME, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
MOST_INSERTS = 3  # inserted rows in a row; the cheapest choice never has more than two

# states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
DONE = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def _keeps(state: int, initial: str) -> int | None:
    """State after a kept row, if the row may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    due = DUE[state]
    return due if initial == NAMES[due][0] else None


def _moves(state: int, initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(next state, cost, digits, number of digits) of every way past one row; fault is `d` (must go), `t` (cut short) or `k`."""
    out, code, here = [], 0, state
    for inserts in range(MOST_INSERTS + 1):
        extra = CUT_SHORT if fault == "t" else 0
        ways = [("D", here, DELETE)]
        if fault != "d":
            ways.append(("R", DUE[here], RENAME + extra))
            if _keeps(here, initial) is not None:
                ways.append(("K", _keeps(here, initial), extra))
        out += [(to, inserts * INSERT + cost, (code << BITS) + LETTERS.index(x) + 1, inserts + 1) for x, to, cost in ways]
        code, here = (code << BITS) + LETTERS.index("I") + 1, DUE[here]
    return out


MOVES = {(s, i, f): _moves(s, i, f) for s in range(4) for i in "suax" for f in "dtk"}


def digits(rows: int) -> int:
    """Digits that spell any choice of edits for so many rows."""
    return rows * (MOST_INSERTS + 1)


def weights(rows: str) -> list[list[int | None]]:
    """[state before][state after]: the least weight of all choices for a piece; two characters a row, initial and fault."""
    count = len(rows) // 2
    low = BITS * digits(count)
    mask = (1 << low) - 1
    table = [[0 if s == t else None for t in range(4)] for s in range(4)]
    for i in range(count - 1, -1, -1):
        before = []
        for state in range(4):
            best: list[int | None] = [None] * 4
            for to, cost, code, m in MOVES[state, rows[2 * i], rows[2 * i + 1]]:
                shifted = (cost << low) + (code << (low - BITS * m))
                for t, rest in enumerate(table[to]):
                    if rest is not None:
                        w = shifted + (rest >> low << low) + ((rest & mask) >> BITS * m)
                        if best[t] is None or w < best[t]:
                            best[t] = w
            before.append(best)
        table = before
    return table


def spell(weight: int, rows: int) -> str:
    """The letters in the low digits of a weight."""
    out, shift = [], BITS * digits(rows)
    while shift:
        shift -= BITS
        digit = (weight >> shift) & ((1 << BITS) - 1)
        if not digit:
            break
        out.append(LETTERS[digit - 1])
    return "".join(out)


def ending() -> list[tuple[int, str]]:
    """Cost and letters of the inserted rows that finish a conversation, by state."""
    out = []
    for state in range(4):
        n = 0
        while state not in DONE:
            state, n = DUE[state], n + 1
        out.append((n * INSERT, "I" * n))
    return out


def packed_weights(rows: str) -> list[bytes | None]:
    return [None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "big") for line in weights(rows) for w in line]


class Ending:
    """Joins the pieces of one conversation from the last to the first."""

    def __init__(self) -> None:
        self.to_go = [cost for cost, _ in ending()]
        self.choice: list[list[tuple[int, str]]] = []  # by piece, from the last, and state: next state, letters

    def add(self, packed: list[bytes | None], rows: int) -> None:
        low = BITS * digits(rows)
        to_go, choice = [], []
        for s in range(4):
            ways = [((self.to_go[t] << low) + int.from_bytes(w, "big"), t) for t in range(4) if (w := packed[4 * s + t]) is not None]
            weight, t = min(ways)
            to_go.append(weight >> low)
            choice.append((t, spell(weight, rows)))
        self.to_go = to_go
        self.choice.append(choice)

    def result(self) -> tuple[int, str]:
        state, letters = START, []
        for choice in reversed(self.choice):
            state, text = choice[state]
            letters.append(text)
        return self.to_go[START], "".join(letters) + ending()[state][1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _pieces(schema: pa.Schema):
    """Function over sorted rows (conversation, turn, initial, blank, short, later, times): pieces with weights and counts."""

    def expanded(batches):
        for conv, turn, initial, blank, short, later, times in _rows(batches):
            for k in range(times):
                repeats = later or k > 0
                fault = "blank" if blank else "duplicate" if repeats else "truncated" if short else ""
                yield conv, turn, initial, fault

    def cut(batches):
        part, number, here, held = TaskContext.get().partitionId(), 0, None, []
        known_pieces: dict[str, list[bytes | None]] = {}  # short pieces look alike

        def piece():
            turns = [t for _, t, _, _ in held]
            known = [t for t in turns if t is not None]
            faults = [f for _, _, _, f in held]
            initials = [i for _, _, i, _ in held]
            kinds = {"blank": "d", "duplicate": "d", "truncated": "t", "": "k"}
            rows = "".join((i if i in ("s", "u", "a") else "x") + kinds[f] for _, _, i, f in held)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            packed = known_pieces.get(rows) or packed_weights(rows)
            if len(rows) <= 40 and len(known_pieces) < 50_000:
                known_pieces[rows] = packed
            return (here, part, number, len(held), faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal,
                    min(known, default=None), max(known, default=None), len(set(known)), initials[0], initials[-1], packed)

        for row in expanded(batches):
            if held and (row[0] != here or len(held) == PIECE_ROWS):
                yield piece()
                held, number = [], number + 1
            here = row[0]
            held.append(row)
        if held:
            yield piece()

    return lambda batches: _emit(cut(batches), schema)


def _joined(schema: pa.Schema):
    """Function over pieces sorted by conversation, the last piece first: one row for each conversation."""

    def join(batches):
        here, end, sums, after = None, None, None, None

        def row():
            cost, letters = end.result()
            low, high = sums["low"], sums["high"]
            gaps = 0 if low is None else high - low + 1 - sums["distinct"]
            return here, gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, letters

        for conv, _, _, n, blank, duplicate, truncated, illegal, low, high, distinct, first, last, packed in _rows(batches):
            if end is None or conv != here:
                if end is not None:
                    yield row()
                here, end, after = conv, Ending(), None
                sums = dict(blank=0, duplicate=0, truncated=0, illegal=0, low=None, high=None, distinct=0)
            for name, value in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal), ("distinct", distinct)):
                sums[name] += value
            if after is not None:
                sums["illegal"] += last + after not in ("su", "ua", "au")
            # a turn that goes on in the next piece has been counted there
            sums["distinct"] -= high is not None and high == sums["low"]
            sums["high"] = high if sums["high"] is None else sums["high"]
            sums["low"] = low if low is not None else sums["low"]
            after = first
            end.add(packed, n)
        if end is not None:
            yield row()

    return lambda batches: _emit(join(batches), schema)


def _applied(schema: pa.Schema):
    """Function over one line with the edits, then the rows of each conversation in order: a digest of the repaired rows."""

    def apply(batches):
        here, digest, letters, at, state, lines, open_ = None, None, "", 0, START, 0, False

        def say(role, text):
            nonlocal lines
            digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1

        def inserts():
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                state, at = DUE[state], at + 1
                say(NAMES[state], "")

        for conv, edits, role, text in _rows(batches):
            if edits is not None:
                if open_:
                    inserts()
                    yield here, digest.hexdigest()
                here, digest, letters, at, state, lines, open_ = conv, hashlib.sha256(), edits, 0, START, 0, True
                continue
            inserts()
            letter, at = letters[at], at + 1
            if letter == "R":
                state = DUE[state]
                say(NAMES[state], text)
            elif letter == "K":
                state = _keeps(state, role[:1])
                say(role, text)
        if open_:
            inserts()
            yield here, digest.hexdigest()

    return lambda batches: _emit(apply(batches), schema)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults planted by the checksum of `conversation:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it a user's.  Nulls count as one space,
    except that conversation and turn stay null in the rows.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), space), F.lit(":"), F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(f"`{text}`"), space)
    out = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(f"`{role}`"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))
    return out.where("times > 0").withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times")


def _line() -> Column:
    return F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))


def repair(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation in `rows` (conv, turn, role, text).

    Rows are taken by turn, nulls first; rows with one turn by role and then by a digest of role and text.  A row's first fault
    counts: blank (no text but white space), duplicate (role and text seen earlier in its conversation), truncated (does not end
    in `.!?`).  Keeping costs 0, renaming to user or assistant 3, deleting 4, inserting an empty row 3, a row left truncated 3
    more; blank and duplicate rows must go.  The result has roles that alternate user, assistant, perhaps after a system turn, or
    no rows.  `audit` spells the edits K, R, D, I; of equally cheap ones the first as text.  A null conversation is a conversation,
    a null role or text is one space.  Columns besides the four are not looked at; an empty table gives an empty table.

    No task holds the rows of a conversation: one that is very long is cut into pieces of 256 rows over many tasks.  Its audit, a
    single value, and the digest of its rows, which can only be made in order, are made by one task that holds about four bytes a row.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    short = own.select(
        "conv", "turn", "role", _line().alias("line"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("short"))
    # equal rows of one turn travel once, with their number
    counted = short.groupBy("conv", "turn", "role", "line").agg(
        F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("short").alias("short"), F.count("*").alias("times"))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    repeated = counted.groupBy(F.col("conv").alias("c"), F.col("line").alias("l")).agg(F.min(when).alias("front"), F.count("*").alias("k")).where("k > 1")
    flagged = counted.join(repeated, F.col("conv").eqNullSafe(F.col("c")) & (F.col("line") == F.col("l")), "left")
    flagged = flagged.select("conv", "turn", "role", "line", "initial", "blank", "short", F.coalesce(when > F.col("front"), F.lit(False)).alias("later"), "times")
    ordered = flagged.repartitionByRange("conv", "turn", "role", "line").sortWithinPartitions("conv", "turn", "role", "line")
    kinds = {f.name: f.dataType for f in own.schema.fields}
    piece = StructType().add("conv", kinds["conv"]).add("part", "integer").add("number", "long")
    for name in ("n", "blank", "duplicate", "truncated", "illegal"):
        piece = piece.add(name, "long")
    piece = (piece.add("low", kinds["turn"]).add("high", kinds["turn"]).add("distinct", "long").add("first", "string").add("last", "string")
             .add("weights", ArrayType(BinaryType())))
    narrow = ordered.select("conv", "turn", "initial", "blank", "short", "later", "times")
    pieces = cut_lineage(narrow.mapInArrow(_pieces(_arrow(piece)), piece))

    found = StructType().add("conv", kinds["conv"])
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        found = found.add(name, "long")
    found = found.add("audit", "string")
    backward = pieces.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("number"))
    repaired = cut_lineage(backward.mapInArrow(_joined(_arrow(found)), found))

    heads = repaired.select("conv", F.lit(0).alias("kind"), "audit", F.lit(None).cast(kinds["turn"]).alias("turn"),
                            F.lit("").alias("role"), F.lit(b"").alias("line"), F.lit("").alias("text"))
    body = own.select("conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", _line().alias("line"), "text")
    lined = heads.union(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "line")
    last = StructType().add("c", kinds["conv"]).add("repaired_sha256", "string")
    digests = lined.select("conv", "audit", "role", "text").mapInArrow(_applied(_arrow(last)), last)
    return repaired.join(digests, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair_damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`damaged` rows repaired, with a row for every conversation of `rows`: one that lost all its rows has zeros and empty strings."""
    fixed = repair(damaged(rows, conv, turn, role, text)).withColumnRenamed("conv", "c")
    every = rows.select(F.col(f"`{conv}`").alias(conv)).distinct()
    out = every.join(fixed, every[conv].eqNullSafe(fixed["c"]), "left").drop("c")
    zero = {n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {
        "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
