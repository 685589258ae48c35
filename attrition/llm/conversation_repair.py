"""Conversation structure repair by a checkpointed shortest-edit programme.

A conversation is its rows by turn (nulls first; equal turns by role, then by the
text's SHA-256, so copies of a row are neighbours).  It is repaired into a sequence
whose role initials are ``(s?(ua)+)?`` by the cheapest edits: keep (K, 0), rerole to
user or assistant (R, 3), delete (D, 4), insert an empty turn (I, 3); blank rows and
rows whose role and text came earlier must be deleted, truncated rows that stay add 3.
Of the cheapest edit sequences the one whose letters are ASCII-least is taken.

The cost of finishing from a row depends on the row and one of four states: nothing
yet, after the system turn, after a user turn, after an assistant turn.  The vectors
of these costs are computed backwards but kept only at checkpoints, one for about
every square root of a conversation's rows; the blocks between are recomputed from
their checkpoint when the edits are read off forwards.  A block is one row of a table:

1. each block's costs from state to state, a 4 × 4 matrix, on its own;
2. the matrices of a conversation, combined backwards: the vectors at checkpoints;
3. each block again, from its checkpoint: the state it is left in, for each state it
   can be entered in; these maps, combined forwards, give the state it is entered in;
4. each block again, from its checkpoint and entry state: the edits.

So no task holds more than a block's rows or a conversation's checkpoints, and one
conversation with a third of all rows spreads over many tasks.  Rows that are copies
of each other are counted before they are moved.  All this runs without the texts;
they meet their edits once, in conversation order, as a stream through the task that
writes a conversation's rows.

Defined results: null roles and texts are one space; a null conversation id is an id
like any other; null turns come first and count in no gap; repeated rows are
duplicates of each other; empty tables give empty results; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attrition.llm.common import arrow_map, stored

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
#: A block has at least 2 ** LEAST_SHIFT places.
LEAST_SHIFT = 5

#: Rows that a task solves.
TASK_UNITS = 1 << 15

#: For each state: the initial that may follow and the state after it; ``s`` may come first only.
EXPECTED = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
#: Cost of finishing when all rows are done.
FINISH = (0, 2 * INSERT, INSERT, 0)
NAMES = {"u": "user", "a": "assistant"}
OPEN, CUT, GONE = 0, 1, 2
_FAR = 1 << 60

Unit = tuple[str, int, int]


class Repair(NamedTuple):
    """``rows``: (conv, place, edit, turn, role, text), every row and inserted turn in
    order, deleted ones with edit D, a conversation's rows next to each other in one
    partition.  ``summary``: one row per conversation of the input."""

    rows: DataFrame
    summary: DataFrame


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with the faults that crc32 of ``conv:turn`` modulo 20
    chooses: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it,
    4 makes it the user's.  Nulls are read as one space."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")), F.lit(20))
    kept = rows.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), shown(role).alias(role), shown(text).alias(text),
                       fault.alias("fault")).where("fault <> 0")
    new_text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    return kept.select(conv, turn, F.when(F.col("fault") == 4, "user").otherwise(F.col(role)).alias(role), new_text.alias(text),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _texts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("r"),
                       t.alias("x"), F.unhex(F.sha2(t, 256)).alias("d"))


def _units(texts: DataFrame) -> DataFrame:
    """One row for all copies of a row (c, t, r, d), with their number n, whether the
    text is blank or cut, whether role and text came at an earlier turn (again), and
    a number ``at`` that follows the order of the conversation."""
    bare = F.rtrim(F.col("x"), F.lit(BLANK))
    units = texts.select("c", "t", "r", "d", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")).groupBy(
        "c", "t", "r", "d", "blank", "cut").agg(F.count("*").alias("n"))
    turns = F.struct(F.col("t").isNotNull().alias("has"), F.col("t").alias("t"))
    first = units.groupBy(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("d").alias("fd")).agg(
        F.min(turns).alias("f"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    marked = units.join(first, F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("d") == F.col("fd")), "left").select(
        *units.columns, (F.col("fr").isNotNull() & ~F.col("f.t").eqNullSafe(F.col("t"))).alias("again"))
    order = ["c", "t", "r", "d"]
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("at", F.monotonically_increasing_id()), "repair-units")


def _blocks(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks (conv, block, units) and each conversation's counts; ``conv`` is the
    first place of a conversation."""
    other = F.when(F.col("blank"), 0)
    doubles = other.when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)
    cut = F.when(F.col("blank") | F.col("again"), 0).otherwise(F.col("cut").cast("int"))
    gaps = F.coalesce(F.max("t") - F.min("t") + 1 - F.count_distinct("t"), F.lit(0))
    totals = units.groupBy("c").agg(
        F.min("at").alias("conv"), F.count("*").alias("size"), gaps.cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(doubles).alias("duplicate"), F.sum(cut).cast("long").alias("truncated"))
    totals = stored(totals, "repair-totals")
    shift = F.greatest(F.lit(LEAST_SHIFT), F.ceil(F.log2("size") / 2).cast("int"))
    kind = F.when(F.col("blank") | F.col("again"), GONE).when(F.col("cut"), CUT).otherwise(OPEN)
    named = units.join(totals.select(F.col("c").alias("tc"), "conv", shift.alias("shift")), F.col("c").eqNullSafe(F.col("tc")))
    unit = F.struct("at", F.substring("r", 1, 1).alias("initial"), kind.alias("kind"), "n")
    # by rows: a block's units are few bytes and much work
    named = named.withColumn("block", F.expr("shiftright(at, shift)")).repartition(_tasks(units), "conv", "block")
    blocks = named.groupBy("conv", "block").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    return stored(blocks, "repair-blocks"), totals


def _tasks(units: DataFrame) -> int:
    return units.count() // TASK_UNITS + 1


def back(later: list[int], unit: Unit) -> list[int]:
    """Costs of finishing from each state before a unit, from those after it."""
    initial, kind, n = unit
    after = [x + DELETE * (n - 1) for x in later]
    if kind == GONE:
        return [x + DELETE for x in after]
    more = TRUNCATED if kind == CUT else 0
    now = []
    for state in range(4):
        best = min(DELETE + after[state], REROLE + more + after[AFTER[state]])
        if initial == EXPECTED[state]:
            best = min(best, more + after[AFTER[state]])
        if initial == "s" and state == 0:
            best = min(best, more + after[1])
        now.append(best)
    now[2], now[3] = min(now[2], INSERT + now[3]), min(now[3], INSERT + now[2])
    now[0], now[1] = min(now[0], INSERT + now[2]), min(now[1], INSERT + now[2])
    return now


def forward(units: list[Unit], end: list[int], state: int) -> tuple[list[tuple[str, str, str]], int]:
    """For each unit the initials inserted before it, the edit of its first row and the
    initial that a reroled row gets, by the ASCII-least tight edits from ``state``; and
    the state after the last."""
    vectors = [end]
    for u in reversed(units):
        vectors.append(back(vectors[-1], u))
    vectors.reverse()
    out = []
    for (initial, kind, n), now, later in zip(units, vectors, vectors[1:]):
        after = [x + DELETE * (n - 1) for x in later]
        more = TRUNCATED if kind == CUT else 0
        inserted, to = "", ""
        while now[state] != DELETE + after[state] and now[state] == INSERT + now[AFTER[state]]:
            inserted += EXPECTED[state]
            state = AFTER[state]
        if now[state] == DELETE + after[state]:
            edit = "D"
        elif state == 0 and initial == "s" and now[state] == more + after[1]:
            edit, state = "K", 1
        elif initial == EXPECTED[state] and now[state] == more + after[AFTER[state]]:
            edit, state = "K", AFTER[state]
        else:
            edit, to, state = "R", EXPECTED[state], AFTER[state]
        out.append((inserted, edit, to))
    return out, state


def _rows_of(run: Callable[[dict], dict | None], schema: pa.Schema) -> Callable:
    """An Arrow function that turns each row into one row or none."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x for x in map(run, batch.to_pylist()) if x is not None]
            yield pa.RecordBatch.from_pylist(made, schema=schema)
    return go


def _of_units(row: dict) -> list[Unit]:
    return [(u["initial"], u["kind"], u["n"]) for u in row["units"]]


_LONGS = pa.list_(pa.int64())


def _matrices(blocks: DataFrame) -> DataFrame:
    """Each block's costs from state to state (row by row), and what counting
    neighbours of the wrong kind needs."""
    def run(row: dict) -> dict:
        units = _of_units(row)
        columns = []
        for state in range(4):
            v = [_FAR] * 4
            v[state] = 0
            for u in reversed(units):
                v = [min(x, _FAR) for x in back(v, u)]
            columns.append(v)
        initials = [u[0] for u in units]
        wrong = sum(u[2] - 1 for u in units) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return {"conv": row["conv"], "block": row["block"], "costs": [c[s] for s in range(4) for c in columns],
                "first": initials[0], "last": initials[-1], "wrong": wrong}

    schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("costs", _LONGS), ("first", pa.string()), ("last", pa.string()), ("wrong", pa.int64())])
    return arrow_map(blocks, _rows_of(run, schema), "conv bigint, block bigint, costs array<bigint>, first string, last string, wrong bigint")


def _checkpoints(matrices: DataFrame) -> DataFrame:
    """(conv, cost, illegal, ends): the cost vector after each block, combined backwards."""
    def run(row: dict) -> dict:
        v, ends, wrong, right = list(FINISH), [], 0, None
        for b in reversed(row["blocks"]):
            ends.append({"block": b["block"], "vector": v})
            v = [min(b["costs"][4 * s + e] + v[e] for e in range(4)) for s in range(4)]
            wrong += b["wrong"] + (right is not None and b["last"] + right not in ("su", "ua", "au"))
            right = b["first"]
        return {"conv": row["conv"], "cost": v[0], "illegal": wrong, "ends": ends}

    own = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "first", "last", "wrong"))).alias("blocks"))
    schema = pa.schema([("conv", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()),
                        ("ends", pa.list_(pa.struct([("block", pa.int64()), ("vector", _LONGS)])))])
    return stored(arrow_map(own, _rows_of(run, schema), "conv bigint, cost bigint, illegal bigint, ends array<struct<block:bigint,vector:array<bigint>>>"),
                  "repair-checkpoints")


def _entries(blocks: DataFrame) -> DataFrame:
    """(conv, states, last): the state each block is entered in, and the one after all."""
    def leave(row: dict) -> dict:
        units = _of_units(row)
        return {"conv": row["conv"], "block": row["block"], "left": [forward(units, row["vector"], s)[1] for s in range(4)]}

    def follow(row: dict) -> dict:
        state, states = 0, []
        for b in row["blocks"]:
            states.append({"block": b["block"], "state": state})
            state = b["left"][state]
        return {"conv": row["conv"], "states": states, "last": state}

    left = arrow_map(blocks, _rows_of(leave, pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("left", pa.list_(pa.int32()))])),
                     "conv bigint, block bigint, left array<int>")
    own = left.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "left"))).alias("blocks"))
    schema = pa.schema([("conv", pa.int64()), ("states", pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32())]))), ("last", pa.int32())])
    return stored(arrow_map(own, _rows_of(follow, schema), "conv bigint, states array<struct<block:bigint,state:int>>, last int"), "repair-entries")


def _edits(blocks: DataFrame) -> DataFrame:
    """(conv, block, audit, edits) of each block, from its checkpoint and entry state."""
    def run(row: dict) -> dict:
        units = _of_units(row)
        edits, _ = forward(units, row["vector"], row["state"])
        audit = "".join("I" * len(ins) + edit + "D" * (u[2] - 1) for (ins, edit, _), u in zip(edits, units, strict=True))
        return {"conv": row["conv"], "block": row["block"], "audit": audit,
                "edits": [{"at": u["at"], "ins": ins, "edit": edit, "become": to} for u, (ins, edit, to) in zip(row["units"], edits, strict=True)]}

    schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("audit", pa.string()),
                        ("edits", pa.list_(pa.struct([("at", pa.int64()), ("ins", pa.string()), ("edit", pa.string()), ("become", pa.string())])))])
    kind = "conv bigint, block bigint, audit string, edits array<struct<at:bigint,ins:string,edit:string,become:string>>"
    return stored(arrow_map(blocks, _rows_of(run, schema), kind), "repair-edits")


#: Rows of a written batch.
_BATCH = 2048
#: A step of the stream: the edit of a unit, one of its texts, or what is inserted last.
EDIT, TEXT = 0, 1


def _merge(conv_type: pa.DataType, turn_type: pa.DataType) -> Callable:
    """Streams steps in conversation order into repaired rows."""
    schema = pa.schema([("c", conv_type), ("place", pa.int64()), ("edit", pa.string()), ("t", turn_type), ("r", pa.string()), ("x", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, place, started, letter, become = None, 0, False, "D", ""

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for c, t, r, kind, ins, edit, to, x in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if not started or c != conv:
                    conv, place, started = c, 0, True
                if kind == TEXT:
                    new = [(letter, t, NAMES[become] if become else r, x)]
                    letter, become = "D", ""  # further copies go
                else:
                    new = [("I", None, NAMES[i], "") for i in ins]
                    letter, become = edit, to
                for row in new:
                    out.append((conv, place, *row))
                    place += 1
                if len(out) >= _BATCH:
                    yield flush()
        yield flush()

    return run


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The repaired conversations and their summary: gaps, blank, duplicate,
    truncated, illegal, cost and audit."""
    texts = _texts(rows, conv, turn, role, text)
    units = _units(texts)
    blocks, totals = _blocks(units)
    points = _checkpoints(_matrices(blocks))
    ends = points.select("conv", F.explode("ends").alias("e")).select("conv", "e.block", "e.vector")
    tasks = _tasks(units)
    blocks = stored(blocks.join(ends, ["conv", "block"]).repartition(tasks, "conv", "block"), "repair-points")
    entries = _entries(blocks)
    states = entries.select("conv", F.explode("states").alias("e")).select("conv", "e.block", "e.state")
    edits = _edits(blocks.join(states, ["conv", "block"]).repartition(tasks, "conv", "block"))
    closing = F.when(F.col("last") == 2, "a").when(F.col("last") == 1, "ua").otherwise("")
    letters = F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"])
    ended = edits.groupBy("conv").agg(F.array_join(letters, "").alias("audit")).join(
        entries.select("conv", closing.alias("closing")), "conv").join(points.select("conv", "cost", "illegal"), "conv")
    done = totals.join(ended, "conv").select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                                             F.concat("audit", F.repeat(F.lit("I"), F.length("closing"))).alias("audit"), "closing")

    none = F.lit(None).cast("string")
    steps = units.select("c", "t", "r", "d", "at").join(edits.select(F.explode("edits").alias("e")).select("e.*"), "at").select(
        "c", F.lit(0).alias("part"), "t", "r", "d", F.lit(EDIT).alias("kind"), "ins", "edit", "become", none.alias("x"))
    spoken = texts.select("c", F.lit(0).alias("part"), "t", "r", "d", F.lit(TEXT).alias("kind"), none.alias("ins"), none.alias("edit"), none.alias("become"), "x")
    last = done.select("c", F.lit(1).alias("part"), F.lit(None).cast(units.schema["t"].dataType).alias("t"), none.alias("r"), F.lit(None).cast("binary").alias("d"),
                       F.lit(EDIT).alias("kind"), F.col("closing").alias("ins"), F.lit("D").alias("edit"), F.lit("").alias("become"), none.alias("x"))
    stream = steps.unionByName(spoken).unionByName(last).repartition("c").sortWithinPartitions("c", "part", "t", "r", "d", "kind")
    own, turns = stream.schema["c"].dataType, stream.schema["t"].dataType
    merged = arrow_map(stream.select("c", "t", "r", "kind", "ins", "edit", "become", "x"), _merge(to_arrow_type(own), to_arrow_type(turns)),
                       f"c {own.simpleString()}, place bigint, edit string, t {turns.simpleString()}, r string, x string")
    summary = rows.select(F.col(f"`{conv}`").alias("k")).distinct().join(done.drop("closing"), F.col("k").eqNullSafe(F.col("c")), "left").select(
        F.col("k").alias(conv), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"))
    return Repair(merged.select(F.col("c").alias(conv), "place", "edit", F.col("t").alias(turn), F.col("r").alias(role), F.col("x").alias(text)), summary)


def row_digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the rows of a :class:`Repair`: the rows that stay, as
    ``role:text``, joined by line feeds; read as a stream, a conversation after the other."""
    conv, _, edit, _, role, text = rows.columns
    kind = rows.schema[conv].dataType
    schema = pa.schema([("c", to_arrow_type(kind)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_now, digest, rows_in = None, None, 0
        for batch in batches:
            done = []
            for c, letter, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if digest is None or c != conv_now:
                    if digest is not None:
                        done.append({"c": conv_now, "repaired_sha256": digest.hexdigest()})
                    conv_now, digest, rows_in = c, hashlib.sha256(), 0
                if letter != "D":
                    digest.update(f"{chr(10) if rows_in else ''}{r}:{x}".encode())
                    rows_in += 1
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"c": conv_now, "repaired_sha256": digest.hexdigest()}], schema=schema)

    return arrow_map(rows.select(conv, edit, role, text), run, f"c {kind.simpleString()}, repaired_sha256 string")


def repair_table(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults after damage, the cheapest repair and the
    digest of the repaired conversation."""
    kept = conversations.select("conv_id", "turn", "role", "text")
    rows, summary = repair(damaged(kept))
    every = kept.select(F.col("conv_id").alias("k")).distinct()
    found = summary.join(row_digests(rows), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("k").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("k").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
