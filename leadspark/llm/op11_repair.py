"""Repair of conversations: the cheapest edits that give alternating turns.

A conversation is to read `(s?(ua)+)?` by the initials of its roles. Kept rows cost
nothing, a new role 2, a deleted row 3 (blank and repeated rows must go), an inserted
empty row 2, a truncated row that stays 1 more. Among the cheapest edits the ASCII-least
string of their initials is taken; it fixes the repaired conversation.

The costs to the end are a vector of four states for each place between two rows. A
backward pass keeps it at checkpoints about a square root apart; the forward walk
recomputes one block of vectors at a time and takes the least letter that is tight.

Rows are dealt by ranges of (conv_id, turn, role, text), not by conversation, so a hot
one is spread over many tasks. A conversation inside one task's range is done there. One
that crosses ranges becomes segments: each gives the min-plus matrix of its rows, the
products of the matrices (one for each range) give the vectors at the ends of the
segments, and one forward stream walks segment after segment, holding one at a time.
The hash of a conversation must be taken in order, so that last stream of a hot
conversation is one task's; it holds no more than a segment and the audit.

Defined results: nulls in conv_id are one conversation, whose id is null again; a null
turn comes first; a null role or text is one space, as a null id or turn is in the key of
the damage; rows of one turn are ordered by role, hash of text, text; a kept row needs a
role with an initial that fits, so an empty or foreign role is given a new one or goes;
exact repeats of a row are neighbours, all but the first repeated; texts of any length are
taken whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadspark.llm import common as C

c = F.col
FAR = 1 << 60
RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. The first and the last may end.
STATES = 4
ENDS = (0, FAR, FAR, 0)
#: The role that a new or inserted row gets in a state, and the state after it.
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: The state after a kept row, by state and initial.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FAIR = ("su", "ua", "au")
WORD = "[^\\x20\\x09-\\x0D]"

Vector = tuple[int, ...]


def closed(v: list[int] | Vector) -> Vector:
    """The costs with rows inserted here: two at most are of use."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + u), min(v[1], INSERT + u), u, a


def before(row: tuple[str, str], after: Vector) -> Vector:
    """Costs to the end before a row (initial, fault), from those after it."""
    initial, fault = row
    out = [DELETE + x for x in after]
    if fault in ("", "t"):
        extra = CUT_OFF if fault else 0
        for s in range(STATES):
            out[s] = min(out[s], RETYPE + extra + after[NEXT[s][0]])
            to = KEPT[s].get(initial)
            if to is not None:
                out[s] = min(out[s], extra + after[to])
    return closed(out)


def matrix(rows: list[tuple[str, str]]) -> list[int]:
    """Min-plus matrix of a segment, row by row: costs from a state before it to one after."""
    columns = []
    for end in range(STATES):
        v = tuple(0 if s == end else FAR for s in range(STATES))
        for row in reversed(rows):
            v = before(row, v)
        columns.append(v)
    return [min(columns[j][i], FAR) for i in range(STATES) for j in range(STATES)]


def walk(rows: list[tuple[str, str]], end: Vector, state: int) -> tuple[list[tuple[str, int]], int]:
    """Edits (letter, state after it) from a state before the rows to the costs `end` after
    them, and the last state. Vectors are kept at checkpoints and recomputed block by block."""
    n = len(rows)
    step = max(1, math.isqrt(n))
    marks = {n: end}
    v = end
    for i in range(n - 1, -1, -1):
        v = before(rows[i], v)
        if i % step == 0:
            marks[i] = v
    edits: list[tuple[str, int]] = []
    for low in range(0, n, step):
        high = min(low + step, n)
        block = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(before(rows[i], block[-1]))
        block.reverse()
        for i in range(low, high):
            here, after = block[i - low], block[i - low + 1]
            initial, fault = rows[i]
            while True:
                if DELETE + after[state] == here[state]:
                    edits.append(("D", state))
                elif INSERT + here[NEXT[state][0]] == here[state]:
                    state = NEXT[state][0]
                    edits.append(("I", state))
                    continue
                else:
                    to = KEPT[state].get(initial)
                    if to is not None and (CUT_OFF if fault else 0) + after[to] == here[state]:
                        edits.append(("K", to))
                        state = to
                    else:
                        state = NEXT[state][0]
                        edits.append(("R", state))
                break
    return edits, state


def tail(state: int) -> list[tuple[str, int]]:
    """Rows to insert at the end of a conversation."""
    out = []
    while ENDS[state]:
        state = NEXT[state][0]
        out.append(("I", state))
    return out


def fault_of(row: dict) -> str:
    return "b" if row["blank"] else "d" if row["dup"] else "t" if row["cut_off"] else ""


class Segment:
    """The rows of one conversation that one task holds, and what they give."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows, self.codes = [], []
        for r in rows:
            first = (r["role"][:1], fault_of(r))
            self.rows += [r] * r["copies"]
            self.codes += [first] + [(first[0], "b" if first[1] == "b" else "d")] * (r["copies"] - 1)

    def summary(self, last_turn: int | None, last_initial: str | None) -> dict:
        """Counts; `last_*` are of the row before this segment."""
        turns = [r["turn"] for r in self.rows if r["turn"] is not None]
        distinct = len(set(turns)) - (1 if turns and turns[0] == last_turn else 0)
        initials = ([] if last_initial is None else [last_initial]) + [x for x, _ in self.codes]
        faults = [f for _, f in self.codes]
        return {
            "low": turns[0] if turns else None,
            "high": turns[-1] if turns else None,
            "turns": distinct,
            "blank": faults.count("b"),
            "duplicate": faults.count("d"),
            "truncated": faults.count("t"),
            "illegal": sum(1 for a, b in zip(initials, initials[1:], strict=False) if a + b not in FAIR),
        }

    def repaired(self, edits: list[tuple[str, int]]) -> tuple[list[dict], int]:
        """The lines that the edits give, and their cost."""
        role_in = {2: "user", 3: "assistant"}
        out, cost, at = [], 0, 0
        for letter, state in edits:
            if letter == "I":
                out.append({"role": role_in[state], "text": ""})
                cost += INSERT
                continue
            row, fault = self.rows[at], self.codes[at][1]
            at += 1
            if letter == "D":
                cost += DELETE
                continue
            cost += (RETYPE if letter == "R" else 0) + (CUT_OFF if fault == "t" else 0)
            out.append({"role": row["role"] if letter == "K" else role_in[state], "text": row["text"]})
        return out, cost


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows, damaged by the checksum of their ids."""
    spoken = lambda col: F.coalesce(c(col).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spoken("text"), "[.!?]", "")).otherwise(spoken("text"))
    role = F.when(kind == 4, "user").otherwise(spoken("role"))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    twice = F.explode(F.when(c("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hurt.select("conv_id", "turn", "role", "text", twice.alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """One row for each distinct (conv_id, turn, role, text) with its copies and faults."""
    text = F.coalesce(c("text").cast("string"), F.lit(" "))
    role = F.coalesce(c("role").cast("string"), F.lit(" "))
    once = rows.select("conv_id", c("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    once = once.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies")).withColumn("name", F.sha2("text", 256))
    order = F.struct(c("turn").isNotNull().alias("has"), "turn")
    again = once.groupBy("conv_id", "role", "name").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    again = again.select(c("conv_id").alias("conv_2"), c("role").alias("role_2"), c("name").alias("name_2"), "first")
    same = c("conv_id").eqNullSafe(c("conv_2")) & (c("role") == c("role_2")) & (c("name") == c("name_2"))
    dup = c("first").isNotNull() & (order > c("first"))
    last = F.regexp_extract("text", f"({WORD})[\\x20\\x09-\\x0D]*\\z", 1)
    return once.join(again, same, "left").select(
        "conv_id", "turn", "role", "text", "copies", F.xxhash64("text").alias("th"),
        (~c("text").rlike(WORD)).alias("blank"), F.coalesce(dup, F.lit(False)).alias("dup"), (~last.isin(".", "!", "?")).alias("cut_off"),
    )


LINES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
COUNTS = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost"]
INPUT = ["turn", "role", "text", "copies", "blank", "dup", "cut_off"]


def _schema(conv: T.DataType, *more: T.StructField) -> T.StructType:
    fields = [T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), *more]
    return T.StructType(fields)


def groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of ordered batches by neighbouring equal keys; one group is held at a time."""
    now: tuple | None = None
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 500, room: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x["text"]) for x in r.get("lines") or ()) + len(r.get("text") or "")
        if len(held) >= most or size > room:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def repair(rows: DataFrame) -> DataFrame:
    """rows: (conv_id, turn, role, text). (conv_id, part, last, low, high, turns, blank, duplicate,
    truncated, illegal, cost, audit, lines): one row for a conversation or, if it crosses ranges,
    one for each of its segments in order of part; lines are the repaired rows."""
    spark = rows.sparkSession
    C.small_batches(spark)
    dealt = judged(rows).repartitionByRange("conv_id", "turn", "role", "th").sortWithinPartitions("conv_id", "turn", "role", "th", "text")
    dealt = dealt.withColumn("part", F.spark_partition_id()).select("conv_id", "part", *INPUT)
    conv = rows.schema["conv_id"].dataType
    row_fields = [T.StructField(n, dealt.schema[n].dataType) for n in INPUT]
    out_fields = [T.StructField("last", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("audit", T.StringType()), T.StructField("lines", LINES)]
    both = _schema(conv, T.StructField("at", T.IntegerType()), *row_fields[:4], *(T.StructField(f"is_{f.name}", f.dataType) for f in row_fields[4:]), *out_fields)
    both_arrow, out_arrow = to_arrow_schema(both), to_arrow_schema(_schema(conv, *out_fields))
    start = 0

    def whole(rows_: list[dict]) -> dict:
        s = Segment(rows_)
        edits, state = walk(s.codes, closed(ENDS), start)
        edits += tail(state)
        lines, cost = s.repaired(edits)
        return {"conv_id": rows_[0]["conv_id"], "part": rows_[0]["part"], "last": True, **s.summary(None, None), "cost": cost, "audit": "".join(e for e, _ in edits), "lines": lines}

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations that begin and end here are done; the first and the last pass on."""

        def each() -> Iterator[dict]:
            held: list[dict] | None = None
            for i, (_, g) in enumerate(groups(batches, ("conv_id",))):
                if i > 1:
                    yield whole(held)
                elif i == 1:
                    yield from passed(held)
                held = g
            if held:
                yield from passed(held)

        def passed(g: list[dict]) -> Iterator[dict]:
            for at, r in enumerate(g):
                yield {"conv_id": r["conv_id"], "part": r["part"], "at": at, **{n: r[n] for n in INPUT[:4]}, **{f"is_{n}": r[n] for n in INPUT[4:]}}

        yield from _batches(each(), both_arrow)

    first = C.settle(dealt.mapInArrow(local, both))
    done = first.where("last").select("conv_id", "part", *(f.name for f in out_fields))
    crossing = first.where("last is null").select("conv_id", "part", "at", *INPUT[:4], *(c(f"is_{n}").alias(n) for n in INPUT[4:]))

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([to_arrow_schema(_schema(conv)).field("conv_id"), ("part", pa.int32()), ("costs", pa.list_(pa.int64()))])
        made = ({"conv_id": k[0], "part": k[1], "costs": matrix(Segment(g).codes)} for k, g in groups(batches, ("conv_id", "part")))
        yield from _batches(made, schema)

    costs = T.StructField("costs", T.ArrayType(T.LongType()))
    in_order = lambda df, *by: df.repartition(*by).sortWithinPartitions("conv_id", *(x for x in ("part", "at") if x in df.columns))
    matrices = in_order(crossing, "conv_id", "part").mapInArrow(products, _schema(conv, costs))

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vector at the end of each segment; a conversation has one segment a range."""

        def each() -> Iterator[dict]:
            for _, g in groups(batches, ("conv_id",)):
                v = closed(ENDS)
                for r in reversed(g):
                    yield {"conv_id": r["conv_id"], "part": r["part"], "costs": list(v)}
                    m = r["costs"]
                    v = tuple(min(m[i * STATES + j] + v[j] for j in range(STATES)) for i in range(STATES))

        yield from _batches(each(), pa.schema([to_arrow_schema(_schema(conv)).field("conv_id"), ("part", pa.int32()), ("costs", pa.list_(pa.int64()))]))

    ends = in_order(matrices, "conv_id").mapInArrow(suffixes, _schema(conv, costs))
    # The vector of a segment goes before its rows: a row without a text.
    marked = crossing.withColumn("costs", F.lit(None).cast("array<bigint>")).unionByName(ends.withColumn("at", F.lit(-1)), allowMissingColumns=True)

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            now, state, turn, initial, held = (), start, None, None, None
            for key, g in groups(batches, ("conv_id", "part")):
                if held and key[:1] != now:
                    yield finished(held, state)
                    held = None
                if held:
                    yield held
                if key[:1] != now:
                    now, state, turn, initial = key[:1], start, None, None
                end = tuple(g[0]["costs"])
                s = Segment(g[1:])
                edits, state = walk(s.codes, end, state)
                lines, cost = s.repaired(edits)
                held = {"conv_id": key[0], "part": key[1], "last": False, **s.summary(turn, initial), "cost": cost, "audit": "".join(e for e, _ in edits), "lines": lines}
                turn, initial = s.rows[-1]["turn"], s.codes[-1][0]
            if held:
                yield finished(held, state)

        def finished(seg: dict, state: int) -> dict:
            more = tail(state)
            lines = [{"role": "user" if s == 2 else "assistant", "text": ""} for _, s in more]
            return seg | {"last": True, "cost": seg["cost"] + INSERT * len(more), "audit": seg["audit"] + "I" * len(more), "lines": seg["lines"] + lines}

        yield from _batches(each(), out_arrow)

    crossed = in_order(marked, "conv_id").mapInArrow(forward, done.schema)
    return done.unionByName(crossed)


def with_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, low, high, turns, blank, ..., cost, audit, repaired_sha256) of each conversation; one
    of many segments is hashed as a stream of them."""
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    kept = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    spread = repaired.groupBy("conv_id").agg(F.count("*").alias("segments")).where("segments > 1").select(c("conv_id").alias("conv_2"))
    same = c("conv_id").eqNullSafe(c("conv_2"))
    one = repaired.join(spread, same, "left_anti").withColumn("repaired_sha256", F.sha2(F.concat_ws("\n", F.transform("lines", line)), 256)).select(kept)
    parts = repaired.join(spread, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = to_arrow_schema(one.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(state: dict) -> dict:
            return {**state["sums"], "conv_id": state["conv_id"], "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()}

        def each() -> Iterator[dict]:
            s: dict | None = None
            for b in batches:
                for r in b.to_pylist():
                    if s is None or s["conv_id"] != r["conv_id"]:
                        if s:
                            yield done(s)
                        s = {"conv_id": r["conv_id"], "sums": dict.fromkeys(COUNTS[2:], 0) | {"low": None, "high": None}, "audit": [], "sha": hashlib.sha256(), "any": False}
                    for n in COUNTS[2:]:
                        s["sums"][n] += r[n]
                    if r["low"] is not None:
                        s["sums"]["low"] = r["low"] if s["sums"]["low"] is None else s["sums"]["low"]
                        s["sums"]["high"] = r["high"]
                    s["audit"].append(r["audit"])
                    for x in r["lines"]:
                        s["sha"].update(f"{chr(10) if s['any'] else ''}{x['role']}:{x['text']}".encode())
                        s["any"] = True
            if s:
                yield done(s)

        yield from _batches(each(), schema)

    return one.unionByName(parts.mapInArrow(run, one.schema))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.read(spark, sf_dir, "conversations")
    made = with_digests(C.settle(repair(damaged(rows)))).withColumnRenamed("conv_id", "conv_2")
    every = rows.select("conv_id").distinct()
    out = every.join(made, c("conv_id").eqNullSafe(c("conv_2")), "left")
    zero = lambda col: F.coalesce(col, F.lit(0)).cast("long")
    return out.select(
        "conv_id", zero(c("high") - c("low") + 1 - c("turns")).alias("gaps"), *(zero(c(n)).alias(n) for n in COUNTS[3:]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES: dict[str, str] = {}
