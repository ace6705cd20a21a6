"""Repair of the turns of conversations by cheapest edits, found with Dial's bucket queue.

A conversation is a graph: a node for each number of turns read (0 to n) and each state of the wanted order
`(s?(ua)+)?`; an arc for each edit. Costs are small whole numbers, so open nodes wait in a ring of as many buckets as the
dearest arc costs, plus one; no heap is needed. The search runs backwards from the accepting ends and records every
node's distance to them. The audit is then read forwards: from the start, always along the tight arc (whose cost is the
difference of distances) of the least letter, which gives the least string of all cheapest ones.

Spark finds faults and orders turns. A task reads a conversation's turns as one byte each for the search; texts stream by
once more for the repaired conversation's hash and never stand in memory together.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.llm.scratch import stored

# Costs of edits, and the rule by which turns are damaged.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DAMAGE_OUT_OF = 20
FILLED = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: For each state, the state that a turn of the only fitting role (user or assistant) leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Codes of turns: 4 * fault + initial of the role. Faults: none, truncated, must go.
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
OTHER, SOUND, CUT_OFF, MUST_GO = 0, 0, 1, 2
RING = REROLE + TRUNCATED + 1


def arcs(code: int | None, state: int) -> list[tuple[str, int, int, int]]:
    """Edits from a state in order of their letters: letter, turns read, next state, cost. code None: no turn is left."""
    out = []
    if code is not None:
        fault, role = divmod(code, 4)
        extra = TRUNCATED if fault == CUT_OFF else 0
        out.append(("D", 1, state, DELETE))
        if fault != MUST_GO:
            if role != OTHER and (role == NEXT[state] or (role == SYSTEM and state == START)):
                out.append(("K", 1, role, KEEP + extra))
            out.append(("R", 1, NEXT[state], REROLE + extra))
    out.append(("I", 0, NEXT[state], INSERT))
    return sorted(out)


ARCS = {(code, state): arcs(code, state) for code in [*range(12), None] for state in range(4)}
#: (code, target state) -> (state, cost) of arcs that read a turn, and target -> (state, cost) of those that do not.
READING = {(code, to): [(s, c) for s in range(4) for _, n, t, c in ARCS[code, s] if n and t == to] for code in range(12) for to in range(4)}
INSERTING = {to: [(s, INSERT) for s in range(4) if NEXT[s] == to] for to in range(4)}


def distances(codes: bytes) -> array:
    """Cost of the cheapest edits from each node (4 * turns read + state) to an accepting end; -1: none (never so here)."""
    n = len(codes)
    dist = array("q", [-1]) * (4 * (n + 1))
    ring: list[list[int]] = [[] for _ in range(RING)]
    ring[0] = [4 * n + s for s in ENDS]
    at, waiting = 0, len(ring[0])
    while waiting:
        bucket = ring[at % RING]
        while bucket:  # arcs of no cost add to the bucket that is being emptied
            node = bucket.pop()
            waiting -= 1
            if dist[node] >= 0:
                continue
            dist[node] = at
            i, state = divmod(node, 4)
            for before, cost in INSERTING[state]:
                if dist[4 * i + before] < 0:
                    ring[(at + cost) % RING].append(4 * i + before)
                    waiting += 1
            if i:
                for before, cost in READING[codes[i - 1], state]:
                    if dist[4 * (i - 1) + before] < 0:
                        ring[(at + cost) % RING].append(4 * (i - 1) + before)
                        waiting += 1
        at += 1
    return dist


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit (letters of the edits in order) of the cheapest repair; of several, the least string."""
    dist, n = distances(codes), len(codes)
    i, state, audit = 0, START, []
    while i < n or dist[4 * i + state]:
        here = dist[4 * i + state]
        for letter, read, to, cost in ARCS[codes[i] if i < n else None, state]:
            if cost + dist[4 * (i + read) + to] == here:
                audit.append(letter)
                i, state = i + read, to
                break
    return dist[START], "".join(audit)


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage that crc32(`conv:turn`) % 20 deals; nulls of all but turn are one space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    dealt = turns.withColumn("deal", F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % DAMAGE_OUT_OF)
    filled = [F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")]
    said = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate(filled[1], ".!?", "")).otherwise(filled[1])
    rows = dealt.where("deal <> 0").select("conv", "turn", F.when(F.col("deal") == 4, "user").otherwise(filled[0]).alias("role"), said.alias("text"), F.when(F.col("deal") == 3, 2).otherwise(1).cast("long").alias("copies"))
    return rows


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies (of equal rows), code and fault of the first of them; all further ones are duplicates.

    Equal rows are counted before they meet, and a text's first turn in its conversation is an aggregate.
    """
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # A null turn is before all others.
    early = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.sha2("text", 256).alias("h")).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_first"))
    joined = rows.join(early, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.sha2("text", 256) == F.col("h")))
    blank = ~F.col("text").rlike(FILLED)
    again = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first")))
    fault = F.when(blank, "b").when(again, "d").when(~F.col("text").rlike(ENDED), "t").otherwise("-")
    return joined.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def plans_of(rows: DataFrame, kind: str) -> DataFrame:
    """conv, plan (audit), gaps, blank, duplicate, truncated, illegal, cost. A task holds one byte for each turn of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: object = None
        state: dict | None = None

        def done() -> None:
            if state is not None:
                cost, audit = cheapest(bytes(state["codes"]))
                gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
                out.append((conv, audit, gaps, state["b"], state["d"], state["t"], state["illegal"], cost))

        for batch in batches:
            for c, turn, role, copies, fault in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "copies", "fault")), strict=True):
                if state is None or c != conv:
                    done()
                    conv, state = c, {"codes": bytearray(), "b": 0, "d": 0, "t": 0, "illegal": 0, "turns": 0, "first": 0, "last": None, "role": None}
                initial = role[:1]
                who = INITIALS.get(initial, OTHER)
                later = "b" if fault == "b" else "d"
                state["codes"].append(4 * (MUST_GO if fault in "bd" else CUT_OFF if fault == "t" else SOUND) + who)
                state["codes"].extend(bytes([4 * MUST_GO + who]) * (copies - 1))
                if fault != "-":
                    state[fault] += 1
                state[later] += copies - 1
                if state["role"] is not None:
                    state["illegal"] += state["role"] + initial not in ("su", "ua", "au")
                state["illegal"] += copies - 1  # a role after itself
                state["role"] = initial
                if turn is not None:
                    if state["last"] is None:
                        state["first"] = turn
                    state["turns"] += turn != state["last"]
                    state["last"] = turn
            if len(out) > 1000:
                yield to_batch(out)
                out.clear()
        done()
        yield to_batch(out)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    names = ["conv", "plan", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    types = [ARROW[kind], pa.string(), *[pa.int64()] * 6]
    return rows.select("conv", "turn", "role", "copies", "fault").mapInArrow(run, f"conv {kind}, plan string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def repaired(lines: DataFrame, kind: str) -> DataFrame:
    """conv, repaired_sha256, from rows in which a conversation's plan stands before its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: object = None
        writer: Writer | None = None
        for batch in batches:
            for c, plan, role, text, copies in zip(*(batch.column(x).to_pylist() for x in ("conv", "plan", "role", "text", "copies")), strict=True):
                if plan is not None:
                    if writer is not None:
                        out.append((conv, writer.close()))
                    conv, writer = c, Writer(plan)
                else:
                    for _ in range(copies):
                        writer.turn(role, text)
            if len(out) > 1000:
                yield to_batch(out)
                out.clear()
        if writer is not None:
            out.append((conv, writer.close()))
        yield to_batch(out)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], ARROW[kind]), pa.array([h for _, h in rows], pa.string())], names=["conv", "repaired_sha256"])

    return lines.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


class Writer:
    """Hashes the repaired conversation line by line, as an audit says."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.first, self.hash = audit, 0, START, True, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.line(ROLE_OF[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = INITIALS[role[:1]]
            self.line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.line(ROLE_OF[self.state], text)

    def close(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns stand in order of turn (nulls first), then role, then text. Null roles and texts are one space: such a role
    fits nowhere, such a text is blank. Each turn's first fault counts: blank, duplicate (role and text seen earlier in
    the conversation), truncated (its last character but spaces is none of .!?). Repeated rows are duplicates. A null id
    is one conversation. With `damage`, rows are first damaged by crc32(`id:turn`) % 20; a conversation that loses all
    its rows has zeros, an empty audit and the hash of the empty string. The audit is one value and has a letter for
    each turn; a conversation's texts pass one task, line by line. Other columns are not read. An empty table gives an
    empty table. Ids are whole numbers or strings.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = own.schema["conv"].dataType.simpleString()
    if kind not in ARROW:
        raise TypeError(f"ids of type {kind}; whole numbers or strings are needed")
    blank = F.lit(" ")
    rows = damaged(own) if damage else own.select("conv", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(1).cast("long").alias("copies"))
    rows = stored(faults(rows), "turns")
    order: list[str | Column] = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    plans = stored(plans_of(rows.repartition("conv").sortWithinPartitions(*order), kind), "plans")
    no = lambda t: F.lit(None).cast(t)
    lines = plans.select("conv", "plan", no("long").alias("turn"), no("string").alias("role"), no("string").alias("text"), F.lit(0).cast("long").alias("copies")).unionAll(rows.select("conv", no("string").alias("plan"), "turn", "role", "text", "copies"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", F.col("plan").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    hashes = repaired(lines, kind).select(F.col("conv").alias("h_conv"), "repaired_sha256")
    everyone = own.select(F.col("conv").alias("o_conv")).distinct()
    out = everyone.join(plans, F.col("o_conv").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("o_conv").eqNullSafe(F.col("h_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("o_conv").alias(conv_col), *counts, F.coalesce("plan", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
