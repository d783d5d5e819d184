"""Repair of conversations at least cost, by dynamic programming over a trie.

A row's signature is one letter: the class of its role (s, u, a or another) and
its fault.  Signatures of conversations are range-partitioned and sorted, so that
walking them in order inserts each into a prefix trie whose current path is a
stack: the layers of the DP of a shared prefix are computed once, and a terminal
node emits its answers.  Equal signatures are dealt by conversation too, so none
is bound to one task.

A layer keeps, for each state of the role grammar ``(s?(ua)+)?`` - nothing yet,
after s, after u, after a - the least cost, the move that led there, and the rank
of its audit among those of the layer: audits of one layer hold as many row
letters and end with one, so none is a prefix of another and ranks decide ties.

A long conversation is cut into blocks of ``BLOCK`` rows.  Blocks after the first
are solved from every state; costs and ranks of blocks, not their audits, are then
folded in order.  Positions come from a prefix scan, so no window holds a
conversation, and edits meet their rows by (conversation, position).

Defined results: rows are in order of turn (nulls first), role and text; null
roles and texts are one space; rows without a conversation id form one; a role
with another initial can only be deleted or get a new role; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.scan import previous, ranged, running

from .store import materialize, partitions, small_batches

BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
CLASSES, FAULTS = "suao", ("fine", "gone", "truncated")
#: What may follow a state: the role that an inserted or renamed row takes.
TURN = {NOTHING: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
#: A plan tells edits with roles: inserts U and A, new roles u and a, K and D.
AUDIT = str.maketrans("UAua", "IIRR")
#: Bytes and characters that are no word.
SPACE = r"\x20\x09-\x0D"


def row_class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


# ------------------------------------------------------------------ the grammar's moves


def _inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, plan) after no, one or two inserts; a third would lead back."""
    cost, plan = 0, ""
    yield state, cost, plan
    for _ in range(2):
        role, state = TURN[state]
        cost, plan = cost + INSERT, plan + role.upper()
        yield state, cost, plan


@cache
def moves(letter: str) -> list[tuple[int, int, int, str, str]]:
    """(from, to, cost, audit, plan) over one row, the best for each from and to."""
    kind, fault = CLASSES[(ord(letter) - 97) // 3], FAULTS[(ord(letter) - 97) % 3]
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for state in range(4):
        for at, cost, plan in _inserts(state):
            ways = [(at, cost + DELETE, "D")]
            if fault != "gone":
                more = cost + TRUNCATED * (fault == "truncated")
                role, to = TURN[at]
                ways.append((to, more + REROLE, role))
                if kind == role:
                    ways.append((to, more + KEEP, "K"))
                if kind == "s" and at == NOTHING:
                    ways.append((AFTER_S, more + KEEP, "K"))
            for to, total, edit in ways:
                way = total, (plan + edit).translate(AUDIT), plan + edit
                best[state, to] = min(best.get((state, to), way), way)
    return [(a, b, *way) for (a, b), way in best.items()]


#: A layer: for each state (cost, rank, state before, plan of the move) or None.
Layer = list[tuple[int, int, int, str] | None]


def start(state: int) -> Layer:
    return [(0, 0, -1, "") if s == state else None for s in range(4)]


def step(layer: Layer, letter: str) -> Layer:
    found: dict[int, tuple[int, tuple[int, str], int, str]] = {}
    for a, b, cost, audit, plan in moves(letter):
        if (was := layer[a]) is not None:
            way = was[0] + cost, (was[1], audit), a, plan
            if b not in found or way[:2] < found[b][:2]:
                found[b] = way
    order = {path: k for k, path in enumerate(sorted(x[1] for x in found.values()))}
    return [(x[0], order[x[1]], x[2], x[3]) if (x := found.get(s)) else None for s in range(4)]


def plan_of(layers: list[Layer], state: int) -> str:
    out = []
    for layer in reversed(layers[1:]):
        _, _, state, plan = layer[state]
        out.append(plan)
    return "".join(reversed(out))


CELL = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("plan", pa.string())])


class Trie:
    """The path from the root to the last signature; ``entries``: states to start from."""

    def __init__(self, entries: tuple[int, ...]):
        self.entries, self.signature = entries, ""
        self.path = [[start(e)] for e in entries]
        self.answer: list[dict] | None = None

    def solve(self, signature: str) -> list[dict]:
        if self.answer is not None and signature == self.signature:
            return self.answer
        shared = 0
        for a, b in zip(signature, self.signature, strict=False):
            if a != b:
                break
            shared += 1
        for layers in self.path:
            del layers[shared + 1 :]
            for letter in signature[shared:]:
                layers.append(step(layers[-1], letter))
        self.signature = signature
        self.answer = [{"entry": e, "exit": s, "cost": x[0], "rank": x[1], "plan": plan_of(layers, s)} for e, layers in zip(self.entries, self.path, strict=True) for s, x in enumerate(layers[-1]) if x]
        return self.answer


def solve_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their signatures, with their cells."""
    first, later = Trie((NOTHING,)), Trie((NOTHING, AFTER_S, AFTER_U, AFTER_A))
    for batch in batches:
        blocks, signatures = batch.column("block").to_pylist(), batch.column("signature").to_pylist()
        cells = [(later if b else first).solve(s) for b, s in zip(blocks, signatures, strict=True)]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "signature"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(cells, pa.list_(CELL))], names=[*(batch.schema.names[i] for i in keep), "cells"])


def fold(blocks: list[dict]) -> tuple[int, str, list[tuple[int, int, int]]]:
    """(cost, inserts at the end, (block, entry, exit) of the best path) of a conversation's blocks, in order."""
    best = {NOTHING: (0, 0)}
    back: list[dict[int, int]] = []
    for b in blocks:
        found: dict[int, tuple[int, tuple[int, int], int]] = {}
        for c in b["cells"]:
            if (was := best.get(c["entry"])) is not None:
                way = was[0] + c["cost"], (was[1], c["rank"]), c["entry"]
                if c["exit"] not in found or way[:2] < found[c["exit"]][:2]:
                    found[c["exit"]] = way
        order = {path: k for k, path in enumerate(sorted(x[1] for x in found.values()))}
        best = {s: (x[0], order[x[1]]) for s, x in found.items()}
        back.append({s: x[2] for s, x in found.items()})
    ends = [(cost + more, (rank, plan.translate(AUDIT)), s, plan) for s, (cost, rank) in best.items() for to, more, plan in _inserts(s) if to in (NOTHING, AFTER_A)]
    cost, _, state, tail = min(ends)
    picks = []
    for b, came in zip(reversed(blocks), reversed(back), strict=True):
        picks.append((b["block"], came[state], state))
        state = came[state]
    return cost, tail, picks[::-1]


PICK = pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())]))


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [fold(x) for x in batch.column("blocks").to_pylist()]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "blocks"]
        columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([[dict(zip(("block", "entry", "exit"), p, strict=True)) for p in d[2]] for d in done], PICK)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], names=[*(batch.schema.names[i] for i in keep), "cost", "tail", "picks"])


# ------------------------------------------------------------------ on Spark


def _meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a missing one equals a missing one."""
    there = b.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return a.join(there, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, pos (from 1), fault (the first of blank, duplicate, truncated or
    null), illegal and fresh_turn of each row; written."""
    space = F.lit(" ")
    tidy = rows.select("conv", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    # texts themselves stay out of the sample that chooses the ranges
    short = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    at = ranged(tidy, short, ["conv"], write=lambda df: materialize(df, "repair-ranges"))
    at = at.withColumn("initial", F.substring("role", 1, 1)).withColumn("digest", F.unhex(F.sha2("text", 256)))
    order, by = ["turn", "role", "text"], ["conv"]
    at = running(at, {"pos": F.lit(1).cast("bigint")}, order, by)
    at = previous(at, {"before": "initial", "turn_before": "turn"}, order, by)
    at = at.withColumn("illegal", F.coalesce(~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False)))
    at = at.withColumn("fresh_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))
    at = materialize(at.select("conv", "turn", "role", "text", "pos", "digest", "illegal", "fresh_turn"), "repair-rows")
    seen = at.groupBy("conv", "role", "digest").agg(F.min("pos").alias("seen"))
    out = _meet(at, seen, ["conv", "role", "digest"])
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("seen") < F.col("pos"), "duplicate").when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), "truncated")
    return materialize(out.withColumn("fault", fault).drop("digest", "seen"), "repair-faults")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``: conv, turn, role, text.  Returns

    a report: conv, gaps, blank, duplicate, truncated, illegal, cost and ``audit``, the
    initials of the cheapest edits in order, the least in ASCII of equal cost;
    the repaired rows: conv, pos, sub, role, text, in order of (pos, sub)."""
    spark = rows.sparkSession
    small_batches(spark)
    at = faults(rows)
    letter = 3 * (F.instr(F.lit(CLASSES), row_class(F.col("role"))) - 1) + F.when(F.col("fault") == "truncated", 2).when(F.col("fault").isNotNull(), 1).otherwise(0)
    count = lambda c: F.count_if(c)
    blocks = at.groupBy("conv", F.expr(f"(pos - 1) div {BLOCK}").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.char(97 + letter).alias("s")))), lambda x: x["s"]), "").alias("signature"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        count(F.col("fresh_turn")).alias("turns"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
    )
    dealt = blocks.repartitionByRange(partitions(spark), "signature", "conv", "block").sortWithinPartitions("signature")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "signature")
    solved = materialize(dealt.mapInArrow(solve_sorted, f"{kept}, cells array<struct<entry:int,exit:int,cost:bigint,rank:int,plan:string>>"), "repair-blocks")
    narrow = F.transform("cells", lambda c: F.struct(c["entry"].alias("entry"), c["exit"].alias("exit"), c["cost"].alias("cost"), c["rank"].alias("rank")))
    sums = [F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]]
    talks = solved.groupBy("conv").agg(*sums, F.array_sort(F.collect_list(F.struct("block", narrow.alias("cells")))).alias("blocks"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in talks.schema if f.name != "blocks")
    folded = materialize(talks.mapInArrow(fold_batches, f"{kept}, cost bigint, tail string, picks array<struct<block:bigint,entry:int,exit:int>>"), "repair-talks")
    picked = folded.select("conv", F.explode("picks").alias("p")).select("conv", "p.block", "p.entry", "p.exit")
    piece = F.filter("cells", lambda c: (c["entry"] == F.col("entry")) & (c["exit"] == F.col("exit")))[0]["plan"]
    pieces = materialize(_meet(picked, solved.select("conv", "block", "cells"), ["conv", "block"]).select("conv", "block", piece.alias("plan")), "repair-plans")
    plans = pieces.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "plan"))), lambda x: x["plan"]), "").alias("plan"))
    report = _meet(folded, plans, ["conv"]).select(
        "conv",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        F.translate(F.concat("plan", "tail"), "UAua", "IIRR").alias("audit"),
    )
    # each row's edits: inserts before it, then its own letter
    tokens = pieces.select("conv", F.col("block"), F.posexplode(F.regexp_extract_all("plan", F.lit("[UA]*[KuaD]"), 0)).alias("i", "token")).select("conv", (F.col("block") * BLOCK + F.col("i") + 1).alias("pos"), "token")
    own = F.right("token", F.lit(1))
    put = F.transform(F.split(F.regexp_extract("token", "^[UA]*", 0), ""), lambda x: F.struct(x.alias("edit"), F.lit("").alias("text")))
    put = F.filter(put, lambda x: x["edit"] != "")
    edited = _meet(tokens, at.select("conv", "pos", "role", "text"), ["conv", "pos"])
    listed = F.concat(put, F.array(F.struct(own.alias("edit"), F.col("text").alias("text"))))
    name = F.when(F.upper("e.edit") == "U", "user").when(F.upper("e.edit") == "A", "assistant").otherwise(F.col("role"))
    out = edited.select("conv", "pos", "role", F.posexplode(listed).alias("sub", "e")).where("e.edit <> 'D'").select("conv", "pos", "sub", name.alias("role"), F.col("e.text").alias("text"))
    ends = folded.where("tail <> ''").select("conv", F.posexplode(F.split("tail", "")).alias("sub", "edit")).where("edit <> ''")
    ends = ends.select("conv", F.lit(2**62).alias("pos"), "sub", F.when(F.col("edit") == "U", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    return report, out.unionByName(ends)
