"""Reassembly of conversations from turns that arrive late, twice or never.

Turns arrive in numbered batches.  Each batch is one start of a stateful
Structured Streaming query on one checkpoint (``applyInPandasWithState``), whose
closure carries the batch's number.  A conversation's state is the serialized
min-heap of its kept, unreleased turns; every turn below ``next`` is released, so
the set of kept turns is that prefix and the heap.  A turn is popped while the top
of the heap equals ``next``.  Timeouts only wake a conversation without arrivals
in every batch: what closes it is the number of the batch, never the clock.

The stream carries numbers and roles; texts stay in the written arrivals and join
the events once the stream has ended.  A state is as long as the backlog of its
conversation, a batch of arrivals comes in portions, and releases leave in
portions.  A conversation is the unit of order, so its narrow rows meet in one
task of each batch.

Defined results: rows without a turn are dropped; null roles and texts are empty;
rows without a conversation id form a conversation of their own; of a turn's rows
in one batch only the smallest payload (``role|text`` in UTF-8 bytes, then role)
arrives; no rows give no events; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from .exact import STATE
from .store import fresh_dir, small_batches

RELEASE, REJECT, CLOSE = "release", "reject", "close"
#: Events that leave a conversation's task at a time.
PORTION = 20_000
#: Without data there is no micro-batch: every start has exactly one.
STREAM = STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def payload(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit("|"), text)


def write_arrivals(arrivals: DataFrame, batches: int) -> str:
    """The folder with one folder for each batch and one more, the end.  Each holds
    at least a row without a turn, so that an empty batch too starts the query."""
    spark = arrivals.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = arrivals.where("turn is not null").select("conv", F.col("turn").cast("bigint").alias("turn"), F.col("batch").cast("int").alias("batch"), role.alias("role"), text.alias("text"))
    least = rows.groupBy("batch", "conv", "turn").agg(F.min(F.struct(payload(F.col("role"), F.col("text")).alias("payload"), "role")).alias("p"))
    first = rows.groupBy(F.col("conv").alias("of")).agg(F.min("turn").alias("first"))
    told = least.join(first, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "turn", "first", "p.role", F.expr("substr(p.payload, length(p.role) + 2)").alias("text"), "batch")
    ticks = spark.range(batches + 1).select(*[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in told.columns[:-1]], F.col("id").cast("int").alias("batch"))
    root = fresh_dir(spark, "turns")
    told.unionByName(ticks).hint("rebalance", "batch").write.partitionBy("batch").parquet(root)
    return root


class Talk:
    """A conversation between two batches."""

    COLUMNS = "first bigint, next bigint, breaks bigint, role string, heap string, arrived int, closed boolean"

    def __init__(self, state: GroupState):
        if state.exists:
            self.first, self.next, self.breaks, self.role, heap, self.arrived, self.closed = state.get
            self.heap = json.loads(heap)
        else:
            self.first = self.next = self.role = self.arrived = None
            self.breaks, self.heap, self.closed = 0, [], False
        self.held = {turn for turn, _, _ in self.heap}

    def save(self, state: GroupState) -> None:
        state.update((self.first, self.next, self.breaks, self.role, json.dumps(self.heap), self.arrived, self.closed))
        if not self.closed:
            state.setTimeoutDuration(1)

    def keep(self, turn: int, role: str, batch: int) -> None:
        if turn >= self.next and turn not in self.held:
            heapq.heappush(self.heap, [turn, role, batch])
            self.held.add(turn)

    def release(self) -> Iterator[tuple[int, int]]:
        """(turn, batch of its arrival) of the gapless run."""
        while self.heap and self.heap[0][0] == self.next:
            turn, role, batch = heapq.heappop(self.heap)
            self.held.discard(turn)
            self.breaks += role == self.role
            self.role, self.next = role, turn + 1
            yield turn, batch

    def close(self) -> tuple[int, int, list[int]]:
        """(turns that are missing, turns that repeat the role before, unreleased turns)."""
        left = sorted(self.heap)
        largest = left[-1][0] if left else self.next - 1
        missing = largest + 1 - self.next - len(left)
        breaks = self.breaks + sum(a[0] + 1 == b[0] and a[1] == b[1] for a, b in zip(left, left[1:], strict=False))
        self.heap, self.held, self.role, self.closed = [], set(), None, True
        return missing, breaks, [turn for turn, _, _ in left]


EVENT = ["conv", "event", "turn", "batch", "kept_batch", "n_missing", "n_breaks", "unreleased"]


def _events(rows: list[tuple]) -> pd.DataFrame:
    # numbers stay whole: a column with a missing one would turn into floats
    whole = {"turn", "batch", "kept_batch", "n_missing", "n_breaks"}
    return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in whole else list(v) for c, v in zip(EVENT, zip(*rows, strict=True), strict=True)})


def advance(batch: int, end: int, patience: int) -> Callable:
    """What one start does with a conversation: ``batch`` is its number."""

    def step(key: tuple, arriving: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        talk, conv, out = Talk(state), None if pd.isna(key[0]) else key[0], []
        if not state.hasTimedOut:
            for rows in arriving:
                for turn, first, role in zip(rows["turn"].tolist(), rows["first"].tolist(), rows["role"].tolist(), strict=True):
                    if talk.closed:
                        out.append((conv, REJECT, turn, batch, batch, None, None, None))
                        continue
                    if talk.first is None:
                        talk.first = talk.next = first
                    talk.keep(turn, role, batch)
                    talk.arrived = batch
                for turn, kept in talk.release():
                    out.append((conv, RELEASE, turn, batch, kept, None, None, None))
                    if len(out) >= PORTION:
                        yield _events(out)
                        out = []
                if len(out) >= PORTION:
                    yield _events(out)
                    out = []
        elif batch == end or batch - talk.arrived >= patience:
            missing, breaks, unreleased = talk.close()
            out.append((conv, CLOSE, None, batch, None, missing, breaks, unreleased))
        talk.save(state)
        if out:
            yield _events(out)

    return step


def feed(spark, root: str, conv_type: str, batches: int, patience: int) -> DataFrame:
    """Starts the query once for each batch and once for the end; their events."""
    told = StructType.fromDDL(f"conv {conv_type}, turn bigint, first bigint, role string")
    events = StructType.fromDDL(f"conv {conv_type}, event string, turn bigint, batch bigint, kept_batch bigint, n_missing bigint, n_breaks bigint, unreleased array<bigint>")
    state, out = f"{root}-state", f"{root}-events"
    before = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        for batch in range(batches + 1):
            # the folders of the batches so far: files of earlier starts are known to the checkpoint
            folders = ",".join(map(str, range(batch + 1)))
            arriving = spark.readStream.schema(told).parquet(f"{root}/batch={{{folders}}}").where("turn is not null")
            stepped = arriving.groupBy("conv").applyInPandasWithState(advance(batch, batches, patience), events, StructType.fromDDL(Talk.COLUMNS), "append", GroupStateTimeout.ProcessingTimeTimeout)
            query = stepped.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(events).parquet(out)


def reassemble(arrivals: DataFrame, batches: int, patience: int = 3) -> DataFrame:
    """``arrivals``: conv, turn, role, text and batch (0 to ``batches`` - 1).

    Of a turn the earliest arrival is kept; each batch releases the gapless run of
    kept turns from the conversation's smallest turn; ``patience`` batches in a row
    without arrivals close a conversation in the last of them, the end (batch
    number ``batches``) closes the others; what arrives after closing is rejected.

    Events: conv, event, turn, batch, kept_batch (when the turn arrived), role and
    text of released and rejected turns, and for ``close`` n_missing, n_breaks and
    ``unreleased`` turn numbers, ascending."""
    spark = arrivals.sparkSession
    small_batches(spark)
    root = write_arrivals(arrivals, batches)
    conv_type = arrivals.schema["conv"].dataType.simpleString()
    events = feed(spark, root, conv_type, batches, patience)
    told = StructType.fromDDL(f"conv {conv_type}, turn bigint, role string, text string, batch int")
    texts = spark.read.schema(told).parquet(root).where("turn is not null").select(F.col("conv").alias("of"), F.col("turn").alias("at"), F.col("batch").alias("kept_batch"), "role", "text")
    on = events["conv"].eqNullSafe(texts["of"]) & (events["turn"] == texts["at"]) & (events["kept_batch"] == texts["kept_batch"])
    return events.join(texts, on, "left").select("conv", "event", "turn", "batch", events["kept_batch"], "role", "text", "n_missing", "n_breaks", "unreleased")
