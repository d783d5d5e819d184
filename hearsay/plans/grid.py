"""Least squares on dummies of agents and items, over a grid of blocks of cells.

Cells are dealt by a hash of their agent (``a``) and one of their item (``i``); a block is
one row of arrays, whose cells know the places of their agent and item in the parts ``a``
and ``i``.  Blocks stay where they were first put: in a round only vectors travel, an array
for each part, to the blocks that need it, and as sums of blocks back to their part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written

#: Cells that a block holds about.
CELLS = 500_000
_KINDS = {"ax": "<u4", "ix": "<u4", "n": "<i8", "d": "<f8", "sy": "<f8"}
_NAMES = {"a": "agent", "i": "item"}


def _arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each row with its numbers as arrays."""
    for j in range(batch.num_rows):
        row = {c: batch.column(c)[j] for c in batch.schema.names}
        yield {c: np.frombuffer(v.as_buffer(), _KINDS.get(c, "<f8")) if pa.types.is_binary(v.type) else v.as_py() for c, v in row.items()}


def _mapped(df: DataFrame, change: Callable[[dict], dict], keys: list[str], vectors: list[str] = (), sums: list[str] = ()) -> DataFrame:
    """A row of keys, vectors and single numbers for each row."""

    def run(batches):
        for batch in batches:
            for row in _arrays(batch):
                got = change(row)
                out = [pa.array([row[k]], pa.int32()) for k in keys] + [pa.array([np.asarray(got[v], "<f8").tobytes()], pa.binary()) for v in vectors] + [pa.array([float(got[s])], pa.float64()) for s in sums]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, *vectors, *sums])

    return df.mapInArrow(run, ", ".join([f"{k} int" for k in keys] + [f"{v} binary" for v in vectors] + [f"{s} double" for s in sums]))


def _block(key: tuple, cells: pa.Table) -> pa.Table:
    out = {s: pa.array([k.as_py()], pa.int32()) for s, k in zip("ai", key, strict=True)}
    for side, name in _NAMES.items():
        codes = pa.concat_arrays(cells[name].chunks).dictionary_encode()
        out[name] = pa.ListArray.from_arrays(pa.array([0, len(codes.dictionary)], pa.int32()), codes.dictionary)
        out[f"{side}x"] = pa.array([codes.indices.to_numpy().astype("<u4").tobytes()], pa.binary())
    for c in ("n", "d", "sy"):
        out[c] = pa.array([cells[c].to_numpy().astype(_KINDS[c]).tobytes()], pa.binary())
    return pa.table(out)


def _placed(batches):
    for batch in batches:
        for j in range(batch.num_rows):
            row = {c: batch.column(c)[j] for c in batch.schema.names}
            out = {c: row[c] for c in ("a", "i", "n", "d", "sy")}
            for side, name in _NAMES.items():
                held = row[f"{name}s"].values
                at = pc.index_in(row[name].values, value_set=held).to_numpy()
                out[f"{side}x"] = pa.scalar(at[np.frombuffer(row[f"{side}x"].as_buffer(), "<u4")].astype("<u4").tobytes(), pa.binary())
                out[f"size_{side}"] = pa.scalar(len(held), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([v.as_py()], v.type) for v in out.values()], names=list(out))


class Grid:
    """Blocks of cells (agent, item, d, n, sy) without missing names, kept on disk until ``close``."""

    def __init__(self, cells: DataFrame, n: int, agents: int, items: int):
        blocks = max(1, math.ceil(n / CELLS))
        # vectors travel least when parts of agents and items have one size
        across = min(blocks, agents, max(1, round(math.sqrt(blocks * agents / max(items, 1)))))
        self.parts = {"a": across, "i": math.ceil(blocks / across)}
        kinds = {c: cells.schema[c].dataType.simpleString() for c in _NAMES.values()}
        dealt = cells.select(*[F.pmod(F.xxhash64(name), F.lit(self.parts[s])).cast("int").alias(s) for s, name in _NAMES.items()], "agent", "item", "n", "d", "sy")
        local = written(dealt.groupBy("a", "i").applyInArrow(_block, f"a int, i int, agent array<{kinds['agent']}>, ax binary, item array<{kinds['item']}>, ix binary, n binary, d binary, sy binary"))
        placed = local
        for s, name in _NAMES.items():
            names = local.select(s, F.explode(name).alias("name")).groupBy(s).agg(F.sort_array(F.collect_set("name")).alias(f"{name}s"))
            placed = placed.join(self.spread(names, s), ["a", "i"])
        placed = placed.mapInArrow(_placed, "a int, i int, n binary, d binary, sy binary, ax binary, size_a int, ix binary, size_i int")
        tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
        self.blocks = placed.repartition(tasks, "a", "i").persist(StorageLevel.DISK_ONLY)
        # a join knows how the blocks lie only once they do
        self.blocks.count()

    def close(self) -> None:
        self.blocks.unpersist()

    def spread(self, vectors: DataFrame, side: str) -> DataFrame:
        """A side's vectors for each block of their part."""
        other = "i" if side == "a" else "a"
        return vectors.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(self.parts[other] - 1)))).hint("shuffle_hash")

    def sums(self, side: str, names: list[str], values: Callable[[dict], list], *, mean: bool = False, **vectors: DataFrame) -> DataFrame:
        """(side, names): for each agent or item the sums of ``values`` over its cells, or
        their means by n.  ``a`` and ``i``: vectors that ``values`` reads."""
        rows = self.blocks
        for s, v in vectors.items():
            rows = rows.join(self.spread(v, s), ["a", "i"])
        sent = [*names, "__n"] if mean else names

        def part(row):
            weights = values(row) + ([row["n"]] if mean else [])
            return {k: np.bincount(row[f"{side}x"], w, row[f"size_{side}"]) for k, w in zip(sent, weights, strict=True)}

        def total(batches):
            found: dict[int, list] = {}
            for batch in batches:
                for row in _arrays(batch):
                    mine = found.get(row[side])
                    found[row[side]] = [row[k] if mine is None else mine[j] + row[k] for j, k in enumerate(sent)]
            for key, v in found.items():
                out = [x / v[-1] for x in v[:-1]] if mean else v
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in out]], names=[side, *names])

        return _mapped(rows, part, [side], sent).repartition(self.parts[side], side).mapInArrow(total, f"{side} int, " + ", ".join(f"{k} binary" for k in names))

    def effects(self, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
        """Effects of y and d: (a, ay, ad) and (i, gy, gd), by conjugate gradients on the
        normal equations of the items; a round passes from items to agents and back."""
        means = self.sums("a", ["ay", "ad"], lambda c: [c["sy"], c["n"] * c["d"]], mean=True)
        right = self.sums("i", ["ni", "ry", "rd"], lambda c: [c["n"], c["sy"] - c["n"] * c["ay"][c["ax"]], c["n"] * (c["d"] - c["ad"][c["ax"]])], a=means)
        held = ["ni", *[f"{v}{k}" for k in "yd" for v in "grp"]]
        x = written(_mapped(right, lambda c: c | {f"g{k}": 0 * c["ni"] for k in "yd"} | {f"p{k}": c[f"r{k}"] / c["ni"] for k in "yd"}, ["i"], held))

        def products(c):
            out = dict(c)
            for k in "yd":
                p, r = c[f"p{k}"], c[f"r{k}"]
                q = out[f"q{k}"] = c["ni"] * p - c[f"t{k}"]
                out |= {f"pq{k}": p @ q, f"rr{k}": r @ (r / c["ni"]), f"rq{k}": r @ (q / c["ni"]), f"qq{k}": q @ (q / c["ni"])}
            return out

        def moved(step, turn):
            def change(c):
                out = dict(c)
                for k in "yd":
                    r = out[f"r{k}"] = c[f"r{k}"] - step[k] * c[f"q{k}"]
                    out |= {f"g{k}": c[f"g{k}"] + step[k] * c[f"p{k}"], f"p{k}": r / c["ni"] + turn[k] * c[f"p{k}"]}
                return out

            return change

        dots = [f"{n}{k}" for k in "yd" for n in ("pq", "rr", "rq", "qq")]
        first = None
        for _ in range(rounds):
            through = self.sums("a", ["my", "md"], lambda c: [c["n"] * c[f"p{k}"][c["ix"]] for k in "yd"], mean=True, i=x.select("i", "py", "pd"))
            back = self.sums("i", ["ty", "td"], lambda c: [c["n"] * c[f"m{k}"][c["ax"]] for k in "yd"], a=through)
            x = written(_mapped(x.join(back, "i"), products, ["i"], [*held, "qy", "qd"], dots))
            sums = {s: v or 0.0 for s, v in x.agg(*[F.sum(s).alias(s) for s in dots]).first().asDict().items()}
            first = first or {k: sums[f"rr{k}"] for k in "yd"}
            step, turn, done = {}, {}, True
            for k in "yd":
                live = sums[f"rr{k}"] > tolerance**2 * first[k] and sums[f"pq{k}"] > 0
                step[k] = sums[f"rr{k}"] / sums[f"pq{k}"] if live else 0.0
                left = max(sums[f"rr{k}"] - 2 * step[k] * sums[f"rq{k}"] + step[k] ** 2 * sums[f"qq{k}"], 0.0)
                turn[k] = left / sums[f"rr{k}"] if live else 0.0
                done = done and (not live or left <= tolerance**2 * first[k])
            x = _mapped(x, moved(step, turn), ["i"], held)
            if done:
                break
        g = written(x.select("i", "gy", "gd"))
        own = self.sums("a", ["ay", "ad"], lambda c: [c["sy"] - c["n"] * c["gy"][c["ix"]], c["n"] * (c["d"] - c["gd"][c["ix"]])], mean=True, i=g)
        return written(own), g

    def slope(self, rounds: int, tolerance: float) -> tuple[float, float, float] | None:
        """beta, the sum of squares of d without effects and that of the agents' scores; None if d is all effects."""
        own, g = self.effects(rounds, tolerance)

        def clean(c):
            d = c["d"] - c["ad"][c["ax"]] - c["gd"][c["ix"]]
            return [d * (c["sy"] - c["n"] * (c["ay"][c["ax"]] + c["gy"][c["ix"]])), c["n"] * d * d]

        scores = written(self.sums("a", ["dy", "dd"], clean, a=own, i=g))
        sdy, sdd = _mapped(scores, lambda c: {k: c[k].sum() for k in ("dy", "dd")}, [], [], ["dy", "dd"]).agg(F.sum("dy"), F.sum("dd")).first()
        if not sdd:
            return None
        beta = sdy / sdd
        return beta, sdd, _mapped(scores, lambda c: {"s": ((c["dy"] - beta * c["dd"]) ** 2).sum()}, [], [], ["s"]).agg(F.sum("s")).first()[0]
