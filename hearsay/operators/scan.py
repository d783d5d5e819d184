"""Prefix scans over a total order without a window that one task would hold.

Rows are range-partitioned on (keys, order) and written, so a key with a large
share of the rows spans many ranges.  Windows run inside a range; one row per
(range, key) - its sums, its last row - is scanned over the ranges, and joined
back as the range's offset.  Sums, ranks, previous rows and gap runs all come
from these two steps.

``order`` must be total within a key: rows that tie on it may come in any order.
Rows with null keys form a key of their own; nulls of the order come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import checkpoint

RANGE = "__range"


def ranged(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), ranges: int | None = None, write: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """The rows with the number of their range, ascending in (by, order); cut from lineage by
    ``write``, so that every later step sees the same ranges.  ``order`` may be a prefix of the
    order of later steps: rows that tie on it share a range."""
    n = ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write(df.repartitionByRange(n, *by, *order).withColumn(RANGE, F.spark_partition_id()))


def _back(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Offsets joined on (range, keys); a missing key equals a missing key."""
    keys = [RANGE, *by]
    there = offsets.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], *[c for c in offsets.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return rows.join(there, on).drop(*[f"__o{i}" for i in range(len(keys))])


def running(rows: DataFrame, sums: dict[str, Column], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``ranged`` rows under the names given."""
    here = W.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    over = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"__v{i}": v for i, v in enumerate(sums.values())})
    totals = rows.groupBy(RANGE, *by).agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    # one row per range and key; a key that fits a range has one
    offsets = totals.select(RANGE, *by, *[F.sum(f"__t{i}").over(over).alias(f"__b{i}") for i in range(len(sums))])
    out = rows.withColumns({f"__l{i}": F.sum(f"__v{i}").over(here) for i in range(len(sums))})
    out = _back(out, offsets, by)
    add = lambda i: F.when(F.col(f"__l{i}").isNull(), F.col(f"__b{i}")).otherwise(F.col(f"__l{i}") + F.coalesce(F.col(f"__b{i}"), F.lit(0)))
    out = out.withColumns({name: add(i) for i, name in enumerate(sums)})
    return out.drop(*[f"__{x}{i}" for i in range(len(sums)) for x in "vlb"])


def ranks(rows: DataFrame, name: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 within each key."""
    return running(rows, {name: F.lit(1).cast("bigint")}, order, by)


def previous(rows: DataFrame, columns: dict[str, str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns of the row before, in its key, under new names: {new: column}."""
    here = W.partitionBy(RANGE, *by).orderBy(*order)
    over = W.partitionBy(*by).orderBy(RANGE)
    held = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])
    # a column may be null, a row is not: the struct around it tells them apart
    last = rows.groupBy(RANGE, *by).agg(F.max_by(F.struct(held.alias("h")), F.struct(*order)).alias("__last"))
    before = last.select(RANGE, *by, F.lag("__last").over(over).alias("__before"))
    out = rows.withColumn("__here", F.lag(F.struct(held.alias("h"))).over(here))
    out = _back(out, before, by).withColumn("__p", F.coalesce("__here", "__before"))
    return out.withColumns({name: F.col(f"__p.h.c{i}") for i, name in enumerate(columns)}).drop("__here", "__before", "__p")


def previous_in_time(df: DataFrame, columns: dict[str, str], order: Sequence[str], by: Sequence[str], bucket_s: int = 7 * 86400) -> DataFrame:
    """``previous`` for rows whose order begins with a timestamp: buckets of time stand for
    ranges, so nothing is sampled or written first.  A key has one more row a bucket."""
    at = F.floor(F.unix_micros(order[0]) / F.lit(bucket_s * 1_000_000)).cast("bigint")
    rows = df.withColumn(RANGE, at)
    here = W.partitionBy(*by, RANGE).orderBy(*order)
    over = W.partitionBy(*by).orderBy(RANGE)
    held = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])
    last = rows.groupBy(*by, RANGE).agg(F.max_by(F.struct(held.alias("h")), F.struct(*order)).alias("__last"))
    before = last.select(RANGE, *by, F.lag("__last").over(over).alias("__before"))
    out = rows.withColumn("__here", F.lag(F.struct(held.alias("h"))).over(here))
    out = _back(out, before, by).withColumn("__p", F.coalesce("__here", "__before"))
    return out.withColumns({name: F.col(f"__p.h.c{i}") for i, name in enumerate(columns)}).drop("__here", "__before", "__p", RANGE)


def median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact medians of a column, under its own name, and ``n``: values are counted by range,
    and only the one or two in the middle are picked.  A group of nulls alone has none."""
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    rows = ranks(ranged(known, ["__x"], by), "__i", ["__x"], by)
    n = rows.groupBy(RANGE, *by).agg(F.count(F.lit(1)).alias("__n"))
    total = n.groupBy(*by).agg(F.sum("__n").alias("n"))
    keys = {k: f"__g{i}" for i, k in enumerate(by)}
    on = F.lit(True)
    for k, g in keys.items():
        on = on & F.col(k).eqNullSafe(F.col(g))
    middle = (2 * F.col("__i")).between(F.col("n"), F.col("n") + 2)
    return rows.join(total.withColumnsRenamed(keys), on).where(middle).groupBy(*by, "n").agg(F.avg("__x").alias(value))
