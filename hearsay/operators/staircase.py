"""The earliest copy that is still open at a time, of all but the asking agent's own.

A copy is open from its time until ``until`` (null: for ever).  Going back in time,
the copies that end after an instant only grow in number, so what an instant needs
- the earliest copy and the earliest one by another carrier - is a running minimum.
Copies (at their end) and questions (at their time) go through one sorted pass; a
copy that is later and ends sooner than another never shows.

The pass is cut into buckets of time, so a hot key spans many of them; a bucket starts
from the two earliest carriers of the copies that end in later buckets or never.  A key
has at most two such rows a bucket, so what a bucket starts from is a small array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _met(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join in which a missing key equals a missing key."""
    there = b.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return a.join(there, on, how).drop(*[f"__j{i}" for i in range(len(keys))])


def first_open(questions: DataFrame, copies: DataFrame, by: Sequence[str], ids: Sequence[str], bucket_s: int = 7 * 86400) -> DataFrame:
    """``questions``: by, ids, agent, at; ``copies``: by, carrier, ts, until.  Returns by, ids
    and ``first_open``: the least ts of the copies of the same key (a missing key equals a
    missing one) with ts < at < until whose carrier is another, or null."""
    by = list(by)
    kinds = {c: questions.schema[c].dataType for c in ids}
    # __k: time, later first
    back = lambda at: -F.unix_micros(at)
    bucket = F.floor(F.col("__k") / F.lit(bucket_s * 1_000_000)).cast("bigint").alias("__bucket")
    held = copies.groupBy(*by, "carrier", "until").agg(F.min("ts").alias("__ts")).select(*by, back("until").alias("__k"), F.col("carrier").alias("__who"), "__ts").select("*", bucket)
    asked = questions.select(*by, back("at").alias("__k"), F.col("agent").alias("__who"), *[F.col(c).alias(f"__{c}") for c in ids]).select("*", bucket)
    # of each bucket the two earliest carriers; copies without an end have no bucket and come before all
    place = [*by, "__bucket"]
    best = held.groupBy(*place, "__who").agg(F.min("__ts").alias("__ts"))
    best = best.withColumn("__n", F.row_number().over(W.partitionBy(*place).orderBy("__ts", "__who"))).where("__n <= 2")
    listed = best.groupBy(*by).agg(F.collect_list(F.struct(F.col("__bucket").alias("b"), F.struct("__ts", "__who").alias("c"))).alias("__all"))
    starts = _met(asked.select(*place).distinct(), listed, by, "inner")
    later = F.transform(F.filter("__all", lambda x: x["b"].isNull() | (x["b"] < F.col("__bucket"))), lambda x: x["c"])
    starts = starts.withColumn("__late", later).withColumn("__first", F.array_min("__late"))
    starts = starts.select(*place, "__first", F.array_min(F.filter("__late", lambda c: c["__who"] != F.col("__first.__who"))).alias("__second"))
    # at one instant questions come first: a copy that ends then is no longer open
    rows = held.where("__bucket is not null").select(*place, "__k", F.lit(1).alias("__side"), "__who", "__ts", *[F.lit(None).cast(t).alias(f"__{c}") for c, t in kinds.items()])
    rows = rows.unionByName(asked.select(*place, "__k", F.lit(0).alias("__side"), "__who", F.lit(None).cast("timestamp").alias("__ts"), *[f"__{c}" for c in ids]))
    rows = _met(rows, starts, place, "left")
    here = W.partitionBy(*place).orderBy("__k", "__side", "__ts", "__who")
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    carrier: Column = F.struct("__ts", "__who")
    rows = rows.withColumn("__lead", F.least(F.min(F.when(F.col("__side") == 1, carrier)).over(so_far), F.col("__first")))
    rows = rows.withColumn("__before", F.coalesce(F.lag("__lead").over(here), F.col("__first")))
    # a run has one leader; who led before it is second when it starts
    rows = rows.withColumn("__new", ~F.col("__lead.__who").eqNullSafe(F.col("__before.__who")))
    rows = rows.withColumn("__run", F.sum(F.col("__new").cast("bigint")).over(so_far))
    run = W.partitionBy(*place, "__run")
    start = F.coalesce(F.max(F.when(F.col("__new"), F.col("__before"))).over(run), F.when(F.col("__run") == 0, F.col("__second")))
    other = F.when((F.col("__side") == 1) & (F.col("__who") != F.col("__lead.__who")), carrier)
    rows = rows.withColumn("__next", F.least(F.min(other).over(run.orderBy("__k", "__side", "__ts", "__who").rowsBetween(W.unboundedPreceding, 0)), start))
    found = F.when(F.col("__lead.__who") == F.col("__who"), F.col("__next.__ts")).otherwise(F.col("__lead.__ts"))
    early = F.when(found < F.timestamp_micros(-F.col("__k")), found)
    return rows.where("__side = 0").select(*by, *[F.col(f"__{c}").alias(c) for c in ids], early.alias("first_open"))
