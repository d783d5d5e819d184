"""Shards of near equal size by sampled splitters.  DataFrame operations only.

The key is a hash of the text, so equal texts lie next to each other.  A sample of
keys, each row drawn with a chance in proportion to its size, gives the quantile
boundaries of ``RANGES`` ranges; every range is then measured exactly, over all
rows.  A range over ``OVERFULL`` of its share of bytes or rows - a group of copies,
a very long text beside others - is subdivided by a hash of its rows, which is as
even as the rows allow and keeps a group in no single task.  The pieces, of which
there are at most four times ``RANGES`` whatever the input, are dealt to
the shards: largest first, each to the shard with the fewest bytes.  A slot is the
piece's place in its shard plus the row's number in its piece.

So equal texts share a shard unless their range is overfull.

Bounds: ``SAMPLE`` keys are expected in the sample (it chooses boundaries only; all
else is exact), and the pieces that the driver deals and broadcasts.

Defined results: null counts as the empty text, whose size is 1; rows that repeat
an id are rows of their own; fewer rows than shards leave shards empty; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize

RANGES = 4096
SAMPLE = 16 * RANGES
OVERFULL = 2


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, crc, key and row (a number of its own) of every row; written, so that
    each later step sees the same rows."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")


def boundaries(rows: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """Ascending keys at which a range begins, from a sample weighted by size."""
    chance = F.col("size") * F.lit(sample / total)
    # the draw is a hash of the row: the same in every attempt
    draw = (F.xxhash64(F.lit(13), "row", "key").bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    drawn = rows.where(draw < chance)
    # a row larger than its share counts as often as it was expected
    weighted = drawn.select("key", F.greatest(F.lit(1), F.floor(chance)).cast("bigint").alias("weight"))
    counted = sorted((r["key"], r["weight"]) for r in weighted.groupBy("key").agg(F.sum("weight").alias("weight")).collect())
    whole, seen, out = sum(w for _, w in counted), 0, []
    for key, weight in counted:
        if seen * ranges // whole != (seen + weight) * ranges // whole or not out:
            out.append(key)
        seen += weight
    return out


def range_of(key: Column, begins: list[int]) -> Column:
    """How many boundaries lie at or below the key: a binary search."""
    if not begins:
        return F.lit(0)
    steps = [1 << k for k in range(max(len(begins), 1).bit_length() - 1, -1, -1)]
    known = F.lit(begins)
    fits = lambda at: F.when(at <= len(begins), F.get(known, at - 1) <= key).otherwise(F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def deal(pieces: list[tuple], shards: int) -> list[tuple]:
    """(piece ..., shard, slots before it): largest first, to the shard with the fewest bytes,
    then the fewest rows."""
    heap = [(0, 0, s) for s in range(shards)]
    out = []
    for where, salt, size, n in sorted(pieces, key=lambda p: (-p[2], -p[3], p[0], p[1])):
        filled, slots, s = heapq.heappop(heap)
        out.append((where, salt, s, slots))
        heapq.heappush(heap, (filled + size, slots + n, s))
    return out


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: ``id_col``, size, crc, shard and slot."""
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col)
    whole = rows.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    total, n = whole["size"] or 1, whole["n"]
    begins = boundaries(rows, total, ranges, sample) if n else []
    dealt = rows.withColumn("range", range_of(F.col("key"), begins))
    filled = dealt.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # a range over its share is cut into as many pieces as it holds shares
    shares = F.greatest(F.col("size") * ranges / F.lit(total), F.col("n") * ranges / F.lit(max(n, 1)))
    parts = filled.select("range", F.when(shares > OVERFULL, F.ceil(shares).cast("int")).otherwise(1).alias("parts")).where("parts > 1")
    cut = dealt.join(F.broadcast(parts), "range", "left")  # at most ``ranges`` + 1 rows
    salt = F.coalesce(F.pmod(F.xxhash64(F.lit(7), "id", "row"), F.col("parts")).cast("int"), F.lit(0))
    cut = materialize(cut.select("id", "size", "crc", "row", "key", "range", salt.alias("salt")), "shard-pieces")
    pieces = cut.groupBy("range", "salt").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    plan = spark.createDataFrame(deal([(p["range"], p["salt"], p["size"], p["n"]) for p in pieces], shards), "range int, salt int, shard int, before bigint")
    number = F.row_number().over(W.partitionBy("range", "salt").orderBy("key", "id", "row"))
    placed = cut.withColumn("number", number).join(F.broadcast(plan), ["range", "salt"])
    return placed.select(F.col("id").alias(id_col), "size", "crc", "shard", (F.col("before") + F.col("number") - 1).cast("bigint").alias("slot"))
