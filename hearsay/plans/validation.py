"""Gold samples and scores of the extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import value_key


def stratified(tagged: DataFrame, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """Half answers, a quarter arrivals, the rest other posts, in hash order."""
    rows = tagged if exclude is None else tagged.join(exclude.select("event_id"), "event_id", "left_anti")
    stratum = F.when(F.col("is_answer"), "answer").when(F.col("is_arrival"), "arrival").otherwise("other")
    quota = {"answer": n // 2, "arrival": n // 4, "other": n - n // 2 - n // 4}
    place = F.row_number().over(W.partitionBy("stratum").orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id"))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("stratum"))
    return rows.withColumn("stratum", stratum).withColumn("place", place).where(F.col("place") <= share).select("event_id", "stratum")


def presence(posts: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    g = gold.select("event_id", F.lit(True).alias("g")).distinct()
    p = predicted.select("event_id", F.lit(True).alias("p")).distinct()
    j = posts.select("event_id").distinct().join(g, "event_id", "left").join(p, "event_id", "left")
    return j.agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull() & F.col("p")).alias("fp"), F.count_if(F.col("g") & F.col("p").isNull()).alias("fn"))


def field_accuracy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Answers of a post match by item, those left by their place; per field the
    share of equal values where not both are missing.  Columns: event_id, i, item,
    value_norm, episode, latency_class."""
    low = lambda c: F.lower(F.trim(c))
    fields = {"item": low(F.col("item")), "value": value_key(F.col("value_norm")), "round": F.col("episode").cast("int").cast("string"), "latency": low(F.col("latency_class"))}
    side = lambda df, s: df.select("event_id", F.col("i").alias(f"{s}_i"), *[c.alias(f"{s}_{n}") for n, c in fields.items()])
    g, p = side(gold, "g"), side(predicted, "p")
    by_item = g.join(p.withColumn("g_item", F.col("p_item")), ["event_id", "g_item"])
    once = by_item.withColumn("rn", F.row_number().over(W.partitionBy("event_id", "g_i").orderBy("p_i"))).where("rn = 1").drop("rn")
    rest = g.join(once.select("event_id", "g_i"), ["event_id", "g_i"], "left_anti").join(p.withColumn("g_i", F.col("p_i")), ["event_id", "g_i"])
    pairs = once.unionByName(rest.select(once.columns))
    out = None
    for n in fields:
        a, b = F.col(f"g_{n}"), F.col(f"p_{n}")
        part = pairs.where(a.isNotNull() | b.isNotNull()).agg(F.lit(n).alias("field"), F.count(F.lit(1)).alias("n"), F.avg(a.eqNullSafe(b).cast("int")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def precision_recall(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
