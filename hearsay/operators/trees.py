"""Record trees: roots, fan-out, orphans, depth, tags and placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER, placeholder_category
from ..store import checkpoint


def edges(records: DataFrame) -> DataFrame:
    """(id, parent, orphan): a parent that does not exist makes an orphan."""
    ids = records.select(F.col("id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    joined = records.select("id", "parent_id").join(ids, "parent_id", "left")
    return joined.select("id", F.when(F.col("there"), F.col("parent_id")).alias("parent"), (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("orphan"))


def depths(tree: DataFrame, cap: int = 64) -> DataFrame:
    """(id, depth) by pointer doubling: about log2(depth) joins.  Nodes on or
    behind a cycle, or deeper than ``cap``, stop there."""
    step = checkpoint(tree.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("depth")))
    reach = 1
    while reach <= cap and not step.where("up is not null").isEmpty():
        above = step.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = checkpoint(step.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        reach *= 2
    return step.select("id", F.least("depth", F.lit(cap)).alias("depth"))


def tree_summary(records: DataFrame, cap: int = 64) -> DataFrame:
    t = checkpoint(edges(records))
    fan = t.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_fan_out"))
    deep = depths(t, cap).agg(F.max("depth").alias("max_depth"))
    top = t.agg(F.count_if(F.col("parent").isNull() & ~F.col("orphan")).alias("roots"), F.count("parent").alias("children"), F.count_if(F.col("orphan")).alias("orphans"))
    return top.join(deep, how="cross").join(fan, how="cross")  # one row each


def fan_out(tree: DataFrame, last: int = 10) -> DataFrame:
    n = tree.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    return n.groupBy(F.least("children", F.lit(last)).alias("children")).agg(F.count(F.lit(1)).alias("parents"))


def kinds(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_chars"))


def tag_families(records: DataFrame, tags: str = "tags", limit: int = 15) -> DataFrame:
    """The report's most frequent first tags."""
    family = F.nullif(F.trim(F.split_part(F.col(tags), F.lit(";"), F.lit(1))), F.lit("")).alias("family")
    return records.select(family).where("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "family").limit(limit)


def text_repeats(records: DataFrame, text: str = "text") -> DataFrame:
    return records.agg(F.count(text).alias("texts"), F.countDistinct(text).alias("distinct_texts")).withColumn("repeated_texts", F.col("texts") - F.col("distinct_texts"))


def placeholders(records: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    found = records.select(key, F.explode(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))).alias("tok")).withColumn("category", placeholder_category(F.col("tok")))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(key).alias("records"))


def integrity(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("n"), (F.count("id") == F.countDistinct("id")).alias("ids_unique"), (F.count("cite") == F.countDistinct("cite")).alias("cites_unique"),
        F.count_if(F.startswith("id", F.col("cite"))).alias("prefix_matches"),
    )
