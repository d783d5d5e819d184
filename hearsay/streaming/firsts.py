"""Streaming counterparts: who carried a fact first, and sessions of deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import FACT


def first_carriers(mentions: DataFrame, agent: str) -> DataFrame:
    """Running first mention per fact and agent; update mode, state without expiry
    (facts never close)."""
    return mentions.groupBy(*FACT, F.col(agent).alias("carrier")).agg(F.min("ts").alias("t"), F.count(F.lit(1)).alias("n"))


def new_mentions(mentions: DataFrame, agent: str, delay: str) -> DataFrame:
    """Each agent's first mention of a fact within the watermark, in append mode."""
    return mentions.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*FACT, agent])


def sweeps(deletes: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of deletions per site.  A gap of exactly ``gap`` joins two
    sessions, as in the batch operator."""
    w = F.session_window("ts", gap)
    return deletes.withWatermark("ts", delay).groupBy(w, "site").agg(F.count(F.lit(1)).alias("n")).select("site", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
