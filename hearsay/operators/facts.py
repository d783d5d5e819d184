"""Claims, mentions and the exposure table.

A *fact* is (family, item, value_key).  ``agent`` columns are chosen by the
caller (strict or merged identity); everything is one plan of joins and windows
on the fact key.  Ties are broken by the total order (ts, event_id, start).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import value_key
from .staircase import first_open

FACT = ["family", "item", "value_key"]


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("ts", "event_id", "start", "claim_id") if c in df.columns]


def first_known(value: str, order: list[str]) -> Column:
    """The value of the earliest row that has one."""
    return F.expr(f"min_by({value}, struct({', '.join(order)})) filter (where {value} is not null)")


def fill_episodes(claims: DataFrame, sequences: DataFrame | None = None, min_share: float = 0.6, min_support: int = 3) -> DataFrame:
    """Missing episodes from the modal episode that answers give the item, else
    from learned sequences (family, item, position)."""
    known = claims.where("event_type = 'answer' and episode is not null and item is not null")
    order = _order(claims)
    counts = known.groupBy("family", "item", "episode").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    best = W.partitionBy("family", "item").orderBy(F.desc("n"), "first")
    total = W.partitionBy("family", "item")
    modal = (
        counts.withColumn("total", F.sum("n").over(total)).withColumn("rn", F.row_number().over(best)).where("rn = 1").where((F.col("n") >= min_support) & (F.col("n") / F.col("total") >= min_share)).select("family", "item", F.col("episode").cast("double").alias("modal"))
    )
    out = claims.join(modal, ["family", "item"], "left")
    fill = [F.col("episode").cast("double"), F.col("modal")]
    if sequences is not None:
        out = out.join(sequences.select("family", "item", F.col("position").cast("double").alias("place")), ["family", "item"], "left")
        fill.append(F.col("place"))
    out = out.withColumn("episode", F.when(F.col("item").isNotNull(), F.coalesce(*fill)).otherwise(fill[0]))
    return out.select(*claims.columns)


def agent_rounds(claims: DataFrame, agent: str) -> DataFrame:
    """One row per (agent, family, item): the earliest answer report."""
    a = claims.where((F.col("event_type") == "answer") & F.col("item").isNotNull() & (F.col("family") != "")).withColumnRenamed(agent, "agent")
    order = _order(a)
    return a.groupBy("agent", "family", "item").agg(
        F.min_by("claim_id", F.struct(*order)).alias("claim_id"),
        F.min("ts").alias("t_report"),
        *[first_known(c, order).alias(c) for c in ("episode", "value_norm", "latency_class", "timer_s")],
        F.coalesce(F.bool_or("wrong_flag"), F.lit(False)).alias("wrong_flag"),
        F.coalesce(F.bool_or("correct_flag"), F.lit(False)).alias("correct_flag"),
        F.count(F.lit(1)).alias("n_reports"),
    )


def consensus(claims: DataFrame, mentions: DataFrame | None, agent: str, min_agents: int = 2) -> DataFrame:
    """(family, item, consensus_value): the value most distinct agents stand for;
    ties go to the value seen first.  Facts that several values share without
    ``min_agents`` behind any have none."""
    said = claims.where((F.col("event_type") == "answer") & F.col("value_norm").isNotNull() & ~F.coalesce(F.col("wrong_flag"), F.lit(False)))
    support = said.select(F.col(agent).alias("agent"), "family", "item", value_key(F.col("value_norm")).alias("value_key"), "ts", "event_id")
    if mentions is not None:
        support = support.unionByName(mentions.where("family <> 'url'").select(F.col(agent).alias("agent"), "family", "item", "value_key", "ts", "event_id"))
    support = support.where("value_key is not null and item is not null and family is not null")
    per_agent = support.groupBy("family", "item", "value_key", "agent").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    per_value = per_agent.groupBy("family", "item", "value_key").agg(F.count(F.lit(1)).alias("agents"), F.min("first").alias("first"))
    key = W.partitionBy("family", "item")
    ranked = per_value.withColumn("rn", F.row_number().over(key.orderBy(F.desc("agents"), "first", "value_key"))).withColumn("variants", F.count(F.lit(1)).over(key))
    return ranked.where("rn = 1").where((F.col("agents") >= min_agents) | (F.col("variants") == 1)).select("family", "item", F.col("value_key").alias("consensus_value"))


def top_two(mentions: DataFrame, agent: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per fact (and ``by``) its two earliest distinct carriers: a1, f1, a2, f2, where f is
    (ts, event_id, until).  The first other carrier of any agent is one of them, so exposure is
    an equi-join on one row a fact.  Both steps shrink a hot fact before they shuffle it: first
    mentions by partial aggregation, the two of a fact by partial group limits."""
    until = F.col("visible_until") if "visible_until" in mentions.columns else F.lit(None).cast("timestamp")
    key = [*FACT, *by]
    first = mentions.where("family <> 'url'").groupBy(*key, F.col(agent).alias("carrier")).agg(F.min(F.struct("ts", "event_id", until.alias("until"))).alias("f"))
    ranked = first.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("f.ts", "f.event_id", "carrier"))).where("rn <= 2")
    pick = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    return ranked.groupBy(*key).agg(pick(1, "carrier").alias("a1"), pick(1, "f").alias("f1"), pick(2, "carrier").alias("a2"), pick(2, "f").alias("f2"))


def _other() -> Column:
    """(ts, event_id, until, src) of the earliest mention by another agent, or null."""
    own = F.col("a1") == F.col("agent")
    f, a = F.when(own, F.col("f2")).otherwise(F.col("f1")), F.when(own, F.col("a2")).otherwise(F.col("a1"))
    return F.when(f["ts"].isNotNull(), F.struct(f["ts"].alias("ts"), f["event_id"].alias("event_id"), f["until"].alias("until"), a.alias("src")))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def exposures(rounds: DataFrame, mentions: DataFrame, agreed: DataFrame, agent: str, audience: DataFrame | None = None) -> DataFrame:
    """The exposure table.  ``audience``: (channel, agent) pairs of restricted
    channels; a channel without pairs is public.  Mentions there count only for
    the agents named."""
    r = rounds.join(agreed, ["family", "item"], "left").withColumn("target", F.coalesce(value_key(F.col("value_norm")), F.col("consensus_value")))
    m = mentions.where("family <> 'url' and item is not null and value_key is not null")
    if "visible_until" not in m.columns:
        m = m.withColumn("visible_until", F.lit(None).cast("timestamp"))
    if audience is not None:
        # a restricted channel is a room of its own, all others are one
        rooms = audience.select("channel", F.col("channel").alias("room")).distinct()
        m = m.join(rooms, "channel", "left")
    public = m if audience is None else m.where("room is null")
    two = top_two(public, agent)
    own = m.groupBy(*FACT, F.col(agent).alias("agent")).agg(F.min("ts").alias("t_own"))
    fact = lambda df, key: df.withColumnRenamed("value_key", key)
    closed = None if audience is None else _closed(r, m, agent, audience)

    def before(out: DataFrame, key: str, name: str) -> DataFrame:
        """The earliest copy by another that the agent could read before the report."""
        out = out.join(fact(two, key), ["family", "item", key], "left").withColumn("__o", _other()).drop("a1", "f1", "a2", "f2")
        if closed is not None:
            out = out.join(fact(closed, key), ["family", "item", key, "agent"], "left").withColumn("__o", F.least("__o", "closed")).drop("closed")
        return out.withColumn(name, F.when(F.col("__o.ts") < F.col("t_report"), F.col("__o"))).drop("__o")

    out = before(r, "target", "source")
    out = out.join(fact(own, "target"), ["family", "item", "target", "agent"], "left").withColumn("t_self_prepared", F.when(F.col("t_own") < F.col("t_report"), F.col("t_own"))).drop("t_own")
    out = before(out, "consensus_value", "agreed")
    out = out.withColumns({"t_public": F.col("source.ts"), "src_agent": F.col("source.src"), "src_until": F.col("source.until"), "t_cons": F.col("agreed.ts")})
    out = _visibility(out, m, agent, audience)
    gap = seconds_between(F.col("t_report"), F.col("t_public"))
    gap_c = seconds_between(F.col("t_report"), F.col("t_cons"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    agree = (value_key(F.col("value_norm")) == F.col("consensus_value")).cast("double")
    return out.select(
        "claim_id", "agent", "family", F.col("episode").cast("double").alias("episode"), "item", "value_norm", "t_report", "t_public", "src_agent", "t_self_prepared",
        gap.alias("gap_s"),
        F.col("t_public").isNotNull().cast("int").alias("D"),
        flag(gap >= 600).alias("D_w10m"),
        flag(gap >= 3600).alias("D_w60m"),
        F.col("t_self_prepared").isNotNull().cast("int").alias("self_prepared"),
        F.col("t_cons").isNotNull().cast("int").alias("D_cons"),
        flag(gap_c >= 3600).alias("D_cons_w60m"),
        flag(F.col("latency_class") == "instant").alias("y_instant"),
        F.col("latency_class").isNotNull().cast("int").alias("latency_known"),
        F.when(F.col("correct_flag"), 1.0).when(F.col("wrong_flag"), 0.0).otherwise(agree).alias("y_consensus"),
        "consensus_value", "latency_class", "wrong_flag", "t_public_visible",
        F.col("t_public_visible").isNotNull().cast("int").alias("D_visible"),
        flag(F.col("src_until") <= F.col("t_report")).alias("src_deleted_before_report"),
        F.col("src_until").alias("t_src_deleted"),
        F.concat_ws("|", "family", "item").alias("item_fe"),
    )


def _closed(r: DataFrame, m: DataFrame, agent: str, audience: DataFrame) -> DataFrame:
    """Per agent and fact that it reports or that is agreed on: ``closed``, the earliest copy by
    another in its rooms.  Readers meet rooms, not mentions: a room has one row a fact."""
    wanted = r.select("agent", "family", "item", F.explode(F.array_distinct(F.array("target", "consensus_value"))).alias("value_key")).where("value_key is not null")
    two = top_two(m.where("room is not null"), agent, ("room",))
    mine = wanted.join(audience.select("agent", F.col("channel").alias("room")).distinct(), "agent")
    return mine.join(two, [*FACT, "room"]).groupBy(*FACT, "agent").agg(F.min(_other()).alias("closed"))


def _visibility(r: DataFrame, m: DataFrame, agent: str, audience: DataFrame | None) -> DataFrame:
    """The earliest other copy still visible at report time.  Only facts with a bounded copy
    differ from the earliest copy at all; they are asked for in one sorted pass."""
    m = m if audience is not None else m.withColumn("room", F.lit(None).cast("string"))
    bounded = m.where("visible_until is not null").select(*FACT).distinct()
    copies = m.join(bounded, FACT, "left_semi").select(*FACT, "room", F.col(agent).alias("carrier"), "ts", F.col("visible_until").alias("until"))
    asked = r.where("t_public is not null").select("claim_id", "agent", "family", "item", F.col("target").alias("value_key"), F.col("t_report").alias("at")).join(bounded, FACT, "left_semi")
    places = asked.withColumn("room", F.lit(None).cast("string"))
    if audience is not None:
        held = copies.where("room is not null").select(*FACT, "room").distinct()
        mine = asked.join(audience.select("agent", F.col("channel").alias("room")).distinct(), "agent").join(held, [*FACT, "room"], "left_semi")
        places = places.unionByName(mine)
    seen = first_open(places, copies, [*FACT, "room"], ["claim_id", "agent"])
    key = ["claim_id", "agent", *FACT]
    seen = seen.groupBy(*key).agg(F.min("first_open").alias("vis"), F.lit(True).alias("ranged")).withColumnRenamed("value_key", "target")
    out = r.join(seen, ["claim_id", "agent", "family", "item", "target"], "left")
    return out.withColumn("t_public_visible", F.when(F.col("ranged"), F.col("vis")).otherwise(F.col("t_public"))).drop("vis", "ranged")


def targets(claims: DataFrame) -> DataFrame:
    """(family, item) pairs that someone claimed."""
    return claims.where("item is not null and family <> ''").select("family", "item").distinct()
