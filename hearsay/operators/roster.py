"""Rosters, rooms, eras, sessions and summaries around a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import era_label, pacific_to_utc, roster_timestamp, slug, vendor
from .facts import seconds_between
from .scan import ranged, ranks
from .windows import batches, era_join, in_any_window, latest_versions, window_gaps, window_join

# The names a roster field goes by, best first.
FIELDS = {
    "goal_id": ("id", "goal_id"), "agent_id": ("agent_id",), "role": ("short_name", "role", "name"), "goal": ("name", "goal", "title"), "detail": ("description", "detail"),
    "start": ("start_time", "start"), "end": ("end_time", "end"), "created": ("created_at", "created"), "updated": ("updated_at", "updated"),
}


def pick(df: DataFrame, names: tuple[str, ...]):
    """The first non-empty of several columns, as text."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def normalize(rows: DataFrame) -> DataFrame:
    """Roster rows under canonical names, with slug roles and creation batches."""
    plain = rows.select(*[pick(rows, names).alias(c) for c, names in FIELDS.items()]).where("agent_id is not null")
    for c in ("start", "end", "created", "updated"):
        plain = plain.withColumn(c, roster_timestamp(F.col(c)))
    return batches(plain.withColumn("role", slug(F.col("role"))))


def timestamp_issues(rows: DataFrame) -> DataFrame:
    """Per time field: non-empty values that are no point in time, with examples."""
    out = None
    for field in ("start", "end", "created", "updated"):
        raw = pick(rows, FIELDS[field])
        bad = rows.select(raw.alias("raw")).where(F.col("raw").isNotNull() & roster_timestamp(F.col("raw")).isNull())
        part = bad.agg(F.lit(field).alias("field"), F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("raw")), 1, 3).alias("examples"))
        out = part if out is None else out.unionByName(part)
    return out


def by_role(goals: DataFrame) -> DataFrame:
    return goals.groupBy("role").agg(F.count(F.lit(1)).alias("goals"), F.countDistinct("agent_id").alias("agents"), F.count_if(F.col("end").isNull()).alias("open"))


def by_batch(goals: DataFrame) -> DataFrame:
    return goals.groupBy("batch").agg(F.count(F.lit(1)).alias("goals"), F.countDistinct("agent_id").alias("agents"), F.sort_array(F.collect_set("role")).alias("roles"))


def match_events(events: DataFrame, goals: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(event_id, roster_agent): the alternative author name before the raw one;
    each as an agent id, then an alias, then a role that only one agent has."""
    ids = goals.select(F.col("agent_id").alias("name"), F.col("agent_id").alias("agent")).distinct()
    roles = goals.groupBy("role").agg(F.countDistinct("agent_id").alias("k"), F.min("agent_id").alias("agent")).where("k = 1").select(F.col("role").alias("name"), "agent")
    out = events.select("event_id", "author_alt", "author_raw")
    found = []
    for c in ("author_alt", "author_raw"):
        out = out.join(ids.withColumnRenamed("agent", f"{c}_id"), F.col(c) == F.col("name"), "left").drop("name")
        named = F.lit(None).cast("string")
        for alias, agent in (aliases or {}).items():
            named = F.when(F.lower(F.col(c)) == alias.lower(), agent).otherwise(named)
        out = out.withColumn(f"{c}_alias", named)
        out = out.join(roles.withColumnRenamed("agent", f"{c}_role"), slug(F.col(c)) == F.col("name"), "left").drop("name")
        found += [f"{c}_id", f"{c}_alias", f"{c}_role"]
    return out.select("event_id", F.coalesce(*found).alias("roster_agent"))


def annotate(events: DataFrame, goals: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Each event with its roster agent and the goal in force, or the nearest one."""
    named = events.select("event_id", "ts").join(match_events(events, goals, aliases), "event_id")
    windows = goals.withColumnRenamed("agent_id", "roster_agent")
    held = window_join(named, windows, "roster_agent", "goal_id")
    return named.select("event_id", "roster_agent").join(held, "event_id", "left").join(goals.select("goal_id", "role", "batch"), "goal_id", "left").select("event_id", "roster_agent", "role", "goal_id", "batch", "in_window")


def merge_agents(agents: DataFrame, events: DataFrame, annotated: DataFrame) -> DataFrame:
    """Authors that the roster knows take their modal roster agent as merged id and
    its batch as cohort; ties go to the one met first."""
    rows = events.select("event_id", "ts", "author_raw").join(annotated.where("roster_agent is not null"), "event_id")
    n = rows.groupBy("author_raw", "roster_agent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"), F.max_by("batch", F.struct("ts", "event_id")).alias("batch"))
    best = n.groupBy("author_raw").agg(F.min_by(F.struct("roster_agent", "batch"), F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    out = agents.drop("roster_agent").join(best, "author_raw", "left")
    return out.select("author_raw", "agent_strict", F.coalesce("b.roster_agent", "agent_merged").alias("agent_merged"), F.coalesce(F.nullif("b.batch", F.lit("")), "cohort").alias("cohort"), "n_events", F.col("b.roster_agent").alias("roster_agent"))


def coverage(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count(F.lit(1)).alias("posts"), F.count("roster_agent").alias("matched"), F.count_if(F.col("in_window")).alias("in_window"))


def coverage_of(events: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row: posts and authors, those the roster knows, its posts outside of a goal's window,
    and the goals that have posts."""
    hit = F.col("roster_agent").isNotNull()
    rows = events.select("event_id", "author_raw").join(annotated.select("event_id", "roster_agent", "goal_id", "in_window"), "event_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(hit).alias("posts_matched"), F.countDistinct("author_raw").alias("authors"), F.countDistinct(F.when(hit, F.col("author_raw"))).alias("authors_matched"),
        F.count_if(hit & ~F.coalesce("in_window", F.lit(False))).alias("posts_outside_window"), F.countDistinct(F.when(hit, F.col("goal_id"))).alias("goals_with_posts"),
    )


def unmatched_authors(events: DataFrame, annotated: DataFrame) -> DataFrame:
    """Authors of posts that the roster does not know, with those posts."""
    known = annotated.where("roster_agent is not null").select("event_id")
    return events.where("author_raw is not null").join(known, "event_id", "left_anti").groupBy("author_raw").agg(F.count(F.lit(1)).alias("posts"))


# ------------------------------------------------------------------ rooms


def restricted(channels: DataFrame) -> DataFrame:
    return channels.where("size(allow) > 0 or size(deny) > 0")


def audience(channels: DataFrame, agents: DataFrame) -> DataFrame:
    """(channel, agent) pairs of restricted channels: the allowed - all, if only a
    deny list stands - without the denied.  ``agents``: agent."""
    r = restricted(channels)
    allowed = r.select("channel", F.explode("allow").alias("agent"))
    everyone = r.where("size(allow) = 0").select("channel").join(agents.select("agent").distinct(), how="cross")  # rooms with a deny list only
    denied = r.select("channel", F.explode("deny").alias("agent"))
    return allowed.unionByName(everyone).distinct().join(denied, ["channel", "agent"], "left_anti").select("channel", "agent")


def directory(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("agent_id"), "name", F.col("model_string").alias("model"), vendor(F.col("model_string")).alias("vendor"), roster_timestamp(pick(rows, ("created_at", "joined"))).alias("joined"), roster_timestamp(pick(rows, ("last_seen_at", "updated_at"))).alias("last_seen"), pick(rows, ("is_participating", "participating")).cast("boolean").alias("participating"))


def eras(rows: DataFrame) -> DataFrame:
    """Shared goals in order of their start, with short labels."""
    e = rows.select(pick(rows, ("id",)).alias("era_id"), pick(rows, ("goal", "name")).alias("goal"), *[roster_timestamp(pick(rows, names)).alias(c) for c, names in (("start", ("start_time", "start")), ("end", ("end_time", "end")), ("created", ("created_at",)), ("updated", ("updated_at",)))]).where("goal is not null")
    order = ["start", "era_id"]
    return ranks(ranged(e, order), "n", order).withColumn("label", era_label(F.col("n"), F.col("goal"))).select(*e.columns, "label")


def annotate_eras(events: DataFrame, e: DataFrame, bucket_s: int = 86400) -> DataFrame:
    held = era_join(events, e, bucket_s)
    return held.join(e.select("era_id", F.col("label").alias("era")), "era_id", "left").select("event_id", "era_id", "era")


def eras_summary(e: DataFrame, cut=None) -> DataFrame:
    end = F.coalesce("end", F.lit(cut).cast("timestamp")) if cut is not None else F.col("end")
    gaps = window_gaps(e.withColumn("all", F.lit(0)), ["all"], "era_id").agg(F.count_if(F.col("diff_s") > 60).alias("n_gaps"), F.count_if(F.col("diff_s") < -60).alias("n_overlaps"))
    days = seconds_between(end, F.col("start")) / 86400
    top = e.agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"), F.count_if(F.col("end").isNull()).alias("n_open"), F.median(days).alias("median_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"))
    return top.join(gaps, how="cross")  # one row each


def era_handover(e: DataFrame, goals: DataFrame) -> DataFrame:
    """The last shared goal, if the first own goal starts within an hour of it; else no row."""
    last = e.orderBy(F.col("start").desc_nulls_first(), F.desc("era_id")).limit(1).select("label", "goal", "start")
    own = goals.agg(F.min("start").alias("roster_start"))
    return last.join(own, how="cross").withColumn("offset_s", seconds_between(F.col("roster_start"), F.col("start"))).where("abs(offset_s) <= 3600")  # one row each


def posts_by_era(e: DataFrame, annotated: DataFrame) -> DataFrame:
    """Posts of every era, and those outside all of them under a null label."""
    n = annotated.groupBy("era").agg(F.count(F.lit(1)).alias("posts"))
    known = e.select("label", "start").join(n, F.col("label") == F.col("era"), "left").select("label", "start", F.coalesce("posts", F.lit(0)).alias("posts"))
    return known.unionByName(annotated.where("era is null").agg(F.count(F.lit(1)).alias("posts")).select(F.lit(None).cast("string").alias("label"), F.lit(None).cast("timestamp").alias("start"), "posts"))


def activity_by_agent(activity: DataFrame) -> DataFrame:
    return activity.groupBy("agent_id").agg(F.count(F.lit(1)).alias("sessions"), F.avg((F.weekday("ts") >= 5).cast("int")).alias("weekend_share"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def session_ids(activity: DataFrame) -> DataFrame:
    """Per agent: starts in the log and different session ids among them."""
    return activity.groupBy("agent_id").agg(F.count(F.lit(1)).alias("starts"), F.countDistinct("ref").alias("session_ids"))


def busy_hours(activity: DataFrame, share: float = 0.25) -> DataFrame:
    """Hours of the day with at least a quarter of the busiest hour's sessions."""
    h = activity.where("ts is not null").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("most", F.max("n").over(W.partitionBy())).where(F.col("n") >= share * F.col("most")).drop("most")


def sessions_in_goals(activity: DataFrame, goals: DataFrame) -> DataFrame:
    return in_any_window(activity, goals, "agent_id")


def activity_in_goals(activity: DataFrame, goals: DataFrame) -> DataFrame:
    """Agents of the log that the roster knows, and sessions within a goal of theirs."""
    known = activity.join(goals.select("agent_id").distinct(), "agent_id", "left_semi").agg(F.countDistinct("agent_id").alias("agents_in_roster"))
    return known.join(sessions_in_goals(activity, goals).agg(F.count(F.lit(1)).alias("rows_in_goal_window")), how="cross")  # one row each


def activity_in_transcript(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Agents of the log that post: by id, or by name in any case."""
    authors = events.select(F.lower("author_raw").alias("author")).union(events.select("author_alt")).where("author is not null").distinct()
    ids = activity.groupBy("agent_id").agg(F.min("agent_name").alias("name"))
    names = ids.select("agent_id", F.explode(F.array_compact(F.array("agent_id", F.lower("name")))).alias("author"))
    return names.join(authors, "author", "left_semi").agg(F.countDistinct("agent_id").alias("agents_in_transcript"))


# ------------------------------------------------------------------ summaries

EVENT_LINE = r"(?m)^\s*\d+\.\s*\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?)\s*(PT|PST|PDT|UTC)?\]\s*(.+?)\s*$"
STAMP = r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?)\s*(PT|PST|PDT|UTC)?\]"
BULLET = r"(?m)^\s*[-*•]\s+(.*\S)\s*$"
QUOTE = r"(?s)<quote[^>]*>(.*?)</quote>"


def summaries(rows: DataFrame) -> DataFrame:
    target = F.col("summary_target").cast("string")
    s = rows.where("content is not null and content <> ''").select(
        F.col("id").cast("string").alias("summary_id"), F.coalesce(F.col("type"), F.lit("")).alias("type"), target.alias("target"), roster_timestamp(pick(rows, ("summary_date",))).alias("date"),
        F.when(target.rlike(r"^\d+$"), target.cast("int")).alias("day"), pick(rows, ("generated_by",)).alias("generated_by"), roster_timestamp(pick(rows, ("created_at",))).alias("created"), roster_timestamp(pick(rows, ("updated_at",))).alias("updated"),
        F.size(F.regexp_extract_all("content", F.lit(EVENT_LINE), F.lit(0))).alias("n_events"), F.length("content").alias("chars"), "content",
    )
    key = s.withColumn("__target", F.coalesce("target", F.lit(""))).withColumn("__day", F.coalesce(F.to_date("date").cast("string"), F.lit("")))
    return latest_versions(key, ["type", "__target", "__day"], "created", "summary_id").drop("__target", "__day")


def parse_digest(s: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Timestamped lines of the latest summaries: numbered events, else bullets
    with a stamp, and quotes; the actor is the longest name the line begins with."""
    live = s.where("latest").withColumn("body", F.regexp_replace("content", QUOTE, " "))
    daily = F.col("type") == "daily"
    numbered = F.transform(F.regexp_extract_all("body", F.lit(EVENT_LINE), F.lit(0)), lambda x: F.struct(F.lit("event").alias("kind"), F.regexp_extract(x, EVENT_LINE, 1).alias("stamp"), F.regexp_extract(x, EVENT_LINE, 2).alias("tz"), F.regexp_extract(x, EVENT_LINE, 3).alias("text")))
    stamped = lambda kind, x, text: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x, STAMP, 1).alias("stamp"), F.regexp_extract(x, STAMP, 2).alias("tz"), text.alias("text"))
    notes = F.transform(F.filter(F.regexp_extract_all("body", F.lit(BULLET), F.lit(1)), lambda x: F.rlike(x, F.lit(STAMP))), lambda x: stamped("note", x, x))
    quotes = F.transform(F.filter(F.regexp_extract_all("content", F.lit(QUOTE), F.lit(1)), lambda x: F.rlike(x, F.lit(STAMP))), lambda x: stamped("quote", x, F.trim(F.regexp_replace(x, STAMP, ""))))
    none = F.array().cast("array<struct<kind:string,stamp:string,tz:string,text:string>>")
    rows = F.concat(F.when(daily & (F.size(numbered) > 0), numbered).when(daily, notes).otherwise(none), quotes)
    d = live.select("summary_id", "day", "generated_by", F.posexplode(rows).alias("i", "r")).select(F.concat_ws(":", "summary_id", "i").alias("event_id"), "r.*", "summary_id", "day", "generated_by")
    local = F.coalesce(F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm")))
    d = d.withColumn("ts", F.when(F.col("tz") == "UTC", local).otherwise(pacific_to_utc(local))).drop("stamp", "tz")
    if people is None:
        return d.withColumn("actor", F.lit(None).cast("string")).withColumn("actor_id", F.lit(None).cast("string"))
    lead = F.regexp_replace(F.regexp_replace("text", STAMP, ""), r"""^[*_"' :\-]+""", "")
    named = d.withColumn("lead", lead)
    names = people.select(F.col("name").alias("n"), F.col("agent_id").alias("a"))
    # a directory of agents against lines that begin with a name of it
    hit = named.join(names, F.startswith("lead", F.col("n")) & ~F.rlike(F.substr("lead", F.length("n") + 1, F.lit(1)), F.lit(r"(?U)[^\W_]")), "left")
    best = hit.groupBy(*d.columns).agg(F.max_by(F.struct("n", "a"), F.length("n")).alias("b"))
    return best.select(*d.columns, F.col("b.n").alias("actor"), F.col("b.a").alias("actor_id"))


def digest_to_events(digest: DataFrame) -> DataFrame:
    return digest.where("ts is not null").select(
        F.concat(F.lit("digest:"), "event_id").alias("event_id"), "ts", F.lit("digest").alias("channel"), F.coalesce("actor", F.lit("narrator")).alias("author_raw"), F.coalesce("actor_id", F.lit("")).alias("author_alt"), "text",
        F.col("summary_id").alias("parent_id"), F.lit("").alias("channel_family"), F.col("event_id").alias("source_ref"), F.lit("summaries").alias("site"), F.concat(F.lit("digest_"), "kind").alias("source_kind"),
    )


def summaries_summary(s: DataFrame, digest: DataFrame) -> DataFrame:
    a = s.agg(F.count(F.lit(1)).alias("n"), F.count_if("latest").alias("n_latest"), F.countDistinct("generated_by").alias("generators"))
    b = digest.agg(F.count(F.lit(1)).alias("n_events"), F.count("actor").alias("n_named"), F.countDistinct("actor").alias("n_actors"), F.count_if(F.col("ts").isNull()).alias("n_bad_ts"))
    return a.join(b, how="cross")  # one row each


def summaries_daily(s: DataFrame) -> DataFrame:
    """Latest daily summaries: their number, dates and days."""
    return s.where("latest and type = 'daily'").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("day").alias("day_first"), F.max("day").alias("day_last"))


def counted(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def summary_spans(summaries: DataFrame, digest: DataFrame) -> DataFrame:
    """One row: when summaries were written, and the time that their digest covers."""
    a = summaries.agg(F.min("created").alias("first_created"), F.max("created").alias("last_created"))
    return a.join(digest.agg(F.min("ts").alias("first_entry"), F.max("ts").alias("last_entry"), F.count_if(F.col("ts").isNull()).alias("n_bad_ts")), how="cross")  # one row each
