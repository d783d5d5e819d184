"""The place behind a transcript: opening hours, rooms, access and people.

Opening hours are weekly windows on a wall clock.  They become a table of UTC
intervals over the days that the posts span, and posts outside are an interval
anti-join against it.  Open rooms live until the export's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hour_of, roster_timestamp
from .facts import seconds_between
from .roster import restricted
from .windows import era_join

# The days of a week in order.
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
WINDOWS = "array<struct<days:array<string>,start:string,end:string>>"


def schedule(rows: DataFrame) -> DataFrame:
    """days, start, end of each weekly window; ``rows``: place rows with a ``schedule``
    of windows, as a struct or as JSON text."""
    w = rows.where("id is not null").limit(1)
    text = F.col("schedule") if dict(rows.dtypes)["schedule"] == "string" else F.to_json("schedule")
    found = F.from_json(text, f"windows {WINDOWS}")["windows"]
    out = w.select(F.posexplode(found).alias("n", "w")).select("n", F.transform("w.days", lambda d: F.substring(F.lower(d), 1, 3)).alias("days"), "w.start", "w.end")
    return out.where("days is not null")


def open_hours(windows: DataFrame) -> DataFrame:
    """One row: hours a week, windows that end before they start count as none."""
    h = F.greatest(F.lit(0.0), hour_of(F.col("end")) - hour_of(F.col("start"))) * F.size("days")
    return windows.agg(F.coalesce(F.sum(h), F.lit(0.0)).alias("open_hours_per_week"))


def place(rows: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """One row: id, name, created, cut (the export's), whether its chat is open, who holds the
    turn, and the goal that its own field still names."""
    have = set(rows.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    one = rows.where("id is not null").limit(1).select(
        col("id").alias("place_id"), F.coalesce(col("name"), col("slug"), col("id")).alias("name"), roster_timestamp(col("created_at")).alias("created"), roster_timestamp(col("updated_at")).alias("cut"),
        col("is_chat_open").cast("boolean").alias("chat_open"), col("active_agent_id").alias("active_agent_id"), F.nullif(F.trim(col("village_goal")), F.lit("")).alias("legacy_goal"),
    )
    if directory is None:
        return one.withColumn("active_agent", F.lit(None).cast("string"))
    return one.join(directory.select(F.col("agent_id").alias("active_agent_id"), F.col("name").alias("active_agent")), "active_agent_id", "left").select(*one.columns, "active_agent")


def open_intervals(windows: DataFrame, zone: str, first, last) -> DataFrame:
    """UTC intervals [start, end) in which the place is open, from the day before ``first`` to
    the day after ``last``: one row for each window and day."""
    days = windows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(first).cast("date"), 1), F.date_add(F.lit(last).cast("date"), 1))).alias("day"))
    days = days.withColumn("name", F.element_at(F.array(*map(F.lit, DAYS)), F.weekday("day") + 1))
    daily = windows.select("n", F.explode("days").alias("name"), hour_of(F.col("start")).alias("a"), hour_of(F.col("end")).alias("b")).where("a < b")
    at = lambda h: F.to_utc_timestamp(F.timestamp_micros((F.unix_date("day").cast("bigint") * 1440 + F.round(F.col(h) * 60)).cast("bigint") * 60_000_000), zone)
    return days.join(daily, "name").select(F.concat_ws("-", "day", "n").alias("window"), at("a").alias("start"), at("b").alias("end"))


def outside_schedule(events: DataFrame, windows: DataFrame, zone: str) -> DataFrame:
    """Events at whose time the place is closed; those without a time are outside."""
    span = events.agg(F.min("ts"), F.max("ts")).first()
    if span[0] is None:
        return events
    times = events.where("ts is not null").select("ts", F.col("ts").alias("__t")).distinct()
    inside = era_join(times, open_intervals(windows, zone, *span), 86400, "window", "__t").where("window is not null").select(F.col("__t").alias("ts"))
    return events.join(inside, "ts", "left_anti").select(*events.columns)


def access(allow: Column, deny: Column) -> Column:
    only, but = (F.concat(F.lit(w), F.array_join(a, ", ")) for w, a in (("only ", allow), ("all but ", deny)))
    return F.when(F.size(allow) > 0, only).when(F.size(deny) > 0, but).otherwise("everyone")


def rooms(channels: DataFrame, events: DataFrame | None = None, cut: Column | None = None) -> DataFrame:
    """channel, created, deleted, lifetime_h (open rooms: to the cut), access and posts."""
    end = F.col("deleted") if cut is None else F.coalesce("deleted", cut)
    out = channels.select("channel", "created", "deleted", F.round(seconds_between(end, F.col("created")) / 3600, 1).alias("lifetime_h"), access(F.col("allow"), F.col("deny")).alias("access"))
    if events is None:
        return out
    n = events.groupBy("channel").agg(F.count(F.lit(1)).alias("posts"))
    return out.join(n, "channel", "left").withColumn("posts", F.coalesce("posts", F.lit(0)))


def room_totals(channels: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row: rooms, deleted and restricted ones, and the posts in restricted ones."""
    listed = (F.size("allow") > 0) | (F.size("deny") > 0)
    out = channels.agg(F.count(F.lit(1)).alias("n_rooms"), F.count("deleted").alias("n_deleted"), F.count_if(listed).alias("n_restricted"))
    if events is None:
        return out
    inside = events.join(restricted(channels).select("channel").distinct(), "channel", "left_semi").agg(F.count(F.lit(1)).alias("posts_in_restricted"))
    return out.join(inside, how="cross")  # one row each


def unknown_channels(events: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels of posts that the room table does not have, with their posts."""
    n = events.where("channel is not null").groupBy("channel").agg(F.count(F.lit(1)).alias("posts"))
    return n.join(channels.select("channel").distinct(), "channel", "left_anti")


def by_vendor(directory: DataFrame) -> DataFrame:
    """vendor, agents, participating ones, and the short names of their models."""
    short = F.substring_index(F.substring_index("model", "::", -1), "/", -1)
    models = F.array_join(F.array_sort(F.collect_set(short)), ", ")
    return directory.where("vendor is not null").groupBy("vendor").agg(F.count("agent_id").alias("agents"), F.count_if(F.coalesce("participating", F.lit(False))).alias("participating"), models.alias("models"))


def joins_by_month(directory: DataFrame) -> DataFrame:
    return directory.where("joined is not null").groupBy(F.date_format("joined", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("agents"))


# ------------------------------------------------------------------ text of a report


def schedule_text(windows: list[dict]) -> str:
    """'mon–fri 09:00–17:00; sat 10:00–12:00'."""
    parts = []
    for w in windows:
        days = list(w["days"])
        at = DAYS.index(days[0]) if days and days[0] in DAYS else 0
        named = f"{days[0]}–{days[-1]}" if len(days) > 2 and tuple(days) == DAYS[at : at + len(days)] else ", ".join(days)
        parts.append(f"{named} {w['start']}–{w['end']}")
    return "; ".join(parts) or "no windows"


def place_text(s: dict) -> str:
    """The paragraph on the place: export cut, opening hours, posts outside them, turn holder."""
    p = s["place"]
    stamp = lambda t: str(t)[:16] if t else "?"
    out = [f"Village `{p['name']}`, created {stamp(p['created'])} UTC, exported {stamp(p['cut'])} UTC: goals, rooms and windows that are still open are measured to the export."]
    hours = f"Operating schedule: {schedule_text(s['schedule'])} ({s['open_hours_per_week']:.0f} h/week)"
    if "posts_outside_schedule" in s:
        why = " (inferred: the digests stamp their events in Pacific time)" if s.get("schedule_tz_inferred") else ""
        out.append(f"{hours}, read in {s['schedule_tz']}{why}: {s['posts_outside_schedule']:,} of {s['posts']:,} posts fall outside it.")
    elif s.get("schedule_tz"):
        out.append(f"{hours}, timezone {s['schedule_tz']}.")
    else:
        out.append(f"{hours}, timezone not stated in the export (`schedule_tz` in the config checks posts against it).")
    turn = f"At export the turn was held by {p['active_agent']} and chat" if p.get("active_agent") else "At export chat"
    out.append(f"{turn} was {'open' if p.get('chat_open') else 'closed'}.")
    if p.get("legacy_goal"):
        out.append(f"The field `village_goal` still reads \"{p['legacy_goal']}\".")
    return " ".join(out) + "\n"


def rooms_text(t: dict, unknown: list[str]) -> str:
    out = f"Rooms: {t['n_rooms']}, {t['n_deleted']} deleted, {t['n_restricted']} with an allow or deny list; a post there is public to the agents listed only, so exposure is judged per audience."
    if "posts_in_restricted" in t:
        out += f" {t['posts_in_restricted']:,} posts are in restricted rooms"
        out += f"; channels not in the room table: {', '.join(unknown)}." if unknown else "."
    return out + "\n"
