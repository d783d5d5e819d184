"""Rooms, opening hours and people on the driver's tables: sales as posts, the
clients' sources as rooms, clients as the directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import micros, query, table
from .functions.text import vendor
from .operators import rooms, roster

#: Room r<k> for each priority; r0 and r1 name who may read them, r2 was deleted, r9 is not listed.
ROOMS = """
ps AS (SELECT sale_id, sold_at AS ts, 'r' || priority AS channel FROM sales),
rm AS (SELECT 'r' || p AS channel, TIMESTAMP '2023-12-01' + to_hours(7 * p) AS created, CASE WHEN p % 3 = 2 THEN TIMESTAMP '2024-02-01' + to_minutes(p) END AS deleted,
  CASE WHEN p = 0 THEN ['a', 'b'] ELSE [] END AS allow, CASE WHEN p = 1 THEN ['c'] WHEN p = 0 THEN ['b'] ELSE [] END AS deny FROM (SELECT DISTINCT priority AS p FROM sales WHERE priority IS NOT NULL AND priority <> 3))
"""
CUT = "TIMESTAMP '2024-05-01'"
#: Opening hours: weekdays, and a Saturday morning whose row is shorter than an hour.
HOURS = [(0, ["mon", "tue", "wed", "thu", "fri"], "09:00", "17:30"), (1, ["sat"], "10:00", "10:45"), (2, ["sun"], "12:00", "11:00")]
ZONE = "America/Los_Angeles"
MODELS = ("claude-x", "models/gpt-4o", "gpt::mini", "o3", "gemini-pro", "house", "openai/o1")


def _posts(spark, d):
    return table(spark, d, "sales").select("sale_id", F.col("sold_at").alias("ts"), F.concat(F.lit("r"), "priority").alias("channel"))


def _channels(spark, d):
    p = F.col("p")
    names = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    shift = lambda day, us: F.timestamp_micros(F.unix_micros(F.lit(day).cast("timestamp")) + us)
    rows = table(spark, d, "sales").where("priority is not null and priority <> 3").select(F.col("priority").cast("bigint").alias("p")).distinct()
    return rows.select(
        F.concat(F.lit("r"), p).alias("channel"), shift("2023-12-01", p * 7 * 3_600_000_000).alias("created"), F.when(p % 3 == 2, shift("2024-02-01", p * 60_000_000)).alias("deleted"),
        F.when(p == 0, names("a", "b")).otherwise(names()).alias("allow"), F.when(p == 1, names("c")).when(p == 0, names("b")).otherwise(names()).alias("deny"),
    )


def _directory(spark, d):
    model = F.get(F.array(*map(F.lit, MODELS)), F.pmod("client_id", F.lit(len(MODELS))).cast("int"))
    c = table(spark, d, "clients").select(F.col("client_id").cast("string").alias("agent_id"), model.alias("model"), F.col("updated_at").alias("joined"), (F.col("balance") > 0).alias("participating"))
    return c.withColumn("vendor", vendor(F.col("model")))


@query(f"""WITH {ROOMS}, n AS (SELECT channel, count(*) AS posts FROM ps GROUP BY 1)
 SELECT channel, epoch_us(created) AS created, epoch_us(deleted) AS deleted, round((epoch_us(coalesce(deleted, {CUT})) - epoch_us(created)) / 3.6e9, 1) AS lifetime_h,
  CASE WHEN len(allow) > 0 THEN 'only ' || array_to_string(allow, ', ') WHEN len(deny) > 0 THEN 'all but ' || array_to_string(deny, ', ') ELSE 'everyone' END AS access, coalesce(posts, 0) AS posts
 FROM rm LEFT JOIN n USING (channel)""")
def room_lifetimes(spark, d):
    out = rooms.rooms(_channels(spark, d), _posts(spark, d), F.lit("2024-05-01").cast("timestamp"))
    return out.select("channel", micros("created"), micros("deleted"), "lifetime_h", "access", "posts")


@query(f"""WITH {ROOMS} SELECT count(*) AS n_rooms, count(deleted) AS n_deleted, count(*) FILTER (len(allow) + len(deny) > 0) AS n_restricted,
 (SELECT count(*) FROM ps WHERE channel IN (SELECT channel FROM rm WHERE len(allow) + len(deny) > 0)) AS posts_in_restricted FROM rm""")
def room_totals(spark, d):
    return rooms.room_totals(_channels(spark, d), _posts(spark, d))


@query(f"WITH {ROOMS} SELECT channel, count(*) AS posts FROM ps WHERE channel IS NOT NULL AND channel NOT IN (SELECT channel FROM rm) GROUP BY 1")
def room_unknown_channels(spark, d):
    return rooms.unknown_channels(_posts(spark, d), _channels(spark, d))


@query(f"""WITH d AS (SELECT client_id, {list(MODELS)!r}[CAST(client_id % {len(MODELS)} AS INT) + 1] AS m, balance FROM clients),
 v AS (SELECT *, CASE WHEN m LIKE 'claude%' THEN 'Anthropic' WHEN m LIKE 'gpt%' OR m LIKE 'o3%' THEN 'OpenAI' WHEN m LIKE 'gemini%' THEN 'Google' ELSE 'other' END AS vendor, regexp_replace(regexp_replace(m, '^.*::', ''), '^.*/', '') AS short FROM d)
 SELECT vendor, count(*) AS agents, count(*) FILTER (balance > 0) AS participating, array_to_string(list_sort(list_distinct(list(short))), ', ') AS models FROM v WHERE m IS NOT NULL GROUP BY 1""")
def room_vendors(spark, d):
    return rooms.by_vendor(_directory(spark, d))


@query("SELECT strftime(updated_at, '%Y-%m') AS month, count(*) AS agents FROM clients WHERE updated_at IS NOT NULL GROUP BY 1")
def room_joins_by_month(spark, d):
    return rooms.joins_by_month(_directory(spark, d))


#: The wall clock of each post's time against the windows.
@query(f"""WITH l AS (SELECT *, timezone('{ZONE}', timezone('UTC', sold_at)) AS t FROM sales), h AS (SELECT *, hour(t) * 60 + minute(t) AS m, isodow(t) AS d FROM l)
 SELECT strftime(sold_at, '%Y-%m-%d') AS day, count(*) AS outside FROM h WHERE sold_at IS NULL OR NOT ((d <= 5 AND m >= 540 AND m < 1050) OR (d = 6 AND m >= 600 AND m < 645)) GROUP BY 1""")
def room_posts_outside_hours(spark, d):
    windows = spark.createDataFrame(HOURS, "n int, days array<string>, start string, end string")
    return rooms.outside_schedule(_posts(spark, d), windows, ZONE).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("outside"))


@query("""SELECT CASE WHEN s = 'dse' THEN 'main wiki (dse)' WHEN s = 'is.gd' THEN 'shorteners' WHEN s LIKE '%paste%' THEN 'pastebins' WHEN s LIKE '%wiki%' THEN 'other wikis' ELSE 'other' END AS surface, strftime(ts, '%Y-%m-%d') AS day, count(*) AS posts, count(DISTINCT client_id) AS authors
 FROM (SELECT ts, client_id, ['dse', 'is.gd', 'pastebin.com', 'mywiki.org', 'x.com'][CAST(click_id % 5 AS INT) + 1] AS s FROM clicks) WHERE ts IS NOT NULL GROUP BY 1, 2""")
def surface_timeline(spark, d):
    from .plans.statistics import surface_timeline as timeline

    sites = F.array(*[F.lit(x) for x in ("dse", "is.gd", "pastebin.com", "mywiki.org", "x.com")])
    return timeline(table(spark, d, "clicks").select("ts", F.col("client_id").alias("author_raw"), F.get(sites, (F.col("click_id") % 5).cast("int")).alias("site")))


#: Sales as posts of their clients; the roster knows two of three clients, and half of the goals are in force.
MATCHED = "an AS (SELECT sale_id AS event_id, 'a' || client_id AS author, CASE WHEN client_id % 3 <> 0 THEN client_id % 50 END AS agent, priority AS goal, priority % 2 = 0 AS inside FROM sales)"


def _matched(spark, d):
    t = table(spark, d, "sales").select("sale_id", "client_id", "sold_at", "arrived_at", "status", "total", "priority").distinct()
    t = t.withColumn("event_id", F.to_json(F.struct("*")))  # sales repeat their ids
    events = t.select("event_id", F.concat(F.lit("a"), "client_id").alias("author_raw"))
    return events, t.select("event_id", F.when(F.col("client_id") % 3 != 0, F.col("client_id") % 50).alias("roster_agent"), F.col("priority").alias("goal_id"), (F.col("priority") % 2 == 0).alias("in_window"))


@query(f"""WITH s AS (SELECT DISTINCT sale_id, client_id, sold_at, arrived_at, status, total, priority FROM sales), {MATCHED.replace("FROM sales", "FROM s")}
 SELECT count(*) AS posts, count(agent) AS posts_matched, count(DISTINCT author) AS authors, count(DISTINCT author) FILTER (agent IS NOT NULL) AS authors_matched,
  count(*) FILTER (agent IS NOT NULL AND NOT coalesce(inside, false)) AS posts_outside_window, count(DISTINCT goal) FILTER (agent IS NOT NULL) AS goals_with_posts FROM an""")
def roster_coverage(spark, d):
    return roster.coverage_of(*_matched(spark, d))


@query(f"""WITH s AS (SELECT DISTINCT sale_id, client_id, sold_at, arrived_at, status, total, priority FROM sales), {MATCHED.replace("FROM sales", "FROM s")} SELECT author AS author_raw, count(*) AS posts FROM an WHERE agent IS NULL AND author IS NOT NULL GROUP BY 1""")
def roster_unmatched_authors(spark, d):
    return roster.unmatched_authors(*_matched(spark, d))


@query("SELECT client_id AS agent_id, count(*) AS starts, count(DISTINCT kind) AS session_ids FROM clicks GROUP BY 1")
def session_ids(spark, d):
    return roster.session_ids(table(spark, d, "clicks").select(F.col("client_id").alias("agent_id"), F.col("kind").alias("ref")))
