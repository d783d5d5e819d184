"""Sessions, versions, interval and as-of joins, trees and rollups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bindings import AGENT, BIND, _claims, _events, _mentions, _with, micros, query, table
from .operators import lifecycle, relay, roster, windows
from .operators import trees as tr
from .plans import statistics as st

GAP = "CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > {gap} THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END"


@query(f"""WITH g AS (SELECT user_id, ts, event_id, {GAP.format(gap=1800)} AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
 SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY 1, 2""")
def sweeps_per_user(spark, d):
    e = table(spark, d, "events")
    return windows.sessions(e, 1800, ["user_id"], order=["event_id"]).select("user_id", "session", micros("start"), micros("end"), "n")


def _sweeps_sql(gap: int) -> str:
    return f"""WITH x AS (SELECT ts, 'c' || (user_id % 8) AS channel FROM events WHERE event_type = 'purchase'),
 g AS (SELECT *, {GAP.format(gap=gap * 60)} AS fresh FROM x WINDOW w AS (ORDER BY ts, channel)), s AS (SELECT *, sum(fresh) OVER (ORDER BY ts, channel) AS session FROM g)
 SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n, count(DISTINCT channel) AS pages FROM s GROUP BY session"""


def _deletes(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select("ts", F.concat(F.lit("c"), F.col("user_id") % 8).alias("channel"))


@query(_sweeps_sql(30))
def sweeps_30(spark, d):
    return windows.sweeps(_deletes(spark, d), 30).select(micros("start"), micros("end"), "n", "pages")


@query(_sweeps_sql(15))
def sweeps_15(spark, d):
    return windows.sweeps(_deletes(spark, d), 15).select(micros("start"), micros("end"), "n", "pages")


#: Orders of a customer as goals: window until the next order.
GOALS = """gl AS (SELECT CAST(o_orderkey AS VARCHAR) AS goal_id, CAST(o_custkey AS VARCHAR) AS agent_id, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS role,
 o_orderdate AS start, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "end" FROM orders)"""


def _goals(spark, d):
    o = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    role = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "-"))
    return o.select(F.col("o_orderkey").cast("string").alias("goal_id"), F.col("o_custkey").cast("string").alias("agent_id"), role.alias("role"), F.col("o_orderdate").alias("start"), F.lead("o_orderdate").over(w).alias("end"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders),
 g AS (SELECT *, CASE WHEN (epoch_us(t) - epoch_us(lag(t) OVER w)) / 1e6 <= 600 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (ORDER BY t, CAST(k AS VARCHAR))), r AS (SELECT *, sum(fresh) OVER (ORDER BY t, CAST(k AS VARCHAR)) AS run FROM g),
 h AS (SELECT run, strftime(min(t), '%b%d') AS token FROM r GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY run) AS j FROM h)
 SELECT CAST(k AS VARCHAR) AS goal_id, token || CASE WHEN j > 1 THEN chr(CAST(96 + j AS INT)) ELSE '' END AS batch FROM r JOIN n USING (run)""")
def goal_batches(spark, d):
    g = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("goal_id"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("start"))
    return windows.batches(g).select("goal_id", "batch")


@query(f"""WITH {GOALS} SELECT goal_id, agent_id, CASE WHEN lag(role) OVER w IS NULL THEN 'first' WHEN lag(role) OVER w = role THEN 'reworded' ELSE 'reassigned' END AS change,
 coalesce(lag("end") OVER w > start, lag(role) OVER w IS NOT NULL) AS overlaps FROM gl WINDOW w AS (PARTITION BY agent_id ORDER BY start, goal_id)""")
def goal_changes(spark, d):
    g = windows.goal_changes(_goals(spark, d))
    return g.select("goal_id", "agent_id", "change", "overlaps")


@query(f"""WITH {GOALS} SELECT agent_id, goal_id, (epoch_us(lead(start) OVER (PARTITION BY agent_id ORDER BY start, goal_id)) - epoch_us("end")) / 1e6 AS diff_s FROM gl""")
def era_gaps(spark, d):
    return windows.window_gaps(_goals(spark, d), ["agent_id"], "goal_id").select("agent_id", "goal_id", "diff_s")


#: Line items as events of the order's customer, at their ship date.
SHIPPED = "sh AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id, CAST(o_custkey AS VARCHAR) AS agent_id, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _shipped(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("agent_id"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("ts"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"), "agent_id", "ts")


@query(f"""WITH {GOALS}, {SHIPPED}, j AS (SELECT event_id, goal_id, start, ts >= start AND ("end" IS NULL OR ts < "end") AS held, least(abs(epoch_us(ts) - epoch_us(start)), abs(epoch_us(ts) - epoch_us("end"))) AS far FROM sh JOIN gl USING (agent_id))
 SELECT event_id, coalesce(max((start, goal_id)) FILTER (held), min((far, goal_id)) FILTER (NOT held))[2] AS goal_id, bool_or(held) AS in_window FROM (SELECT event_id, goal_id, epoch_us(start) AS start, held, far FROM j) GROUP BY 1""")
def goal_window_join(spark, d):
    return windows.window_join(_shipped(spark, d), _goals(spark, d), "agent_id", "goal_id")


#: Every order opens a window of 60 days for everyone.
ERAS = """er AS (SELECT CAST(o_orderkey AS VARCHAR) AS era_id, o_orderdate AS start, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 60 DAY END AS "end" FROM orders)"""


@query(f"""WITH {ERAS}, {SHIPPED} SELECT event_id, max((epoch_us(start), era_id))[2] AS era_id FROM sh LEFT JOIN er ON ts >= start AND ("end" IS NULL OR ts < "end") GROUP BY 1""")
def era_join(spark, d):
    return windows.era_join(_shipped(spark, d), _eras(table(spark, d, "orders")), 86400)


def _eras(o):
    return o.select(F.col("o_orderkey").cast("string").alias("era_id"), F.col("o_orderdate").alias("start"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.expr("interval 60 day")).alias("end"))


@query(f"""WITH {GOALS}, {SHIPPED} SELECT event_id FROM sh WHERE EXISTS (SELECT 1 FROM gl WHERE gl.agent_id = sh.agent_id AND ts >= start AND ("end" IS NULL OR ts < "end"))""")
def activity_in_window(spark, d):
    return windows.in_any_window(_shipped(spark, d), _goals(spark, d), "agent_id").select("event_id")


def _side(spark, d, kind):
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    return e.select("event_id", "user_id", "ts", F.concat(F.lit(kind), "event_id").alias("label"))


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, 'view' || event_id AS label FROM events WHERE event_type = 'view')
 SELECT event_id, (n).label AS label, round((n).d / 1e6, 6) AS dt_s FROM (SELECT l.event_id, min({'d': abs(epoch_us(l.ts) - epoch_us(r.ts)), 't': epoch_us(r.ts), 'label': r.label}) FILTER (r.label IS NOT NULL) AS n FROM l LEFT JOIN r USING (user_id) GROUP BY 1)""")
def nearest_save(spark, d):
    return windows.nearest(_side(spark, d, "click"), _side(spark, d, "view"), "user_id", "event_id", "label").withColumn("dt_s", F.round("dt_s", 6))


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, 'view' || event_id AS label FROM events WHERE event_type = 'view')
 SELECT event_id, (n).label AS label, round(((n).t - t0) / 1e6, 6) AS dt_s FROM (SELECT l.event_id, epoch_us(l.ts) AS t0, min({'t': epoch_us(r.ts), 'label': r.label}) FILTER (r.label IS NOT NULL) AS n FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts >= l.ts GROUP BY 1, 2)""")
def next_revision(spark, d):
    return windows.next_at_or_after(_side(spark, d, "click"), _side(spark, d, "view"), "user_id", "event_id", "label").withColumn("dt_s", F.round("dt_s", 6))


@query("""SELECT lang, source, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def latest_versions(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "doc_id", F.col("doc_id").alias("created"))
    return windows.latest_versions(docs, ["lang", "source"], "created", "doc_id").where("latest").select("lang", "source", "doc_id")


#: Turns of a conversation, cumulated to snapshots; every fifth conversation loses its page before turn 2.
SNAP = """rv AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts, text FROM conversations WHERE role <> 'system'),
 dl AS (SELECT DISTINCT conv_id, TIMESTAMP '2024-01-01' + to_hours(conv_id) + INTERVAL 90 SECOND AS ts FROM conversations WHERE conv_id % 5 = 0)"""


def _snapshots(spark, d):
    t = table(spark, d, "conversations").where("role <> 'system'")
    base = F.lit(1704067200000000) + F.col("conv_id") * 3600000000
    w = W.partitionBy("conv_id").orderBy("turn")
    revs = t.select(F.concat(F.lit("p"), "conv_id").alias("channel"), F.timestamp_micros(base + F.col("turn") * 60000000).alias("ts"), F.concat_ws(":", "conv_id", F.format_string("%04d", "turn")).alias("rev_id"), F.col("role").alias("author_alt"), F.array_join(F.collect_list("text").over(w), "\n\n").alias("body"))
    dels = table(spark, d, "conversations").where("conv_id % 5 = 0").select(F.concat(F.lit("p"), "conv_id").alias("channel"), F.timestamp_micros(base + 90000000).alias("ts")).distinct()
    return revs, dels


@query(f"""WITH {SNAP}, s AS (SELECT a.conv_id, a.turn AS snap, a.ts, unnest(regexp_split_to_array(b.text, '\\n\\s*\\n')) AS post, b.turn AS part FROM rv a JOIN rv b ON a.conv_id = b.conv_id AND b.turn <= a.turn),
 k AS (SELECT s.*, lower(trim(regexp_replace(regexp_replace(post, '[^\\x00-\\x7F]', '', 'g'), '[ \\t-\\r\\x1c-\\x1f]+', ' ', 'g'))) AS key, (SELECT count(*) FROM dl WHERE dl.conv_id = s.conv_id AND dl.ts <= s.ts) AS life FROM s)
 SELECT 'p' || conv_id AS channel, key, life, epoch_us(min(ts)) AS ts, (SELECT epoch_us(min(dl.ts)) FROM dl WHERE dl.conv_id = k.conv_id AND dl.ts > min(k.ts)) AS visible_until FROM k WHERE key <> '' GROUP BY conv_id, key, life""")
def snapshot_posts(spark, d):
    revs, dels = _snapshots(spark, d)
    return lifecycle.snapshots_to_posts(revs, dels).select("channel", "key", F.col("lifetime").alias("life"), micros("ts"), micros("visible_until"))


@query(f"""WITH {SNAP}, s AS (SELECT a.conv_id, a.ts, unnest(regexp_split_to_array(b.text, '\\n\\s*\\n')) AS post FROM rv a JOIN rv b ON a.conv_id = b.conv_id AND b.turn <= a.turn),
 k AS (SELECT conv_id, ts, lower(trim(regexp_replace(regexp_replace(post, '[^\\x00-\\x7F]', '', 'g'), '[ \\t-\\r\\x1c-\\x1f]+', ' ', 'g'))) AS key FROM s)
 SELECT 'p' || conv_id AS channel, key, min(k.ts) < min(dl.ts) AS restored FROM k JOIN dl USING (conv_id) WHERE key <> '' GROUP BY conv_id, key HAVING max(k.ts) >= min(dl.ts)""")
def restored_posts(spark, d):
    revs, dels = _snapshots(spark, d)
    return lifecycle.restored(revs, dels)


@query(f"""WITH {BIND}, a AS (SELECT DISTINCT agent AS src, item AS dst FROM m WHERE family = 'click'), b AS (SELECT DISTINCT agent AS src, item AS dst FROM m WHERE family = 'view')
 SELECT CASE WHEN a.src IS NULL THEN 'right' WHEN b.src IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst GROUP BY 1""")
def recreation_overlap(spark, d):
    m = _mentions(spark, d)
    pairs = lambda k: m.where(F.col("family") == k).select(F.col(AGENT).alias("src"), F.col("item").alias("dst")).distinct()
    return lifecycle.set_comparison(pairs("click"), pairs("view"), ["src", "dst"])


@query("""WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_id // 3 <> event_id THEN event_id // 3 END AS parent FROM events), k AS (SELECT t.id, CASE WHEN p.id IS NOT NULL THEN t.parent END AS parent, t.parent IS NOT NULL AND p.id IS NULL AS orphan FROM t LEFT JOIN t p ON t.parent = p.id),
 dp(id, depth) AS (SELECT id, 0 FROM k WHERE parent IS NULL UNION ALL SELECT k.id, dp.depth + 1 FROM dp JOIN k ON k.parent = dp.id)
 SELECT count(*) FILTER (parent IS NULL AND NOT orphan) AS roots, count(parent) AS children, count(*) FILTER (orphan) AS orphans, (SELECT max(depth) FROM dp) AS max_depth, (SELECT max(n) FROM (SELECT count(*) AS n FROM k WHERE parent IS NOT NULL GROUP BY parent)) AS max_fan_out FROM k""")
def tree_stats(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.floor(F.col("event_id") / 3) != F.col("event_id"), F.floor(F.col("event_id") / 3)).alias("parent_id"))
    return tr.tree_summary(e)


@query("""WITH g AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
 q AS (SELECT event_type, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM g) SELECT event_type, CAST(q.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM q LEFT JOIN c USING (event_type, day)""")
def timeline_zero_filled(spark, d):
    return windows.calendar_counts(table(spark, d, "events"), "event_type", "2024-01-01", "2024-01-31").withColumn("day", F.col("day").cast("string"))


@query("""WITH a AS (SELECT lang AS category, count(*) AS surfaces FROM documents WHERE n_chars > 500 GROUP BY 1), b AS (SELECT lang AS category, count(*) AS gaps FROM documents WHERE n_chars <= 500 GROUP BY 1)
 SELECT category, coalesce(surfaces, 0) AS surfaces, coalesce(gaps, 0) AS gaps FROM a FULL JOIN b USING (category)""")
def coverage_rollup(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("category"), "n_chars")
    return st.coverage(docs.where("n_chars > 500"), docs.where("n_chars <= 500"))


def _sited(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("event_id"), F.col("source").alias("site"), F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 600000000).alias("ts"), F.col("lang").alias("author_raw"), "text")


SITED = "s AS (SELECT doc_id, source AS site, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10) AS ts, lang AS author_raw, text FROM documents)"
TECHNIQUES = {"license": r"licen[sc]e", "connective": r"(^| )(tion|ing)( |[.]|$)", "mail": r"@[a-z]+\.", "never": r"zzzzqq"}
HITS = "h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS technique, * FROM s WHERE regexp_matches(text, '(?i){p}')" for n, p in TECHNIQUES.items()) + ")"
SPREAD = f"WITH {SITED}, {HITS}, st AS (SELECT site, count(*) AS n, max(ts) AS last FROM s GROUP BY 1 HAVING count(*) >= 5), o AS (SELECT technique, min(ts) AS t0, arg_min(site, (ts, CAST(doc_id AS VARCHAR))) AS origin FROM h GROUP BY 1), sp AS (SELECT technique, site, min(ts) AS first_seen, count(*) AS n_posts, count(DISTINCT author_raw) AS n_authors FROM h SEMI JOIN st USING (site) GROUP BY 1, 2), x AS (SELECT sp.*, (epoch_us(first_seen) - epoch_us(t0)) / 3.6e9 AS hours, site = origin AS is_origin FROM sp JOIN o USING (technique))"


@query(SPREAD + " SELECT technique, site, epoch_us(first_seen) AS first_seen, n_posts, n_authors, round(hours, 6) AS hours_after_origin, is_origin FROM x")
def technique_spread(spark, d):
    return st.technique_spread(_sited(spark, d), TECHNIQUES).withColumn("first_seen", F.unix_micros("first_seen")).withColumn("hours_after_origin", F.round("hours_after_origin", 6))


@query(SPREAD + " SELECT technique, count(*) AS n_sites_adopted, round(median(hours) FILTER (NOT is_origin), 6) AS median_hours, count(*) FILTER (NOT is_origin AND hours <= 24) AS n_within_24h, CAST(sum(n_posts) AS BIGINT) AS n_posts, any_value(r.n) AS n_sites_at_risk FROM x LEFT JOIN (SELECT technique, count(*) AS n FROM o JOIN st ON last >= t0 GROUP BY 1) r USING (technique) GROUP BY 1")
def technique_site_summary(spark, d):
    return st.technique_site_summary(_sited(spark, d), TECHNIQUES).withColumn("median_hours", F.round("median_hours", 6))


@query(f"WITH {SITED} SELECT site, count(*) AS posts, count(DISTINCT author_raw) AS authors, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def per_site(spark, d):
    return st.per_site(_sited(spark, d)).withColumn("first", F.unix_micros("first")).withColumn("last", F.unix_micros("last"))


@query(f"WITH {GOALS} SELECT role, count(*) AS goals, count(DISTINCT agent_id) AS agents, count(*) FILTER (\"end\" IS NULL) AS open FROM gl GROUP BY 1")
def roster_summary(spark, d):
    return roster.by_role(_goals(spark, d))


@query("""WITH p AS (SELECT n_regionkey AS room, n_nationkey AS agent FROM nation WHERE n_nationkey % 2 = 0), q AS (SELECT n_regionkey AS room, n_nationkey AS agent FROM nation WHERE n_nationkey % 3 = 0)
 SELECT 'r' || room AS channel, 'n' || agent AS agent FROM p WHERE (room, agent) NOT IN (SELECT (room, agent) FROM q)""")
def room_audience(spark, d):
    n = table(spark, d, "nation")
    name = F.concat(F.lit("n"), "n_nationkey")
    rooms = n.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("channel")).agg(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, name)).alias("allow"), F.collect_list(F.when(F.col("n_nationkey") % 3 == 0, name)).alias("deny"))
    return roster.audience(rooms, n.select(name.alias("agent")))


@query("""SELECT c_custkey, CASE WHEN m LIKE 'claude%' THEN 'Anthropic' WHEN m LIKE 'gpt%' THEN 'OpenAI' WHEN m LIKE 'o3%' THEN 'OpenAI' WHEN m LIKE 'gemini%' THEN 'Google' ELSE 'other' END AS vendor
 FROM (SELECT c_custkey, lower(['Claude x', 'GPT-y', 'o3', 'gemini-z', 'house'][CAST(c_custkey % 5 AS INT) + 1]) AS m FROM customer)""")
def directory_vendor(spark, d):
    from .functions.text import vendor

    models = F.array(*[F.lit(x) for x in ("Claude x", "GPT-y", "o3", "gemini-z", "house")])
    return table(spark, d, "customer").select("c_custkey", vendor(F.get(models, (F.col("c_custkey") % 5).cast("int"))).alias("vendor"))


@query("""WITH u AS (SELECT user_id, ts FROM events) SELECT user_id, count(*) AS sessions, round(avg(CAST(isodow(ts) >= 6 AS INT)), 6) AS weekend_share, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM u GROUP BY 1""")
def activity_summary(spark, d):
    return roster.activity_by_agent(table(spark, d, "events").select(F.col("user_id").alias("agent_id"), "ts")).select(F.col("agent_id").alias("user_id"), "sessions", F.round("weekend_share", 6).alias("weekend_share"), micros("first"), micros("last"))


@query(f"""WITH {BIND}, gold AS (SELECT event_id, item FROM c WHERE CAST(event_id AS INT) % 3 = 0), pred AS (SELECT event_id, item FROM c WHERE CAST(event_id AS INT) % 2 = 0), ids AS (SELECT event_id FROM c)
 SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (SELECT event_id IN (SELECT event_id FROM gold) AS g, event_id IN (SELECT event_id FROM pred) AS p FROM ids)""")
def gold_score(spark, d):
    from .plans import validation

    c = _claims(spark, d)
    n = F.col("event_id").cast("int")
    return validation.presence(c.select("event_id"), c.where(n % 3 == 0).select("event_id"), c.where(n % 2 == 0).select("event_id"))


@query()
def gold_sample(spark, d):
    from .plans import validation

    e = _events(spark, d).select("event_id", (F.col("event_type") == "purchase").alias("is_answer"), (F.col("event_type") == "view").alias("is_arrival"))
    return validation.stratified(e, 40, 7)


@query(f"""WITH {BIND}, rule AS (SELECT claim_id, event_id, item, value_norm, episode FROM c), ai AS (SELECT 'l' || event_id AS claim_id, event_id, item, CASE WHEN CAST(event_id AS INT) % 2 = 0 THEN value_norm || '0' END AS value_norm, CAST(NULL AS DOUBLE) AS episode FROM c WHERE CAST(event_id AS INT) % 3 = 0)
 SELECT ai.claim_id, ai.event_id, ai.item, coalesce(ai.value_norm, rule.value_norm) AS value_norm, coalesce(ai.episode, rule.episode) AS episode, 'llm+rule' AS extractor FROM ai LEFT JOIN rule USING (event_id, item)
 UNION ALL SELECT *, 'rule' FROM rule WHERE event_id NOT IN (SELECT event_id FROM ai)""")
def model_merge(spark, d):
    from .operators import model_claims

    c = _claims(spark, d)
    n = F.col("event_id").cast("int")
    rule = c.withColumn("extractor", F.lit("rule")).select("claim_id", "event_id", "event_type", "item", "value_norm", "episode", "extractor")
    ai = c.where(n % 3 == 0).select(F.concat(F.lit("l"), "event_id").alias("claim_id"), "event_id", "event_type", "item", F.when(n % 2 == 0, F.concat("value_norm", F.lit("0"))).alias("value_norm"), F.lit(None).cast("double").alias("episode"), F.lit("llm").alias("extractor"))
    return model_claims.merge(rule, ai).select("claim_id", "event_id", "item", "value_norm", "episode", "extractor")
