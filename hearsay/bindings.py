"""The engine's operators bound to the driver's tables, each with its SQL twin.

``BIND`` renders the canonical tables in SQL; the functions below render the same
in Spark.  Times are compared as microseconds, ratios rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import facts, relay, windows
from .plans import statistics as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AGENT = "agent_merged"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # times without a zone are UTC
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.to_utc_timestamp(F.col(c).cast("timestamp"), "UTC"))
    return df


def micros(c: str):
    return F.unix_micros(c).alias(c)


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# ------------------------------------------------------------------ canonical tables

BIND = """
e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
m AS (SELECT CAST(event_id AS VARCHAR) AS event_id, ts, 'u' || user_id AS agent, event_type AS family, 'i' || (k % 20) AS item,
        CAST(CAST(floor(value / 50) AS INT) AS VARCHAR) AS value_key, 'c' || (user_id % 8) AS channel,
        CASE WHEN k % 3 = 0 THEN ts + to_hours((k % 5) + 1) END AS visible_until FROM e),
c AS (SELECT 'c' || event_id AS claim_id, CAST(event_id AS VARCHAR) AS event_id, ts, 'u' || user_id AS agent, event_type AS family, 'i' || (k % 20) AS item,
        CASE WHEN k % 11 <> 0 THEN CAST(CAST(floor(value / 50) AS INT) AS VARCHAR) END AS value_norm, CASE k % 4 WHEN 0 THEN 'instant' WHEN 1 THEN 'delayed' END AS latency_class,
        k % 10 = 0 AS wrong_flag, k % 10 = 1 AS correct_flag, CASE WHEN k % 7 <> 0 THEN CAST(k % 5 + 1 AS DOUBLE) END AS episode FROM e WHERE event_type IN ('purchase', 'signup'))
"""
ROUNDS = """
r AS (SELECT agent, family, item, arg_min(claim_id, (ts, event_id)) AS claim_id, min(ts) AS t_report,
        arg_min(episode, (ts, event_id)) FILTER (episode IS NOT NULL) AS episode, arg_min(value_norm, (ts, event_id)) FILTER (value_norm IS NOT NULL) AS value_norm,
        arg_min(latency_class, (ts, event_id)) FILTER (latency_class IS NOT NULL) AS latency_class,
        bool_or(wrong_flag) AS wrong_flag, bool_or(correct_flag) AS correct_flag, count(*) AS n_reports FROM c GROUP BY 1, 2, 3)
"""
CONS = """
su AS (SELECT agent, family, item, value_norm AS value_key, ts, event_id FROM c WHERE value_norm IS NOT NULL AND NOT wrong_flag
       UNION ALL SELECT agent, family, item, value_key, ts, event_id FROM m),
sv AS (SELECT family, item, value_key, count(DISTINCT agent) AS agents, min(ts) AS t FROM su GROUP BY 1, 2, 3),
sr AS (SELECT *, row_number() OVER (PARTITION BY family, item ORDER BY agents DESC, t, value_key) AS rn, count(*) OVER (PARTITION BY family, item) AS variants FROM sv),
con AS (SELECT family, item, value_key AS consensus_value FROM sr WHERE rn = 1 AND (agents >= 2 OR variants = 1))
"""
#: ``open``: which mentions an agent can read.
EXP = """
rt AS (SELECT r.*, consensus_value, coalesce(value_norm, consensus_value) AS target FROM r LEFT JOIN con USING (family, item)),
p AS (SELECT rt.claim_id, rt.agent, min(m.ts) FILTER (m.agent <> rt.agent) AS t_public, arg_min(m.agent, (m.ts, m.event_id)) FILTER (m.agent <> rt.agent) AS src_agent,
        min(m.ts) FILTER (m.agent = rt.agent) AS t_self, min(m.ts) FILTER (m.agent <> rt.agent AND (visible_until IS NULL OR visible_until > t_report)) AS t_vis,
        min((m.ts, m.event_id, coalesce(visible_until, TIMESTAMP '2200-01-01'))) FILTER (m.agent <> rt.agent) AS source
      FROM rt JOIN m ON m.family = rt.family AND m.item = rt.item AND m.value_key = rt.target AND m.ts < rt.t_report {open} GROUP BY 1, 2),
pc AS (SELECT rt.claim_id, rt.agent, min(m.ts) AS t_cons FROM rt JOIN m ON m.family = rt.family AND m.item = rt.item AND m.value_key = rt.consensus_value AND m.ts < rt.t_report AND m.agent <> rt.agent {open} GROUP BY 1, 2),
x0 AS (SELECT rt.*, t_public, src_agent, t_self, t_vis, t_cons, CASE WHEN source[3] < TIMESTAMP '2200-01-01' THEN source[3] END AS src_until FROM rt LEFT JOIN p USING (claim_id, agent) LEFT JOIN pc USING (claim_id, agent)),
x AS (SELECT claim_id, agent, family, item, episode, value_norm, t_report, t_public, src_agent, t_self AS t_self_prepared, consensus_value, latency_class, wrong_flag,
        (epoch_us(t_report) - epoch_us(t_public)) / 1e6 AS gap_s, CAST(t_public IS NOT NULL AS INT) AS D,
        CAST(coalesce(epoch_us(t_report) - epoch_us(t_public) >= 600000000, false) AS INT) AS D_w10m, CAST(coalesce(epoch_us(t_report) - epoch_us(t_public) >= 3600000000, false) AS INT) AS D_w60m,
        CAST(t_self IS NOT NULL AS INT) AS self_prepared, CAST(t_cons IS NOT NULL AS INT) AS D_cons, CAST(coalesce(epoch_us(t_report) - epoch_us(t_cons) >= 3600000000, false) AS INT) AS D_cons_w60m,
        CAST(coalesce(latency_class = 'instant', false) AS INT) AS y_instant, CAST(latency_class IS NOT NULL AS INT) AS latency_known,
        CASE WHEN correct_flag THEN 1.0 WHEN wrong_flag THEN 0.0 ELSE CAST(value_norm = consensus_value AS DOUBLE) END AS y_consensus,
        t_vis AS t_public_visible, CAST(t_vis IS NOT NULL AS INT) AS D_visible, CAST(coalesce(src_until <= t_report, false) AS INT) AS src_deleted_before_report, src_until AS t_src_deleted,
        family || '|' || item AS item_fe FROM x0)
"""
#: Channels c0 and c1 are open to even users only.
AUDIENCE = "au AS (SELECT DISTINCT channel, a.agent FROM (VALUES ('c0'), ('c1')) v(channel), (SELECT DISTINCT 'u' || user_id AS agent FROM events WHERE user_id % 2 = 0) a)"
READABLE = "AND (m.channel NOT IN ('c0', 'c1') OR (m.channel, rt.agent) IN (SELECT (channel, agent) FROM au))"


def _with(*parts: str, open_: str = "") -> str:
    return "WITH " + ", ".join(p.strip().replace("{open}", open_) for p in parts)


FULL = _with(BIND, ROUNDS, CONS, EXP)


def _events(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(F.col("event_id").cast("string").alias("event_id"), "ts", "user_id", "event_type", "value", "k")


def _mentions(spark, d):
    e = _events(spark, d)
    until = F.when(F.col("k") % 3 == 0, F.timestamp_micros(F.unix_micros("ts") + ((F.col("k") % 5) + 1).cast("bigint") * 3600000000))
    value = F.floor(F.col("value") / 50).cast("string")
    return e.select("event_id", "ts", F.concat(F.lit("u"), "user_id").alias("agent_strict"), F.concat(F.lit("u"), "user_id").alias(AGENT), F.concat(F.lit("c"), F.col("user_id") % 8).alias("channel"), F.col("event_type").alias("family"), F.concat(F.lit("i"), F.col("k") % 20).alias("item"), value.alias("value_norm"), value.alias("value_key"), until.alias("visible_until"))


def _claims(spark, d):
    e = _events(spark, d).where(F.col("event_type").isin("purchase", "signup"))
    k = F.col("k")
    return e.select(
        F.concat(F.lit("c"), "event_id").alias("claim_id"), "event_id", "ts", F.concat(F.lit("u"), "user_id").alias(AGENT), F.col("event_type").alias("family"), F.concat(F.lit("i"), k % 20).alias("item"),
        F.when(k % 11 != 0, F.floor(F.col("value") / 50).cast("string")).alias("value_norm"), F.when(k % 4 == 0, "instant").when(k % 4 == 1, "delayed").alias("latency_class"),
        (k % 10 == 0).alias("wrong_flag"), (k % 10 == 1).alias("correct_flag"), F.when(k % 7 != 0, (k % 5 + 1).cast("double")).alias("episode"), F.lit(None).cast("double").alias("timer_s"), F.lit("answer").alias("event_type"),
    )


def _rounds(spark, d):
    return facts.agent_rounds(_claims(spark, d), AGENT)


def _consensus(spark, d):
    return facts.consensus(_claims(spark, d), _mentions(spark, d), AGENT)


def _audience(spark, d):
    even = _events(spark, d).where("user_id % 2 = 0").select(F.concat(F.lit("u"), "user_id").alias("agent")).distinct()
    return even.withColumn("channel", F.explode(F.array(F.lit("c0"), F.lit("c1"))))


def _exposures(spark, d, audience: bool = False):
    return facts.exposures(_rounds(spark, d), _mentions(spark, d), _consensus(spark, d), AGENT, _audience(spark, d) if audience else None)


# ------------------------------------------------------------------ facts and exposure


@query(_with(BIND) + " SELECT event_id, epoch_us(ts) AS ts, agent AS agent_merged, channel, family, item, value_key, epoch_us(visible_until) AS visible_until FROM m")
def mentions_bound(spark, d):
    return _mentions(spark, d).select("event_id", micros("ts"), AGENT, "channel", "family", "item", "value_key", micros("visible_until"))


@query(_with(BIND, CONS) + " SELECT * FROM con")
def consensus_value(spark, d):
    return _consensus(spark, d)


@query(_with(BIND, ROUNDS) + " SELECT agent, family, item, claim_id, epoch_us(t_report) AS t_report, episode, value_norm, latency_class, wrong_flag, correct_flag, n_reports FROM r")
def agent_rounds(spark, d):
    return _rounds(spark, d).select("agent", "family", "item", "claim_id", micros("t_report"), "episode", "value_norm", "latency_class", "wrong_flag", "correct_flag", "n_reports")


_EX = "claim_id, agent, family, item, epoch_us(t_report) AS t_report, epoch_us(t_public) AS t_public, src_agent, epoch_us(t_self_prepared) AS t_self_prepared, gap_s, D, self_prepared, y_instant, latency_known, y_consensus, consensus_value, item_fe"


@query(FULL + f" SELECT {_EX} FROM x")
def exposure_basic(spark, d):
    return _exposures(spark, d).select("claim_id", "agent", "family", "item", micros("t_report"), micros("t_public"), "src_agent", micros("t_self_prepared"), "gap_s", "D", "self_prepared", "y_instant", "latency_known", "y_consensus", "consensus_value", "item_fe")


@query(FULL + " SELECT claim_id, D_w10m, D_w60m FROM x")
def exposure_windows(spark, d):
    return _exposures(spark, d).select("claim_id", "D_w10m", "D_w60m")


@query(FULL + " SELECT claim_id, D_cons, D_cons_w60m FROM x")
def exposure_consensus(spark, d):
    return _exposures(spark, d).select("claim_id", "D_cons", "D_cons_w60m")


@query(FULL + " SELECT claim_id, epoch_us(t_public_visible) AS t_public_visible, D_visible, src_deleted_before_report, epoch_us(t_src_deleted) AS t_src_deleted FROM x")
def exposure_visible(spark, d):
    return _exposures(spark, d).select("claim_id", micros("t_public_visible"), "D_visible", "src_deleted_before_report", micros("t_src_deleted"))


@query(_with(BIND, ROUNDS, CONS, AUDIENCE, EXP, open_=READABLE) + " SELECT claim_id, epoch_us(t_public) AS t_public, src_agent, D, D_cons, D_visible FROM x")
def exposure_audience(spark, d):
    return _exposures(spark, d, audience=True).select("claim_id", micros("t_public"), "src_agent", "D", "D_cons", "D_visible")


_PROV = """count(*) AS n_answers, count(*) FILTER (D = 0) AS n_independent, round(avg(D), 6) AS share_exposed, round(avg(D_w10m), 6) AS share_w10m, round(avg(D_w60m), 6) AS share_w60m,
 round(avg(self_prepared), 6) AS share_self_prepared, round(median(gap_s) FILTER (D = 1), 6) AS median_gap_s, count(DISTINCT agent) AS n_agents"""


def _prov(df, *by):
    return df.select(*by, "n_answers", "n_independent", *[r6(c, c) for c in ("share_exposed", "share_w10m", "share_w60m", "share_self_prepared", "median_gap_s")], "n_agents")


@query(FULL + f" SELECT {_PROV} FROM x")
def provenance_totals(spark, d):
    return _prov(st.provenance(_exposures(spark, d)))


@query(FULL + f" SELECT family, {_PROV} FROM x GROUP BY family HAVING count(*) >= 10")
def provenance_by_family(spark, d):
    return _prov(st.provenance(_exposures(spark, d), ["family"], 10), "family")


@query(FULL + f" SELECT episode, {_PROV} FROM x GROUP BY episode")
def provenance_by_episode(spark, d):
    return _prov(st.provenance(_exposures(spark, d), ["episode"]), "episode")


@query(FULL + """ SELECT count(*) FILTER (D_visible = 0) AS independent_visible, count(*) FILTER (src_deleted_before_report = 1) AS src_deleted, count(*) FILTER (D = 1 AND D_visible = 0) AS only_deleted_copies,
 round(median((epoch_us(t_report) - epoch_us(t_src_deleted)) / 1e6) FILTER (src_deleted_before_report = 1), 6) AS median_s_since_deletion FROM x""")
def visibility_note(spark, d):
    return st.visibility_note(_exposures(spark, d)).withColumn("median_s_since_deletion", F.round("median_s_since_deletion", 6))


@query(FULL + " SELECT round(min(gap_s), 6) AS min_gap_s, count(*) FILTER (abs(gap_s - 600) <= 2) AS near_10m, count(*) FILTER (abs(gap_s - 3600) <= 2) AS near_60m FROM x")
def clock_note(spark, d):
    return st.clock_note(_exposures(spark, d)).withColumn("min_gap_s", F.round("min_gap_s", 6))


@query(_with(BIND, """known AS (SELECT family, item, episode, count(*) AS n, min((ts, event_id)) AS first FROM c WHERE episode IS NOT NULL GROUP BY 1, 2, 3),
 best AS (SELECT *, sum(n) OVER (PARTITION BY family, item) AS total, row_number() OVER (PARTITION BY family, item ORDER BY n DESC, first) AS rn FROM known),
 modal AS (SELECT family, item, episode AS modal FROM best WHERE rn = 1 AND n >= 3 AND n / total >= 0.2)""") + " SELECT claim_id, coalesce(episode, modal) AS episode FROM c LEFT JOIN modal USING (family, item)")
def episode_fill(spark, d):
    return facts.fill_episodes(_claims(spark, d), min_share=0.2).select("claim_id", "episode")


# ------------------------------------------------------------------ graph

CARRIERS = """
o AS (SELECT *, row_number() OVER (PARTITION BY family, item, value_key, agent ORDER BY ts, event_id) AS own, lag(agent) OVER (PARTITION BY family, item, value_key, channel ORDER BY ts, event_id) AS prev,
        lag(ts) OVER (PARTITION BY family, item, value_key, channel ORDER BY ts, event_id) AS prev_ts, first_value(agent) OVER (PARTITION BY family, item, value_key ORDER BY ts, event_id) AS origin,
        min(ts) OVER (PARTITION BY family, item, value_key) AS t0, max(ts) OVER (PARTITION BY family, item, value_key) AS t1 FROM m),
re AS (SELECT coalesce(prev, origin) AS src, agent AS dst, family, item, value_key AS value_norm, CASE WHEN prev IS NULL THEN 'relay_xchannel' ELSE 'relay' END AS kind,
        (epoch_us(ts) - epoch_us(coalesce(prev_ts, t0))) / 1e6 AS dt_s, event_id FROM o WHERE own = 1 AND agent <> origin)
"""
DEPTH = """
dp AS (SELECT DISTINCT family, item, value_key, origin AS agent, 0 AS depth FROM o
       UNION ALL SELECT re.family, re.item, re.value_norm, re.dst, dp.depth + 1 FROM dp JOIN re ON re.family = dp.family AND re.item = dp.item AND re.value_norm = dp.value_key AND re.src = dp.agent),
ch AS (SELECT family, item, value_key, origin AS originator, t0, t1, count(*) AS n_agents FROM o WHERE own = 1 GROUP BY 1, 2, 3, 4, 5, 6),
chain AS (SELECT ch.*, max_depth FROM ch JOIN (SELECT family, item, value_key, max(depth) AS max_depth FROM dp GROUP BY 1, 2, 3) USING (family, item, value_key))
"""
GRAPH = _with(BIND, CARRIERS)
CHAINS = GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + DEPTH.strip()


@query(GRAPH + " SELECT *, dt_s <= 2.0 AS within_clock_res FROM re")
def relay_edges(spark, d):
    return relay.relay_edges(_mentions(spark, d), AGENT)


@query(CHAINS + " SELECT family, item, value_key, originator, epoch_us(t0) AS t0, n_agents, max_depth, (epoch_us(t1) - epoch_us(t0)) / 1e6 AS span_s FROM chain")
def relay_chains(spark, d):
    return relay.relay_chains(_mentions(spark, d), AGENT).withColumn("t0", F.unix_micros("t0"))


@query(FULL + " SELECT src_agent AS src, agent AS dst, family, item, coalesce(value_norm, consensus_value) AS value_norm, 'exposure' AS kind, gap_s AS dt_s, claim_id AS event_id FROM x WHERE D = 1")
def exposure_edges(spark, d):
    return relay.exposure_edges(_exposures(spark, d)).drop("within_clock_res")


@query(GRAPH + " SELECT src, dst, count(*) AS weight, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM re GROUP BY 1, 2")
def edge_collapse(spark, d):
    return relay.collapse(relay.relay_edges(_mentions(spark, d), AGENT))


@query("""WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1), k AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM s)
 SELECT round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM k""")
def hub_gini(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("x"))
    return relay.gini(s, "x").select(r6("gini", "gini"))


@query(GRAPH + " SELECT src AS agent, count(*) AS out_degree FROM re GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def hub_topk(spark, d):
    return relay.degrees(relay.relay_edges(_mentions(spark, d), AGENT)).orderBy(F.desc("out_degree"), "agent").limit(10)


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
 SELECT user_id, n, round(sum(n) OVER (ORDER BY n, user_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM u""")
def lorenz(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return relay.lorenz(u, "n", "user_id").withColumn("share", F.round("share", 6))


@query(CHAINS + """ SELECT CASE WHEN family = 'url' THEN 'urls' ELSE 'task values' END AS kind, count(*) AS facts, count(*) FILTER (n_agents > 1) AS repeated, round(avg(n_agents - 1), 6) AS mean_hops,
 round(quantile_cont(n_agents - 1.0, 0.9), 6) AS p90_hops, CAST(max(n_agents - 1) AS DOUBLE) AS max_hops, round(avg(n_agents - 1) FILTER (n_agents > 1), 6) AS mean_hops_repeated FROM chain GROUP BY 1""")
def reach(spark, d):
    return relay.reach(relay.relay_chains(_mentions(spark, d), AGENT)).select("kind", "facts", "repeated", r6("mean_hops", "mean_hops"), r6("p90_hops", "p90_hops"), "max_hops", r6("mean_hops_repeated", "mean_hops_repeated"))


@query(GRAPH + " SELECT CASE WHEN family = 'url' THEN 'url' ELSE 'value' END AS kind, count(*) AS hops, count(*) FILTER (dt_s <= 2) AS tied FROM re GROUP BY 1")
def relay_tie_note(spark, d):
    return st.relay_tie_note(relay.relay_edges(_mentions(spark, d), AGENT))


#: Distances and numbers of shortest paths; a node's share of a pair's paths is a product of the two.
BETWEEN = GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """,
 g AS (SELECT DISTINCT src, dst FROM re WHERE src <> dst), nd AS (SELECT src AS node FROM g UNION SELECT dst FROM g), cn AS (SELECT count(*) AS n FROM nd),
 hop(s, node, dist) AS (SELECT node, node, 0 FROM nd UNION SELECT s, dst, dist + 1 FROM hop JOIN g ON g.src = hop.node WHERE dist < 12),
 ds AS (SELECT s, node, min(dist) AS dist FROM hop GROUP BY 1, 2),
 pt(s, node, dist, paths) AS (SELECT node, node, 0, CAST(1 AS DOUBLE) FROM nd UNION ALL SELECT pt.s, g.dst, pt.dist + 1, sum(paths) FROM pt JOIN g ON g.src = pt.node JOIN ds ON ds.s = pt.s AND ds.node = g.dst AND ds.dist = pt.dist + 1 GROUP BY 1, 2, 3),
 bt AS (SELECT a.node, sum(a.paths * b.paths / c.paths) AS part FROM pt a JOIN pt b ON b.s = a.node JOIN pt c ON c.s = a.s AND c.node = b.node AND c.dist = a.dist + b.dist WHERE a.s <> a.node AND b.node <> a.node GROUP BY 1)
 SELECT node, round(coalesce(part, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6) AS betweenness FROM nd LEFT JOIN bt USING (node), cn"""


@query(BETWEEN)
def betweenness(spark, d):
    return relay.betweenness(relay.collapse(relay.relay_edges(_mentions(spark, d), AGENT))).select("node", r6("betweenness", "betweenness"))


# ------------------------------------------------------------------ statistics


@query("""WITH s AS (SELECT o_orderpriority AS priority, date_diff('day', o_orderdate, l_shipdate) AS t, CAST(l_returnflag = 'R' AS INT) AS ev FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 a AS (SELECT priority, t, sum(ev) AS events, count(*) AS leaving FROM s GROUP BY 1, 2), k AS (SELECT *, sum(leaving) OVER (PARTITION BY priority ORDER BY t DESC) AS at_risk FROM a),
 j AS (SELECT * FROM k WHERE events > 0), q AS (SELECT priority, CAST(t AS DOUBLE) AS t, at_risk, events, max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w AS over, sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w AS l FROM j WINDOW w AS (PARTITION BY priority ORDER BY t))
 SELECT priority, t, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(CASE WHEN over = 1 THEN 0 ELSE exp(l) END, 6) AS survival FROM q
 UNION ALL SELECT priority, 0, count(*), 0, 1 FROM s GROUP BY 1""")
def km_curve(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("priority"))
    s = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    s = s.select("priority", F.datediff("l_shipdate", "o_orderdate").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("ev"))
    return st.kaplan_meier(s, "t", "ev", ["priority"]).withColumn("survival", F.round("survival", 6))


TAGS = BIND + """, tg AS (SELECT event_id, ts, agent, family, 't' || (CAST(substr(item, 2) AS INT) % 3) AS technique, CAST(substr(item, 2) AS INT) % 5 = 0 AS uses FROM m)"""


@query(_with(TAGS) + """, h AS (SELECT * FROM tg WHERE uses), f AS (SELECT technique, min(ts) AS t0, arg_min(agent, (ts, event_id)) AS originator, count(*) AS n_posts FROM h GROUP BY 1),
 u AS (SELECT technique, agent, min(ts) AS first_use FROM h GROUP BY 1, 2),
 pool AS (SELECT f.technique, t0, originator, tg.agent, max(ts) AS last FROM f JOIN tg ON (f.technique <> 't0' OR family IN ('purchase', 'click')) GROUP BY 1, 2, 3, 4),
 du AS (SELECT pool.technique, pool.agent, (epoch_us(coalesce(first_use, last)) - epoch_us(t0)) / 3.6e9 AS hours, CAST(first_use IS NOT NULL AS INT) AS adopted FROM pool LEFT JOIN u USING (technique, agent) WHERE last >= t0 AND pool.agent <> originator)
 SELECT f.technique, epoch_us(t0) AS t0, originator, n_posts, count(du.agent) AS at_risk, CAST(sum(adopted) AS BIGINT) AS adopters, round(avg(adopted), 6) AS adoption_share, round(median(hours) FILTER (adopted = 1), 6) AS median_hours_among_adopters
 FROM f LEFT JOIN du USING (technique) GROUP BY 1, 2, 3, 4""")
def diffusion_summary(spark, d):
    k = F.substring("item", 2, 9).cast("int")
    tags = _mentions(spark, d).withColumn("techniques", F.when(k % 5 == 0, F.array(F.concat(F.lit("t"), k % 3))).otherwise(F.array().cast("array<string>")))
    techniques = spark.range(3).select(F.concat(F.lit("t"), "id").alias("technique"), F.when(F.col("id") == 0, F.array(F.lit("purchase"), F.lit("click"))).otherwise(F.array().cast("array<string>")).alias("families"))
    _, out = st.diffusion(tags, techniques, AGENT)
    return out.select("technique", micros("t0"), "originator", "n_posts", "at_risk", "adopters", r6("adoption_share", "adoption_share"), r6("median_hours_among_adopters", "median_hours_among_adopters"))


#: ``ca``: slot (a, b), agent, variant, ts.
SLOTS = """
s1 AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts, agent, variant) AS rn, count(*) OVER (PARTITION BY a, b) AS n, min(ts) OVER (PARTITION BY a, b) AS t0 FROM ca),
s2 AS (SELECT a, b, variant, count(*) AS k, min(rn) AS at_ FROM s1 WHERE rn > floor(n * 2 / 3) GROUP BY 1, 2, 3),
s3 AS (SELECT a, b, arg_min(variant, (-k, at_)) AS winner FROM s2 GROUP BY 1, 2),
s4 AS (SELECT s1.*, winner, greatest(CAST(ceil((epoch_us(ts) - epoch_us(t0)) / 3.6e9 / 3) AS BIGINT), 1) AS bin FROM s1 JOIN s3 USING (a, b)),
s5 AS (SELECT a, b, bin, avg(CAST(variant = winner AS INT)) >= 0.5 AS held FROM s4 GROUP BY 1, 2, 3),
s6 AS (SELECT a, b, bin, min(CAST(held AS INT)) OVER (PARTITION BY a, b ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept FROM s5),
s7 AS (SELECT a, b, min(bin) AS bin50 FROM s6 WHERE kept = 1 GROUP BY 1, 2),
s8 AS (SELECT a, b, count(*) AS overlap_agents FROM (SELECT a, b, agent FROM s4 GROUP BY 1, 2, 3 HAVING count(DISTINCT variant) > 1) GROUP BY 1, 2),
sl AS (SELECT a, b, n AS n_carriers, coalesce(any_value(overlap_agents), 0) AS overlap_agents, any_value(winner) AS winner, arg_min(variant, (ts, agent, variant)) AS first_variant, epoch_us(min(t0)) AS t0,
        epoch_us(min(ts) FILTER (variant = winner)) AS t_winner_first, CASE WHEN any_value(bin50) IS NOT NULL THEN greatest(epoch_us(min(t0)) + (any_value(bin50) - 1) * 10800000000, epoch_us(min(ts) FILTER (variant = winner))) END AS t_winner_majority
      FROM s4 LEFT JOIN s7 USING (a, b) LEFT JOIN s8 USING (a, b) GROUP BY a, b, n)
"""
_SL = "n_carriers, overlap_agents, winner, first_variant, first_variant <> winner AS corrected, t0, t_winner_first, t_winner_majority"


def _slots(df):
    return df.withColumn("t0", F.unix_micros("t0")).withColumn("t_winner_first", F.unix_micros("t_winner_first")).withColumn("t_winner_majority", F.unix_micros("t_winner_majority")).drop("hours_to_overtake")


@query(_with(BIND, """f1 AS (SELECT family AS a, item AS b, agent, value_key AS variant, min(ts) AS ts FROM m GROUP BY 1, 2, 3, 4), f2 AS (SELECT a, b, variant, count(*) AS agents FROM f1 GROUP BY 1, 2, 3),
 f3 AS (SELECT *, abs(CAST(variant AS DOUBLE)) / CASE WHEN first_value(abs(CAST(variant AS DOUBLE))) OVER w = 0 THEN 1 ELSE first_value(abs(CAST(variant AS DOUBLE))) OVER w END AS ratio FROM f2 WINDOW w AS (PARTITION BY a, b ORDER BY agents DESC, variant)),
 f4 AS (SELECT *, sum(agents) OVER (PARTITION BY a, b) AS total FROM f3 WHERE ratio BETWEEN 0.1 AND 10), f5 AS (SELECT * FROM f4 WHERE agents >= 3 AND agents >= 0.1 * total),
 f6 AS (SELECT a, b, variant FROM f5 QUALIFY count(*) OVER (PARTITION BY a, b) >= 2), ca AS (SELECT f1.* FROM f1 SEMI JOIN f6 USING (a, b, variant))""", SLOTS) + f" SELECT a AS family, b AS item, {_SL} FROM sl")
def dispute_slots(spark, d):
    return _slots(st.value_slots(_mentions(spark, d), AGENT))


@query(_with(BIND, """f1 AS (SELECT family AS a, episode AS b, agent, item AS variant, min(ts) AS ts FROM c WHERE episode IS NOT NULL GROUP BY 1, 2, 3, 4), f2 AS (SELECT a, b, variant, count(*) AS agents FROM f1 GROUP BY 1, 2, 3),
 f4 AS (SELECT *, sum(agents) OVER (PARTITION BY a, b) AS total FROM f2), f5 AS (SELECT * FROM f4 WHERE agents >= 2 AND agents >= 0.1 * total),
 f6 AS (SELECT a, b, variant FROM f5 QUALIFY count(*) OVER (PARTITION BY a, b) >= 2), ca AS (SELECT f1.* FROM f1 SEMI JOIN f6 USING (a, b, variant))""", SLOTS) + f" SELECT a AS family, b AS episode, {_SL} FROM sl WHERE overlap_agents >= 2")
def sequence_slots(spark, d):
    return _slots(st.sequence_slots(_claims(spark, d).withColumn("event_type", F.lit("sequence")), AGENT))


@query(_with("""p AS (SELECT lang AS a, 'opening' AS b, source AS agent, text, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts FROM documents),
 v AS (SELECT a, b, agent, 'the' AS variant, ts FROM p WHERE regexp_matches(text, '\\bthe\\b') AND regexp_matches(text, 'th') UNION ALL SELECT a, b, agent, 'and', ts FROM p WHERE regexp_matches(text, '\\band\\b') AND regexp_matches(text, 'th')),
 ca AS (SELECT a, b, agent, variant, min(ts) AS ts FROM v WHERE a = 'en' GROUP BY 1, 2, 3, 4)""", SLOTS) + f" SELECT a AS family, b AS item, {_SL} FROM sl")
def regex_slots(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("family"), F.col("source").alias("agent"), "text", F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000).alias("ts"))
    return _slots(st.regex_slots(docs, [{"family": "en", "slot": "opening", "context": "th", "variants": {"the": r"\bthe\b", "and": r"\band\b"}}], "agent"))


@query()
def fixed_effects(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("agent"), F.col("l_partkey").cast("string").alias("item_fe"), (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("d"))
    fit = st.two_way_fixed_effects(li, "y", "d")
    return spark.createDataFrame([(fit["n"], fit["agents"], fit["items"], round(fit["beta"], 6), round(fit["se"], 6))], "n bigint, agents bigint, items bigint, beta double, se double")


from . import bind_lifecycle, bind_rooms, bind_scalars, bind_text, bind_windows  # noqa: E402,F401  they register more queries
