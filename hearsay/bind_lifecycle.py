"""Deletions, recreations and probes on the driver's tables: a client's changes as
the history of a page, clicks as probes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bindings import query, table
from .operators import lifecycle, scan

#: Deletes and saves of a client; two of three deletes have an edge to the next save in the order of changes.
HISTORY = """
ch AS (SELECT DISTINCT 'c' || client_id AS channel, change_id, op, valid_at AS ts, source FROM client_changes WHERE valid_at IS NOT NULL),
dl AS (SELECT channel, ts, 'd' || change_id AS event_id, change_id, source FROM ch WHERE op = 'D'), rv AS (SELECT channel, ts, CAST(change_id AS VARCHAR) AS rev_id, change_id FROM ch WHERE op <> 'D'),
nx AS (SELECT channel, change_id, op, ts, lead(op) OVER w AS op2, lead(change_id) OVER w AS id2, lead(ts) OVER w AS ts2 FROM ch WINDOW w AS (PARTITION BY channel ORDER BY ts, change_id, op, source)),
rc AS (SELECT channel, ts2 AS ts, 'd' || change_id AS related_event_id, CASE WHEN op2 <> 'D' AND change_id % 3 = 1 THEN CAST(id2 AS VARCHAR) END AS revision_ref FROM nx WHERE op = 'D' AND change_id % 3 <> 0 AND id2 IS NOT NULL),
eg AS (SELECT dl.event_id, dl.ts, dl.source, min((rv.ts, rv.change_id)) FILTER (rv.rev_id IS NOT NULL) AS n FROM dl LEFT JOIN rv ON rv.channel = dl.channel AND rv.ts >= dl.ts GROUP BY dl.event_id, dl.ts, dl.source, dl.channel)
"""


def _changes(spark, d):
    return table(spark, d, "client_changes").where("valid_at is not null").select(F.concat(F.lit("c"), "client_id").alias("channel"), "change_id", "op", F.col("valid_at").alias("ts"), "source").distinct()


def _deletes(spark, d):
    return _changes(spark, d).where("op = 'D'").select("channel", "ts", F.concat(F.lit("d"), "change_id").alias("event_id"), "source")


def _saves(spark, d):
    return _changes(spark, d).where("op <> 'D'").select("channel", "ts", F.col("change_id").cast("string").alias("rev_id"), "change_id", F.lit("").alias("body"))


def _cycle(spark, d):
    w = W.partitionBy("channel").orderBy("ts", "change_id", "op", "source")
    nx = _changes(spark, d).select("*", *[F.lead(c).over(w).alias(f"{c}2") for c in ("op", "change_id", "ts")])
    edge = nx.where("op = 'D' and change_id % 3 <> 0 and change_id2 is not null")
    ref = F.when((F.col("op2") != "D") & (F.col("change_id") % 3 == 1), F.col("change_id2").cast("string"))
    recs = edge.select("channel", F.col("ts2").alias("ts"), F.lit("recreate").alias("action"), F.concat(F.lit("r"), "change_id").alias("event_id"), F.concat(F.lit("d"), "change_id").alias("related_event_id"), ref.alias("revision_ref"))
    dels = _deletes(spark, d).select("channel", "ts", F.lit("delete").alias("action"), "event_id", F.lit(None).cast("string").alias("related_event_id"), F.lit(None).cast("string").alias("revision_ref"))
    return dels.unionByName(recs).select("*", F.lit("a").alias("actor"), (F.col("event_id") != "").alias("page_held"))


@query(f"WITH {HISTORY} SELECT event_id, CAST(n[2] AS VARCHAR) AS rev_id, (epoch_us(n[1]) - epoch_us(ts)) / 1e6 AS gap_s FROM eg")
def recreation_edges(spark, d):
    return lifecycle.recreations(_deletes(spark, d), _saves(spark, d), "change_id").select("event_id", "rev_id", "gap_s")


@query(f"WITH {HISTORY} SELECT source, median((epoch_us(n[1]) - epoch_us(ts)) / 1e6) AS gap_s, count(*) AS n FROM eg WHERE n IS NOT NULL GROUP BY 1")
def recreation_gap_medians(spark, d):
    dels = _deletes(spark, d)
    gaps = lifecycle.recreations(dels.withColumn("event_id", F.struct("event_id", "ts", "source")), _saves(spark, d), "change_id")
    return scan.median(gaps.select("event_id.source", "gap_s"), "gap_s", ["source"]).select("source", "gap_s", "n")


@query(f"""WITH {HISTORY}, told AS (SELECT DISTINCT related_event_id AS e, revision_ref AS r FROM rc WHERE revision_ref <> ''), rule AS (SELECT event_id AS e, CAST(n[2] AS VARCHAR) AS r, max(n[1]) AS t FROM eg WHERE n IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT told.e IS NOT NULL AS a, rule.e IS NOT NULL AS b, t FROM told FULL JOIN rule USING (e, r))
 SELECT (SELECT count(*) FROM rc) AS dump_edges, count(*) FILTER (a) AS dump_edges_with_revision, (SELECT count(*) FROM rc) - count(*) FILTER (a) AS dump_edges_without_revision, count(*) FILTER (b) AS pipeline_edges, count(*) FILTER (a AND b) AS overlap,
  count(*) FILTER (NOT a) AS pipeline_only, count(*) FILTER (NOT a AND t > TIMESTAMP '2024-04-01') AS pipeline_only_after_cutoff, count(*) FILTER (NOT b) AS dump_only FROM j""")
def recreation_check(spark, d):
    return lifecycle.recreation_check(_saves(spark, d), _cycle(spark, d), None, "2024-04-01", "change_id")


@query(f"""WITH {HISTORY}, x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM dl WINDOW w AS (ORDER BY ts, channel)), y AS (SELECT sum(fresh) OVER (ORDER BY ts, channel) AS sweep FROM x), z AS (SELECT count(*) AS n FROM y GROUP BY sweep),
 gp AS (SELECT (epoch_us(rc.ts) - epoch_us(g.ts)) / 3.6e9 AS h FROM rc JOIN (SELECT event_id, max(ts) AS ts FROM dl GROUP BY 1) g ON g.event_id = rc.related_event_id)
 SELECT count(*) AS deletions, count(DISTINCT channel) AS pages, (SELECT count(*) FROM z) AS sweeps_30, (SELECT max(n) FROM z) AS largest_30, (SELECT median(n) FROM z) AS sweep_median,
  (SELECT count(*) FROM rc) AS n_recreate, (SELECT count(*) FROM rc WHERE revision_ref <> '') AS recreate_with_revision, (SELECT round(median(h), 6) FROM gp) AS recreate_gap_median_h FROM dl""")
def deletion_totals(spark, d):
    out = lifecycle.deletion_summary(_cycle(spark, d))
    return out.select("deletions", "pages", "sweeps_30", "largest_30", "sweep_median", "n_recreate", "recreate_with_revision", F.round("recreate_gap_median_h", 6).alias("recreate_gap_median_h"))


#: Clicks as probes: every eleventh one carries markup.
PROBES = """pb AS (SELECT ts, 'ip' || (client_id % 97) AS ip16, CASE WHEN click_id % 11 = 0 THEN '<' || kind || (click_id % 5) || '>' ELSE kind END AS request_action, value > 50 AS success_observed, CASE WHEN click_id % 3 = 0 THEN kind END AS cotimed_label FROM clicks)"""


def _probes(spark, d):
    c, i = table(spark, d, "clicks"), F.col("click_id")
    return c.select("ts", F.concat(F.lit("ip"), F.col("client_id") % 97).alias("ip16"), F.when(i % 11 == 0, F.concat(F.lit("<"), "kind", i % 5, F.lit(">"))).otherwise(F.col("kind")).alias("request_action"), (F.col("value") > 50).alias("success_observed"), F.when(i % 3 == 0, F.col("kind")).alias("cotimed_label"))


@query(f"""WITH {PROBES}, dy AS (SELECT strftime(ts, '%Y-%m-%d') AS k, count(*) AS c FROM pb WHERE ts IS NOT NULL GROUP BY 1), ip AS (SELECT ip16 AS k, count(*) AS c FROM pb WHERE ip16 IS NOT NULL GROUP BY 1)
 SELECT count(*) AS n, count(DISTINCT ip16) AS n_ip16, count(*) FILTER (success_observed) AS n_success, count(cotimed_label) AS n_cotimed, count(DISTINCT request_action) FILTER (contains(request_action, '<')) AS n_payloads, count(*) FILTER (contains(request_action, '<')) AS with_payload,
  (SELECT k FROM dy ORDER BY c DESC, k LIMIT 1) AS top_day, (SELECT max(c) FROM dy) AS top_day_n, (SELECT k FROM ip ORDER BY c DESC, k LIMIT 1) AS top_ip16, (SELECT max(c) FROM ip) AS top_ip16_n FROM pb""")
def probe_totals(spark, d):
    return lifecycle.probe_totals(_probes(spark, d)).drop("first", "last")


@query(f"WITH {PROBES} SELECT CASE WHEN contains(request_action, '<') THEN '<payload>' ELSE request_action END AS action, count(*) AS probes FROM pb GROUP BY 1")
def probe_actions(spark, d):
    return lifecycle.probe_actions(_probes(spark, d))
