import datetime
import math

import numpy as np
from hearsay.operators import facts, lifecycle, model_claims, relay, roster, trees, windows
from hearsay.plans import statistics as st
from hearsay.plans import validation

T0 = datetime.datetime(2026, 6, 1, 8)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def mentions(spark, *rows):
    """(agent, seconds, channel, value, visible until)"""
    out = [(str(i), at(s), a, a, c, "f", "i", v, v, None if u is None else at(u)) for i, (a, s, c, v, u) in enumerate(rows)]
    return spark.createDataFrame(out, "event_id string, ts timestamp, agent_strict string, agent_merged string, channel string, family string, item string, value_norm string, value_key string, visible_until timestamp")


def rounds(spark, agent, s, value):
    return spark.createDataFrame([("c1", agent, "f", "i", 1.0, value, at(s), "instant", None, False, False, 1)], "claim_id string, agent string, family string, item string, episode double, value_norm string, t_report timestamp, latency_class string, timer_s double, wrong_flag boolean, correct_flag boolean, n_reports bigint")


def none(spark):
    return spark.createDataFrame([], "family string, item string, consensus_value string")


def test_featured_slots_beyond_the_largest(spark):
    from hearsay.plans import report
    from hearsay.sources.base import AdapterConfig

    rows = [(f"a{a}", "f", f"i{i:02}", v, at(a)) for i in range(14) for v in ("x", "y") for a in range(3 + (i < 13))]
    m = spark.createDataFrame(rows, "agent string, family string, item string, value_key string, ts timestamp")
    seq = [(f"a{a}", "g", float(e), v, at(a), "sequence") for e in range(1, 9) for v in ("x", "y") for a in range(2 + (e < 8))]
    c = spark.createDataFrame(seq, "agent string, family string, episode double, item string, ts timestamp, event_type string")
    said = spark.createDataFrame([("f", "a1", "G5 is Maryland", at(1)), ("f", "a2", "G5 is Montana", at(2)), ("f", "a3", "Montana", at(3))], "family string, agent string, text string, ts timestamp")
    cfg = AdapterConfig(featured_disputes=(("f", "i13"), ("g", "R8")), disputes=({"family": "f", "slot": "G5", "context": r"\bG5\b", "variants": {"md": "Maryland", "mt": "Montana"}},))
    value, sequence, picked = report.competing(m, c, said, cfg, "agent")
    assert len(value) == 12 and len(sequence) == 6
    assert [(r["family"], r.get("item", r.get("episode"))) for r in picked] == [("f", "G5"), ("f", "i13"), ("g", 8.0), ("f", "i00")] and picked[0]["n_carriers"] == 2


def test_deleted_copy(spark):
    m = mentions(spark, ("B", 0, "p", "1", 50), ("C", 60, "q", "1", None))
    x = facts.exposures(rounds(spark, "A", 100, "1"), m, none(spark), "agent_merged").first()
    assert (x["D"], x["src_agent"], x["D_visible"], x["src_deleted_before_report"], x["gap_s"]) == (1, "B", 1, 1, 100.0)
    x = facts.exposures(rounds(spark, "A", 55, "1"), m, none(spark), "agent_merged").first()
    assert (x["D"], x["D_visible"], x["src_deleted_before_report"]) == (1, 0, 1)


def test_own_copy_and_equal_time_do_not_expose(spark):
    m = mentions(spark, ("A", 0, "p", "1", None), ("B", 100, "p", "1", None))
    x = facts.exposures(rounds(spark, "A", 100, "1"), m, none(spark), "agent_merged").first()
    assert (x["D"], x["self_prepared"], x["y_consensus"]) == (0, 1, None)


def test_audience(spark):
    m = mentions(spark, ("B", 0, "best", "1", None))
    who = lambda a: spark.createDataFrame([("best", a)], "channel string, agent string")
    assert facts.exposures(rounds(spark, "A", 10, "1"), m, none(spark), "agent_merged", who("A")).first()["D"] == 1
    assert facts.exposures(rounds(spark, "A", 10, "1"), m, none(spark), "agent_merged", who("Z")).first()["D"] == 0


def test_relay_clock(spark):
    e = relay.relay_edges(mentions(spark, ("A", 0, "p", "1", None), ("B", 1, "p", "1", None), ("C", 30, "p", "1", None)), "agent_merged")
    got = {(r["src"], r["dst"]): (r["kind"], r["within_clock_res"]) for r in e.collect()}
    assert got == {("A", "B"): ("relay", True), ("B", "C"): ("relay", False)}


def test_empty_mentions(spark):
    m = mentions(spark)
    assert relay.relay_edges(m, "agent_merged").count() == 0 and relay.relay_chains(m, "agent_merged").count() == 0
    assert facts.exposures(rounds(spark, "A", 10, "1"), m, none(spark), "agent_merged").first()["D"] == 0
    assert relay.gini(relay.degrees(relay.relay_edges(m, "agent_merged")), "out_degree").first()["gini"] is None


def test_sweeps(spark):
    d = spark.createDataFrame([("c", "delete", at(60 * m)) for m in (0, 5, 50, 55, 300)], "channel string, action string, ts timestamp")
    sizes = lambda gap: [r["n"] for r in windows.sweeps(d, gap).orderBy("start").collect()]
    assert sizes(30) == [2, 2, 1] and sizes(60) == [4, 1]


def test_snapshots(spark):
    revs = spark.createDataFrame([("p", at(0), "r1", "x", "one -- AgentA"), ("p", at(10), "r2", "x", "one -- AgentA\n\ntwo -- AgentB"), ("p", at(30), "r3", "x", "one -- AgentA")], "channel string, ts timestamp, rev_id string, author_alt string, body string")
    dels = spark.createDataFrame([("p", at(20))], "channel string, ts timestamp")
    got = [(r["author_raw"], r["visible_until"]) for r in lifecycle.snapshots_to_posts(revs, dels).orderBy("ts").collect()]
    assert got == [("AgentA", at(20)), ("AgentB", at(20)), ("AgentA", None)]


def test_betweenness(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in relay.betweenness(path).collect()}
    assert got["a"] == got["d"] == 0 and math.isclose(got["b"], 2 / 6) and math.isclose(got["c"], 2 / 6)
    star = spark.createDataFrame([("a", "h"), ("b", "h"), ("h", "c")], "src string, dst string")
    assert math.isclose({r["node"]: r["betweenness"] for r in relay.betweenness(star).collect()}["h"], 2 / 6)


def test_fixed_effects_against_dummies(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{a}", f"i{i}", float(0.5 * d + a * 0.1 - i * 0.2 + rng.normal() * 0.1), int(d)) for a in range(14) for i in range(6) for d in [rng.integers(0, 2)]]
    fit = st.two_way_fixed_effects(spark.createDataFrame(rows, "agent string, item_fe string, y double, d int"), "y", "d")
    x = np.zeros((len(rows), 1 + 14 + 5))
    for k, (a, i, _, d) in enumerate(rows):
        x[k, 0], x[k, 1 + int(a[1:])] = d, 1
        if int(i[1:]):
            x[k, 14 + int(i[1:])] = 1
    beta = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0][0]
    assert math.isclose(fit["beta"], beta, abs_tol=1e-6) and fit["p"] < 0.01 and fit["n"] == len(rows)


def test_t_distribution():
    assert math.isclose(st.t_quantile(59), 2.0010, abs_tol=1e-3) and math.isclose(st.t_two_sided(2.0010, 59), 0.05, abs_tol=1e-4)


def test_km(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 2.0, 0), ("k", 3.0, 1)], "g string, t double, e int")
    assert [(r["t"], r["survival"]) for r in st.kaplan_meier(df, "t", "e", ["g"]).orderBy("t").collect()] == [(0.0, 1.0), (1.0, 2 / 3), (3.0, 0.0)]


def test_trees(spark):
    r = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", "1"), ("5", "x"), ("6", "7"), ("7", "6")], "id string, parent_id string")
    got = trees.tree_summary(r).first()
    assert (got["roots"], got["children"], got["orphans"], got["max_fan_out"]) == (1, 5, 1, 2)
    assert {x["id"]: x["depth"] for x in trees.depths(trees.edges(r)).collect()}["3"] == 2


def test_model_merge(spark):
    kind = "claim_id string, event_id string, event_type string, item string, value_norm string, extractor string"
    rules = spark.createDataFrame([("r1", "1", "answer", "P", "5", "rule"), ("r2", "2", "answer", "Q", "6", "rule")], kind)
    ai = spark.createDataFrame([("m1", "1", "answer", "P", None, "llm")], kind)
    got = sorted((r["event_id"], r["value_norm"], r["extractor"]) for r in model_claims.merge(rules, ai).collect())
    assert got == [("1", "5", "llm+rule"), ("2", "6", "rule")]


def test_model_cache(spark):
    posts = spark.createDataFrame([("1", "answered 5"), ("2", "hello"), ("3", "answered 6")], "event_id string, text string")
    cache = spark.createDataFrame([("m", "3", "[]")], "model string, event_id string, reply string")
    got = model_claims.ask(posts, lambda t: [{"item": "P", "value_raw": "5"}], "m", cache)
    assert [r["event_id"] for r in got.collect()] == ["1"]
    assert [r["item"] for r in model_claims.parse(got).collect()] == ["P"]


def test_scores(spark):
    kind = "event_id string, i int, item string, value_norm string, episode double, latency_class string"
    gold = spark.createDataFrame([("1", 0, "P", "5", 1.0, None), ("2", 0, "Q", "6", 2.0, "instant")], kind)
    got = spark.createDataFrame([("1", 0, "p", "5/6", 1.0, None), ("2", 0, "R", "6", 3.0, "instant")], kind)
    acc = {r["field"]: r["accuracy"] for r in validation.field_accuracy(gold, got).collect()}
    assert acc == {"item": 0.5, "value": 1.0, "round": 0.5, "latency": 1.0}


def test_eras(spark):
    rows = spark.createDataFrame([("1", "Form two teams", "2026-06-01", "2026-06-02"), ("2", "Debate", "2026-06-03", None)], "id string, goal string, start_time string, end_time string")
    e = roster.eras(rows)
    assert [r["label"] for r in e.orderBy("start").collect()] == ["e01-form-two-teams", "e02-debate"]
    s = roster.eras_summary(e).first()
    assert (s["n"], s["n_open"], s["n_gaps"], s["n_overlaps"]) == (2, 1, 1, 0)


def test_digest(spark):
    text = "1. [2025-07-01 12:00 PT] o3 posted a plan\n<quote>o3: done [2025-07-01 13:00 UTC]</quote>"
    s = roster.summaries(spark.createDataFrame([(1, "daily", "5", "2025-07-01", "2025-07-02", text)], "id int, type string, summary_target string, summary_date string, created_at string, content string"))
    people = spark.createDataFrame([("a1", "o3"), ("a2", "o")], "agent_id string, name string")
    got = {r["kind"]: (r["actor"], str(r["ts"])) for r in roster.parse_digest(s, people).collect()}
    assert got == {"event": ("o3", "2025-07-01 19:00:00"), "quote": ("o3", "2025-07-01 13:00:00")}
