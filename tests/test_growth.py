"""Steps whose volume must not outgrow the input."""

import datetime

from hearsay.operators import relay, windows
from hearsay.plans import statistics as st

T0 = datetime.datetime(2026, 6, 1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_searches_meet_one_table_of_what_they_reached(spark, monkeypatch):
    """Betweenness: the plan of a level does not grow with the levels before it."""
    plans, write = [], relay.checkpoint
    monkeypatch.setattr(relay, "checkpoint", lambda df: (plans.append(_plan(df)), write(df))[1])
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in relay.betweenness(edges).collect()}
    assert all(abs(got[f"n{i}"] - i * (8 - i) / 56) < 1e-12 for i in range(9))
    assert max(p.count("LogicalRDD") for p in plans) <= 4


def test_a_level_of_searches_is_one_shuffle(spark, monkeypatch):
    """Betweenness: a level is written once, from one shuffle; nothing is checkpointed for it."""
    checkpoints, plans, cut, write = [], [], relay.checkpoint, relay.written
    monkeypatch.setattr(relay, "checkpoint", lambda df: (checkpoints.append(1), cut(df))[1])
    monkeypatch.setattr(relay, "written", lambda df: (plans.append(_plan(df)), write(df))[1])
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in relay.betweenness(edges).collect()}
    assert all(abs(got[f"n{i}"] - i * (12 - i) / 132) < 1e-12 for i in range(13))
    assert len(checkpoints) <= 3 and all(p.count("RepartitionByExpression") == 1 and "Aggregate" not in p for p in plans[2:])


def test_searches_beyond_one_slab(spark):
    """Betweenness: 1,102 sources are three rows a node."""
    edges = spark.createDataFrame([(f"a{i}", "hub") for i in range(1100)] + [("hub", "z")], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in relay.betweenness(edges, pivots=None).collect()}
    assert abs(got.pop("hub") - 1100 / (1101 * 1100)) < 1e-12 and set(got.values()) == {0.0}


def test_an_agent_s_searches_fill_more_than_one_mask(spark):
    """Betweenness: 130 sources need three masks a node."""
    edges = spark.createDataFrame([(f"a{i}", "hub") for i in range(129)] + [("hub", "z")], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in relay.betweenness(edges).collect()}
    assert abs(got.pop("hub") - 129 / (130 * 129)) < 1e-12 and set(got.values()) == {0.0}


def test_only_windows_of_late_keys_enter_the_tree(spark, monkeypatch):
    """Goal windows: one key of fifty has a point behind the end of its last window to start."""
    asked, join = [], windows.era_join
    monkeypatch.setattr(windows, "era_join", lambda events, eras, *more: (asked.append(eras.count()), join(events, eras, *more))[1])
    day = lambda n: T0 + datetime.timedelta(days=n)
    spans = [(f"k{i}", f"w{i}", day(0), day(300)) for i in range(50)] + [("k7", "short", day(10), day(12))]
    spans = spark.createDataFrame(spans, "k string, w string, start timestamp, end timestamp")
    events = spark.createDataFrame([(f"e{i}", f"k{i}", day(40)) for i in range(50)], "event_id string, k string, ts timestamp")
    got = {r["event_id"]: (r["w"], r["in_window"]) for r in windows.window_join(events, spans, "k", "w").collect()}
    assert got == {f"e{i}": (f"w{i}", True) for i in range(50)}
    assert windows.in_any_window(events, spans, "k").count() == 50
    assert asked == [2, 2]


def test_an_event_goes_to_its_window_once(spark, tmp_path):
    """Era join: events are read for their buckets, for the tree and for the edges, not to be kept once more."""
    path = str(tmp_path / "events")
    spark.createDataFrame([(f"e{i}", T0 + datetime.timedelta(days=i)) for i in range(9)] + [(None, T0), ("timeless", None)], "event_id string, ts timestamp").write.parquet(path)
    eras = spark.createDataFrame([("a", T0, T0 + datetime.timedelta(days=2)), ("b", T0 + datetime.timedelta(days=1, hours=3), T0 + datetime.timedelta(days=4, hours=1))], "era_id string, start timestamp, end timestamp")
    out = windows.era_join(spark.read.parquet(path), eras, 86400)
    assert {r["event_id"]: r["era_id"] for r in out.collect()} == {"e0": "a", "e1": "a", "e2": "b", "e3": "b", "e4": "b", "timeless": None, None: "a"} | {f"e{i}": None for i in range(5, 9)}
    assert _plan(out).count("parquet") <= 3
    # the table of buckets goes to the events, whatever its estimated size
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert windows.era_join(spark.read.parquet(path), eras, 86400)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_single_rows_leave_without_a_window_over_rows(spark, monkeypatch):
    """Fixed effects: rows shrink to cells before agents and items are counted."""
    import hearsay.store as store

    plans, write = [], store.checkpoint
    monkeypatch.setattr(store, "checkpoint", lambda df: (plans.append(_plan(df)), write(df))[1])
    rows = [(f"a{a}", f"i{i}", float(a * i % 5), (a + i) % 2) for a in range(12) for i in range(4)]
    rows += [("alone", "i0", 9.0, 1), ("a0", "rare", 9.0, 1), ("b", "rarer", 1.0, 0), ("b", "i1", 1.0, 0), (None, "i2", 1.0, 0)]
    fit = st.two_way_fixed_effects(spark.createDataFrame(rows, "agent string, item_fe string, y double, d int"), "y", "d")
    assert (fit["n"], fit["agents"], fit["items"]) == (49, 13, 4)
    assert not any("Window" in p for p in plans)
