"""Keyed interval joins against loops over all windows of a key."""

import datetime
import random

from hearsay.operators import windows

T0 = datetime.datetime(2026, 6, 1)
EARLY = datetime.datetime(1, 1, 1)


def _at(h):
    return None if h is None else T0 + datetime.timedelta(hours=h)


def _inside(t, a, b):
    return (a is None or t is not None and a <= t) and (b is None or t is not None and t < b)


def _plain(events, wins):
    out = {}
    for e, k, t in events:
        mine = [w for w in wins if w[0] == k and k is not None]
        held = [(EARLY if a is None else _at(a), w) for _, w, a, b in mine if _inside(t, a, b)]
        far = [(min((abs(t - x) for x in (a, b) if x is not None and t is not None), default=10**9), w) for _, w, a, b in mine if not _inside(t, a, b)]
        out[e] = (max(held)[1], True) if held else (min(far)[1], False) if far else (None, None)
    return out


def _case(rng, hot):
    keys = ["hot"] * hot + ["a", "b", "c"]
    wins = []
    for i in range(160):
        a = rng.choice([None, *range(0, 3000, 7)]) if i % 9 else rng.choice([50, 100])
        b = None if rng.random() < 0.03 else (a or 0) + rng.choice([0, 3, 40, 40, 600])
        wins.append((rng.choice(keys) if i > 8 else "nested", f"w{i}", a if i > 8 else 10 * i, b if i > 8 else 2000 - 100 * i))
    if not hot:
        wins.append(("edgeless", "w999", None, None))
    events = [(i, rng.choice([*keys, "nested", "edgeless", "nobody", None]), None if rng.random() < 0.02 else rng.randrange(-100, 3300)) for i in range(700)]
    return events, wins


def test_window_join(spark):
    for hot in (0, 9):
        events, wins = _case(random.Random(hot), hot)
        e = spark.createDataFrame([(i, k, _at(t), 1) for i, k, t in events], "event_id int, k string, ts timestamp, h int")
        w = spark.createDataFrame([(k, i, _at(a), _at(b)) for k, i, a, b in wins], "k string, w string, start timestamp, end timestamp")
        want = _plain(events, wins)
        for bucket_s in (86400, 30 * 86400):
            got = {r["event_id"]: (r["w"], r["in_window"]) for r in windows.window_join(e, w, "k", "w", bucket_s=bucket_s).collect()}
            assert {i: (got[i], v) for i, v in want.items() if got[i] != v} == {}
        inside = {r["event_id"] for r in windows.in_any_window(e, w, "k").collect()}
        assert inside == {i for i, v in want.items() if v[1]}
        assert windows.in_any_window(e, w, "k").columns == e.columns


def test_no_windows_and_repeated_events(spark):
    e = spark.createDataFrame([(1, "a", T0), (1, "a", T0 + datetime.timedelta(hours=5)), (2, "a", None)], "event_id int, k string, ts timestamp")
    w = spark.createDataFrame([], "k string, w string, start timestamp, end timestamp")
    assert {(r["event_id"], r["w"], r["in_window"]) for r in windows.window_join(e, w, "k", "w").collect()} == {(1, None, None), (2, None, None)}
    w = spark.createDataFrame([("a", "x", T0 + datetime.timedelta(hours=4), None)], "k string, w string, start timestamp, end timestamp")
    # an id on two rows is one event: it is held if one of them is
    assert {(r["event_id"], r["w"], r["in_window"]) for r in windows.window_join(e, w, "k", "w").collect()} == {(1, "x", True), (2, "x", False)}


def test_only_frequent_keys_are_cut(spark, monkeypatch):
    """A key with most rows is cut into buckets of time, the others are not; results are those of the loop."""
    monkeypatch.setattr(windows, "LOOK", 1.0)
    events, wins = _case(random.Random(5), 9)
    e = spark.createDataFrame([(i, k, _at(t)) for i, k, t in events], "event_id int, k string, ts timestamp")
    w = spark.createDataFrame([(k, i, _at(a), _at(b)) for k, i, a, b in wins], "k string, w string, start timestamp, end timestamp")
    want = _plain(events, wins)
    for often, cut in ((1000, {"hot", "a", "b", "c", "nested", "edgeless", "nobody"}), (2, {"hot"})):
        monkeypatch.setattr(windows, "OFTEN", often)
        assert {r["__key"] for r in windows._often(e.select(e.k.alias("__key"))).collect()} == cut
        got = {r["event_id"]: (r["w"], r["in_window"]) for r in windows.window_join(e, w, "k", "w", bucket_s=86400).collect()}
        assert {i: (got[i], v) for i, v in want.items() if got[i] != v} == {}


def test_empty_windows_do_not_ask_the_tree(spark, monkeypatch):
    """Of two windows that start together the one that ends there holds nothing, whatever its name."""
    monkeypatch.setattr(windows, "era_join", lambda *a: (_ for _ in ()).throw(AssertionError("no point is behind the last window")))
    w = [(k, f"{n}{k}", _at(a), _at(b)) for k in range(20) for n, a, b in (("a", 0, 5), ("z", 5, 5), ("b", 5, None))]
    e = spark.createDataFrame([(i, i % 20, _at(3 + i // 20 * 4)) for i in range(40)], "event_id int, k int, ts timestamp")
    got = {r["event_id"]: (r["w"], r["in_window"]) for r in windows.window_join(e, spark.createDataFrame(w, "k int, w string, start timestamp, end timestamp"), "k", "w").collect()}
    assert got == {i: (f"{'ab'[i // 20]}{i % 20}", True) for i in range(40)}
