"""The window queries over all of orders and lineitem, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from hearsay import bindings
from hearsay.operators import windows

DAY = datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    orders = [(k, rng.randrange(1, 13), rng.choice(["1-URGENT", "5-LOW"]), DAY + timedelta(days=rng.randrange(300))) for k in range(1, 81)]
    items = [(rng.choice(orders)[0], n, n, n, DAY + timedelta(days=rng.randrange(400))) for n in range(200)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    return d, orders, items


def goals(orders):
    """(customer, goal, start, end): until the customer's next order."""
    out = []
    for c in {o[1] for o in orders}:
        own = sorted((o for o in orders if o[1] == c), key=lambda o: (o[3], o[0]))
        out += [(c, str(o[0]), o[3], own[i + 1][3] if i + 1 < len(own) else None) for i, o in enumerate(own)]
    return out


def shipped(orders, items):
    owner = {o[0]: o[1] for o in orders}
    return [("-".join(map(str, i[:4])), owner[i[0]], i[4]) for i in items]


def holds(start, end, t):
    return (start is None or start <= t) and (end is None or t < end)


def test_goals_of_all_orders(spark, tables):
    d, orders, items = tables
    by_goal, inside = {}, set()
    for e, c, t in shipped(orders, items):
        own = [g for g in goals(orders) if g[0] == c]
        held = [(g[2], g[1]) for g in own if holds(g[2], g[3], t)]
        far = [(min(abs((t - x).total_seconds()) for x in g[2:] if x), g[1]) for g in own]
        by_goal[e] = (max(held)[1], True) if held else (min(far)[1], False)
        inside |= {e} if held else set()
    got = {r["event_id"]: (r["goal_id"], r["in_window"]) for r in bindings.QUERIES["goal_window_join"](spark, d).collect()}
    assert got == by_goal
    assert {r["event_id"] for r in bindings.QUERIES["activity_in_window"](spark, d).collect()} == inside


def test_batches_of_all_orders(spark, tables):
    d, orders, _ = tables
    want = {str(o[0]): o[3].strftime("%b%d") for o in orders}
    assert {r["goal_id"]: r["batch"] for r in bindings.QUERIES["goal_batches"](spark, d).collect()} == want


def test_eras_of_all_orders(spark, tables):
    d, orders, items = tables
    eras = [(o[3], str(o[0]), o[3] + timedelta(days=60) if o[0] % 7 else None) for o in orders]
    want = {e: max(((s, w) for s, w, end in eras if holds(s, end, t)), default=(None, None))[1] for e, _, t in shipped(orders, items)}
    assert {r["event_id"]: r["era_id"] for r in bindings.QUERIES["era_join"](spark, d).collect()} == want


def test_era_join_at_any_time(spark):
    rng = random.Random(4)
    when = lambda: None if rng.random() < 0.1 else DAY + timedelta(seconds=rng.randrange(-40, 900), microseconds=rng.choice([0, 0, 7]))
    events = [(f"e{i}", when()) for i in range(150)]
    for k in (60, 4):
        eras = [(f"w{i}", when(), when()) for i in range(k)] + [("z", None, None)] * (k == 60)
        hit = lambda s, e, t: s is None and e is None if t is None else holds(s, e, t)
        want = {n: max(((s or datetime.min, w) for w, s, e in eras if hit(s, e, t)), default=(None, None))[1] for n, t in events}
        got = windows.era_join(spark.createDataFrame(events, "event_id string, ts timestamp"), spark.createDataFrame(eras, "era_id string, start timestamp, end timestamp"), 60)
        assert {r["event_id"]: r["era_id"] for r in got.collect()} == want
