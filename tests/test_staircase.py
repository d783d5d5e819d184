import datetime
import random

from hearsay.operators.staircase import first_open

T0 = datetime.datetime(2026, 6, 1)


def _at(s):
    return None if s is None else T0 + datetime.timedelta(seconds=s)


def _plain(questions, copies):
    out = {}
    for key, q, who, at in questions:
        seen = [t for k, c, t, u in copies if k == key and c != who and t < at and (u is None or u > at)]
        out[q] = min(seen, default=None)
    return out


def test_against_plain_with_a_hot_key(spark):
    rng = random.Random(1)
    keys = ["hot"] * 8 + ["a", "b", None]
    copies = [(rng.choice(keys), f"c{rng.randrange(6)}", t := rng.randrange(300), rng.choice([t + rng.randrange(60), t + 5, t - 3, None if rng.random() < 0.02 else t])) for _ in range(500)]
    questions = [(rng.choice([*keys, "none"]), i, f"c{rng.randrange(8)}", rng.randrange(330)) for i in range(600)]
    c = spark.createDataFrame([(k, w, _at(t), _at(u)) for k, w, t, u in copies], "k string, carrier string, ts timestamp, until timestamp")
    q = spark.createDataFrame([(k, i, w, _at(t)) for k, i, w, t in questions], "k string, q int, agent string, at timestamp")
    want = {i: _at(v) for i, v in _plain(questions, copies).items()}
    for bucket_s in (7, 10**6):
        got = {r["q"]: r["first_open"] for r in first_open(q, c, ["k"], ["q"], bucket_s).collect()}
        assert got == want
    assert any(v is None for v in want.values()) and len(set(want.values())) > 20


def test_nothing(spark):
    c = spark.createDataFrame([], "k string, carrier string, ts timestamp, until timestamp")
    q = spark.createDataFrame([("k", 1, "a", T0)], "k string, q int, agent string, at timestamp")
    assert [r["first_open"] for r in first_open(q, c, ["k"], ["q"]).collect()] == [None]
    assert first_open(q.limit(0), c, ["k"], ["q"]).collect() == []
