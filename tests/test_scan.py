import random

from hearsay.operators import scan


def _plain(rows, by):
    out, last, run = {}, {}, {}
    for k, t, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        key = k if by else 0
        run[key] = run.get(key, 0) + (v or 0)
        out[(k, t)] = (run[key], last.get(key))
        last[key] = v
    return out


def _check(spark, rows, by):
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    keys = ["k"] if by else []
    order = ["t"] if by else ["k", "t"]
    r = scan.ranged(df, order, keys, ranges=7)
    both = scan.previous(scan.running(r, {"sum": scan.F.coalesce("v", scan.F.lit(0))}, order, keys), {"was": "v"}, order, keys)
    got = {(x["k"], x["t"]): (x["sum"], x["was"]) for x in both.collect()}
    assert got == _plain(rows, by)
    assert both.columns == ["k", "t", "v", "__range", "sum", "was"]


def test_hot_key_nulls_and_one_timeline(spark):
    rng = random.Random(3)
    # one key with most rows, one missing, values that are missing
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 11}", i, None if rng.random() < 0.2 else rng.randrange(9)) for i in range(400)]
    rng.shuffle(rows)
    _check(spark, rows, True)
    _check(spark, rows, False)


def test_empty_and_ranks(spark):
    df = spark.createDataFrame([], "t bigint")
    assert scan.ranks(scan.ranged(df, ["t"]), "n", ["t"]).collect() == []
    df = spark.createDataFrame([(5,), (3,), (9,)], "t bigint")
    assert {(r["t"], r["n"]) for r in scan.ranks(scan.ranged(df, ["t"], ranges=3), "n", ["t"]).collect()} == {(3, 1), (5, 2), (9, 3)}


def test_hot_key_spans_ranges(spark):
    df = spark.createDataFrame([("a", i) for i in range(1000)], "k string, t bigint")
    r = scan.ranged(df, ["t"], ["k"], ranges=8)
    assert r.select("__range").distinct().count() > 4
