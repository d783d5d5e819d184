import datetime

import pytest
from hearsay.functions import items, repair
from hearsay.functions import text as tx
from hearsay.operators import extract
from hearsay.operators.lifecycle import split_posts
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("16.40%", "16.4"), ("20,369", "20369"), ("874,322;951,258", "874322/951258"), ("18.2/13.5", "18.2/13.5"), ("9.70", "9.7"), ("", None), ("x", None), (None, None)])
def test_norm_value(spark, raw, want):
    assert one(spark, raw, tx.norm_value) == want


@pytest.mark.parametrize(("seg", "want"), [("681115,693859,702337", "681115"), ("2015-20 = 457639,460507", "457639"), ("12:12:43/44 then 9.9", "9.9"), ("#3 Business 5,269", "5,269"), ("in 2015", None), ("", None), (None, None)])
def test_first_value(spark, seg, want):
    assert one(spark, seg, tx.first_value) == want


@pytest.mark.parametrize(("tok", "want"), [("12m18s", 738.0), ("56s", 56.0), ("30 sec", 30.0), ("x", None), (None, None)])
def test_seconds_of(spark, tok, want):
    assert one(spark, tok, tx.seconds_of) == want


def test_clock_seconds(spark):
    assert one(spark, "03:14:08", tx.clock_seconds) == 11648 and one(spark, "14:08", tx.clock_seconds) == 848


@pytest.mark.parametrize(("tok", "want"), [("[CREDENTIAL 1]", "CREDENTIAL"), ("[SERVICE 2 URL 1]", "SERVICE URL"), ("[REDACTED:destination:000002]", "destination"), ("[000123]", "(unlabelled)")])
def test_placeholder(spark, tok, want):
    assert one(spark, tok, tx.placeholder_category) == want


@pytest.mark.parametrize(("lit", "known"), [("2026-06-01T10:00:00Z", True), ("2026-06-01T10:00:00+02:00", True), ("1780000000", True), ("1780000000.25", True), ("20260601101112", True), ("current", False), ("", False), ("v1.2", False), ("12", False), (None, False)])
def test_date_literal(spark, lit, known):
    assert (one(spark, lit, tx.date_literal) is not None) == known


def test_roster_timestamps(spark):
    for bad in ("37:49.4", "15:59", "null", None):
        assert one(spark, bad, tx.roster_timestamp) is None
    for good in ("2026-06-01 10:00", "7/6/2026 9:05", "1780000000", "1780000000000"):
        assert one(spark, good, tx.roster_timestamp) is not None


@pytest.mark.parametrize(("bad", "good"), [("TÃ¼rkiye", "Türkiye"), ("TÃƒÂ¼rkiye", "Türkiye"), ("plain", "plain"), (None, None)])
def test_repair(spark, bad, good):
    assert one(spark, bad, repair.repaired) == good


def test_era_label(spark):
    f = lambda n: lambda c: tx.era_label(F.lit(n), c)
    assert one(spark, "Form two teams and debate", f(17)) == "e17-form-two-teams"
    assert one(spark, "your own", f(5)) == "e05-goal"


def test_pacific(spark):
    def at(s):
        return one(spark, s, lambda c: F.date_format(tx.pacific_to_utc(c.cast("timestamp")), "yyyy-MM-dd HH:mm"))

    assert at("2025-07-01 12:00:00") == "2025-07-01 19:00" and at("2025-12-01 12:00:00") == "2025-12-01 20:00"
    assert at("2025-11-02 01:30:00") is None  # shown twice
    assert at("2025-03-09 02:30:00") == "2025-03-09 10:00"  # skipped


def test_find_iter(spark):
    import re

    for text in ("R1 R2,R3", "", "x", "é R5 — R6", "R1R2"):
        got = [(m["at"], m["tok"]) for m in one(spark, text, lambda c: tx.find_iter(c, tx.rx(r"(?<!\w)R[0-9]")))]
        assert got == [(m.start(), m.group()) for m in re.finditer(r"(?<!\w)R[0-9]", text)]


def test_items(spark):
    find = lambda c: items.ItemMatcher({"f": ["Business"]}).find(F.lit("f"), c)
    got = lambda s: [(m["at"], m["item"]) for m in one(spark, s, find)]
    assert got("Poland then Türkiye and KY confirmed") == [(0, "Poland"), (12, "Turkey"), (24, "Kentucky")]
    assert got("Business 5, Business MI 3") == [(0, "Business"), (12, "Business")]
    assert got("OK 5 IN 3") == [] and got("") == []


def test_split_posts(spark):
    body = "First line\n-- AgentA\nsecond\n\nthird -- AgentB"
    assert one(spark, body, split_posts) == ["First line\n-- AgentA", "second", "third -- AgentB"]


def posts(spark, *texts):
    rows = [(str(i), datetime.datetime(2026, 1, 1), "c", "A", "a", "a", "oecd", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "event_id string, ts timestamp, channel string, author_raw string, agent_strict string, agent_merged string, family string, text string")


def test_answers(spark):
    p = posts(spark, "R3 CONFIRMED: Poland arrived 19:43:07; timer 56s; answered 16.40% instantly.", "R2 Hungary arrived 03:14:08, answered 9.9 at 03:20:36", "Did anyone answered Poland yet?", "nothing", "")
    got = {r["event_id"]: r for r in extract.answer_claims(p, items.ItemMatcher()).collect()}
    assert set(got) == {"0", "1"}
    a, b = got["0"], got["1"]
    assert (a["item"], a["value_norm"], a["episode"], a["latency_class"], a["timer_s"]) == ("Poland", "16.4", 3.0, "instant", 56.0)
    assert (b["item"], b["latency_class"], b["latency_s"]) == ("Hungary", "delayed", 388.0)


def test_sequence_and_equation(spark):
    p = posts(spark, "G5 CONFIRMED: Montana = 8553", "R4 deadline Poland")
    c = extract.claims(p, items.ItemMatcher()).collect()
    assert {(r["event_type"], r["item"], r["episode"]) for r in c} == {("answer", "Montana", 5.0), ("sequence", "Montana", 5.0)}


def test_names_of_a_list(spark):
    from hearsay.functions.text import names_list

    rows = [(" a , 1 b;c 0 ,",), ('["x, y", "z"]',), ("[broken",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(names_list(F.col("v"))).collect()]
    assert got == [["a", "1 b", "c 0"], ["x, y", "z"], [], [], []]
