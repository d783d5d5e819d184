import json

from hearsay.operators import model_claims as mc

POSTS = "event_id string, family string, author_raw string, channel string, text string"
RULES = "claim_id string, event_id string, family string, episode double, item string, value_norm string, event_type string, latency_class string, timer_s double, wrong_flag boolean, correct_flag boolean, extractor string"


def test_candidates_need_a_family_and_a_keyword(spark):
    rows = [("a", "f", "Submitted it"), ("b", "", "answered 5"), ("c", "f", "see G3 here"), ("d", "f", "FOG3X and bag"), ("e", None, "R3"), ("f", "f", None), ("g", "f", "we EXPECTED rain")]
    p = spark.createDataFrame([(i, f, "A", "c", t) for i, f, t in rows], POSTS)
    assert {r["event_id"] for r in mc.candidates(p).collect()} == {"a", "c", "g"}


def test_a_reply_is_cached_and_fills_what_the_rules_leave(spark):
    long = "R3 CONFIRMED: Poland arrived; answered instantly " + "x" * 10_000 + " END"
    p = spark.createDataFrame([("e1", "oecd", "A", "c", long)], POSTS)

    def client(text):
        assert text.startswith("Task family: oecd\nAuthor: A\nChannel: c\nPost:\n") and text.endswith(" END")
        return {"claims": [{"event_type": "answer", "episode": 3, "item": "poland", "value": None, "latency_class": "instant", "wrong": True}], "independent_claim": True}

    first = mc.ask(p, client, "m")
    kept = spark.createDataFrame(first.collect(), first.schema)
    assert kept.count() == 1 and mc.ask(p, client, "m", kept).count() == 0 and mc.ask(p, client, "other", kept).count() == 1
    rule = spark.createDataFrame([("r", "e1", "oecd", None, "Poland", "16.4", "answer", None, 56.0, False, False, "rule")], RULES)
    got = mc.merge(rule, mc.parse(kept)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["value_norm"], r["latency_class"], r["episode"], r["timer_s"], r["wrong_flag"], r["extractor"]) == ("16.4", "instant", 3.0, 56.0, True, "llm:m+rule")
    flags = mc.post_flags(kept).first()
    assert flags["is_independent"] and not flags["disputes_value"]


def test_replies_of_any_form(spark):
    replies = [("list", json.dumps([{"item": "P", "value_raw": "5"}])), ("none", json.dumps({"claims": []})), ("broken", "no json"), ("empty", None), ("two", json.dumps({"claims": [{"event_type": "prediction", "item": "MA", "value": "7", "correct": True, "timer_s": 3}, {"event_type": "answer"}], "disputes_value": True}))]
    r = spark.createDataFrame(replies, "event_id string, reply string")
    got = sorted((x["event_id"], x["event_type"], x["item"], x["value_raw"], x["correct_flag"], x["timer_s"]) for x in mc.parse(r).collect() if x["item"])
    assert got == [("list", "answer", "P", "5", False, None), ("two", "prediction", "Massachusetts", "7", True, 3.0)]
    ids = [x["claim_id"] for x in mc.parse(r).collect()]
    assert len(set(ids)) == len(ids) == 3
    assert {x["event_id"] for x in mc.post_flags(r).where("disputes_value").collect()} == {"two"}
