import datetime
import json

from hearsay import sources
from hearsay.operators import rooms
from hearsay.plans import pipeline, report
from hearsay.schema import RunStore

WEEK = [(0, ["mon", "tue", "wed", "thu", "fri"], "09:00", "17:00")]
KIND = "n int, days array<string>, start string, end string"


def _t(text):
    return datetime.datetime.fromisoformat(text)


def test_hours_of_a_wall_clock(spark):
    # Tuesday 10:00, Tuesday 8:30, Saturday, no time, the last minute, the first one after closing
    times = ["2026-07-07T17:00:00", "2026-07-07T15:30:00", "2026-07-11T18:00:00", None, "2026-07-07T23:59:59", "2026-07-08T00:00:00"]
    # the clock changed on 8 March 2026: 9:00 is 17:00 UTC before and 16:00 after
    times += ["2026-03-06T16:30:00", "2026-03-06T17:00:00", "2026-03-09T16:00:00", "2026-03-09T15:59:00"]
    e = spark.createDataFrame([(i, None if t is None else _t(t), "w") for i, t in enumerate(times)], "id int, ts timestamp, window string")
    w = spark.createDataFrame(WEEK, KIND)
    out = rooms.outside_schedule(e, w, "America/Los_Angeles")
    assert {r["id"] for r in out.collect()} == {1, 2, 3, 5, 6, 9} and out.columns == e.columns
    assert rooms.outside_schedule(e.limit(0), w, "America/Los_Angeles").collect() == []
    assert rooms.outside_schedule(e, w.limit(0), "America/Los_Angeles").count() == len(times)
    assert rooms.open_hours(spark.createDataFrame([*WEEK, (1, ["sun"], "12:00", "11:00"), (2, ["sat"], "9", "9:30")], KIND)).first()[0] == 40.5


def test_schedule_text():
    w = [dict(zip(("n", "days", "start", "end"), x, strict=True)) for x in WEEK]
    assert rooms.schedule_text(w) == "mon–fri 09:00–17:00"
    assert rooms.schedule_text([{"days": ["mon", "wed", "fri"], "start": "1:00", "end": "2:00"}]) == "mon, wed, fri 1:00–2:00"
    assert rooms.schedule_text([]) == "no windows"


def _village(folder, posts=()):
    put = lambda n, rows: (folder / n).write_text("\n".join(json.dumps(r) for r in rows))
    put("village.jsonl", [{"id": "v1", "name": "The place", "created_at": "2025-04-01T00:00:00Z", "updated_at": "2026-09-19T12:00:00Z", "is_chat_open": False, "active_agent_id": "7", "village_goal": " plant a tree ", "schedule": {"windows": [{"days": ["Monday", "Tue", "wed", "thu", "fri"], "start": "09:00", "end": "17:00"}]}}])
    put("agents.jsonl", [{"id": "7", "name": "Ada", "model_string": "claude-x", "created_at": "2025-04-02T00:00:00Z", "is_participating": True}, {"id": "8", "name": "Bo", "model_string": "models/gpt-4o", "created_at": "2025-05-02T00:00:00Z", "is_participating": False}])
    put("rooms.jsonl", [{"id": "g", "name": "general", "created_at": "2025-04-01T00:00:00Z", "deleted_at": None, "allow_list": None, "deny_list": None}, {"id": "s", "name": "side", "created_at": "2025-06-01T00:00:00Z", "deleted_at": "2025-06-01T04:00:00Z", "allow_list": '["Ada"]', "deny_list": None}])
    if posts:
        put("chat_messages.jsonl", [{"id": f"m{i}", "agent_id": "7", "speaker": "Ada", "room_id": "g", "channel": "general", "created_at": t, "content": x} for i, (t, x) in enumerate(posts)])


def test_the_place_in_a_report(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    _village(src)
    run = RunStore(spark, str(tmp_path / "run"))
    pipeline.ingest(spark, str(src), run)
    s = report.build(run)
    text = run.read_text("report.md")
    assert "mon–fri 09:00–17:00 (40 h/week)" in text and "timezone not stated" in text and "turn was held by Ada and chat was closed" in text and '"plant a tree"' in text
    rows = {r["channel"]: r for r in s["rooms"]}
    assert rows["side"]["lifetime_h"] == 4.0 and rows["general"]["lifetime_h"] > 12_000
    assert {v["vendor"]: (v["agents"], v["models"]) for v in s["vendors"]} == {"Anthropic": (1, "claude-x"), "other": (1, "gpt-4o")}
    assert s["joins_by_month"] == {"2025-04": 1, "2025-05": 1}


def test_posts_outside_the_schedule_are_counted(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    _village(src, [("2026-07-07T17:00:00Z", "R1 CONFIRMED: Utah arrived; answered 73.74"), ("2026-07-11T18:00:00Z", "weekend note")])
    run = RunStore(spark, str(tmp_path / "run"))
    assert sources.detect(spark, str(src)).name == "rooms"
    pipeline.ingest(spark, str(src), run, overrides={"schedule_tz": "America/Los_Angeles"})
    report.build(run)
    assert "read in America/Los_Angeles: 1 of 2 posts fall outside it" in run.read_text("report.md")
