import gzip
import json
import os
import zipfile

import pytest
from hearsay import sources
from hearsay.plans import pipeline, report
from hearsay.sources import files
from hearsay.synth import CONFIG, frames


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


MSG = [{"timestamp": "2026-06-01T10:00:00Z", "sender": {"name": "A"}, "message": "R1 Poland answered 5.5 instantly", "room": "r", "id": "1"}, {"timestamp": 1780000000000, "sender": {"name": "B"}, "message": " ", "room": "r", "id": "2"}]


@pytest.mark.parametrize("shape", ["lines", "array", "wrapped", "rooms", "gz"])
def test_chat_shapes(spark, tmp_path, shape):
    rows = [m | {"timestamp": str(m["timestamp"])} for m in MSG]
    p = tmp_path / ("c.jsonl.gz" if shape == "gz" else "c.jsonl" if shape == "lines" else "c.json")
    if shape == "gz":
        with gzip.open(p, "wt") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))
    elif shape == "lines":
        lines(p, rows)
    else:
        p.write_text(json.dumps({"array": rows, "wrapped": {"messages": rows}, "rooms": {"r1": rows}}[shape], indent=1))
    a = sources.detect(spark, str(p))
    got = a.load(spark, str(p)).events.collect()
    assert a.name == "chat" and [(r["event_id"], r["author_raw"], r["channel"]) for r in got] == [("1", "A", "r")]
    assert str(got[0]["ts"]) == "2026-06-01 10:00:00"


def wiki_rows():
    rev = lambda i, t, body, **k: {"rev_id": f"r{i}", "page_id": "dse/P", "wiki": "dse", "label": "Agent", "ip16": "10.1", "time": t, "time_grade": "a", "body": body, "relation_type": None, "related_event_id": None, "round_id": None} | k
    revs = [rev(1, "2026-06-01T10:00:00Z", "one"), rev(2, "2026-06-01T10:05:00Z", "one\n\ntwo"), rev(3, "2026-06-01T11:00:00Z", "one", relation_type="first_recreation_of", related_event_id=["d1"], round_id=["k1"])]
    events = [
        {"event_id": "d1", "event_type": "delete", "wiki": "dse", "page": "P", "time": "2026-06-01T10:30:00Z", "request_time": "2026-06-01T10:29:58Z", "actor_label": "Admin", "page_held": True, "round_id": "k1", "related_event_id": None, "ip16": None},
        {"event_id": "attacklog_raw_dse_1", "event_type": "probe", "wiki": "dse", "page": "P", "time": "2026-06-01T10:05:01Z", "request_time": None, "actor_label": None, "page_held": None, "round_id": None, "related_event_id": None, "ip16": "10.1"},
    ]
    return revs, events


@pytest.mark.parametrize("zipped", [False, True])
def test_wiki(spark, tmp_path, zipped):
    revs, events = wiki_rows()
    lines(tmp_path / "revisions.jsonl", revs)
    lines(tmp_path / "events.jsonl", events)
    lines(tmp_path / "pages.jsonl", [{"page_id": "dse/P", "page_family": "oecd-equity"}])
    lines(tmp_path / "labels.jsonl", [{"label": "Admin", "is_human_handle": True}])
    where = str(tmp_path)
    if zipped:
        where = str(tmp_path / "dump.zip")
        with zipfile.ZipFile(where, "w") as z:
            for n in ("revisions", "events", "pages", "labels"):
                z.write(tmp_path / f"{n}.jsonl", f"x/{n}.jsonl")
    b = sources.get("wiki").load(spark, where)
    assert sources.get("wiki").sniff(spark, where)
    got = sorted((r["text"], str(r["ts"])[11:16], r["channel_family"]) for r in b.events.collect())
    assert got == [("one", "10:00", "oecd-equity"), ("one", "11:00", "oecd-equity"), ("two", "10:05", "oecd-equity")]
    acts = {r["action"]: r for r in b.lifecycle.collect()}
    assert acts["recreate"]["related_event_id"] == "d1" and acts["recreate"]["page_held"] is True
    p = b.probes.first()
    assert (p["nearest_save_label"], p["nearest_save_dt_s"], p["cotimed_label"], p["site"]) == ("Agent", 1.0, "Agent", "dse")
    assert b.notes["delete_request_lag_s"] == {2: 1} and b.notes["human_handles"] == ["Admin"]


def test_zipped_like_unpacked(spark, tmp_path):
    revs, events = wiki_rows()
    first = {k: v for k, v in revs[0].items() if k not in ("relation_type", "related_event_id", "round_id")}
    many = [first | {"rev_id": f"a{i:03}", "page_id": "dse/Q", "time": "2026-05-01T10:00:00Z"} for i in range(250)] + revs
    mixed = [{"n": i} for i in range(250)] + [{"n": "x", "late": {"deep": 1}}]
    lines(tmp_path / "revisions.jsonl", many)
    lines(tmp_path / "events.jsonl", events)
    lines(tmp_path / "mixed.jsonl", mixed)
    where = str(tmp_path / "dump.zip")
    with zipfile.ZipFile(where, "w") as z:
        for n in ("revisions", "events", "mixed"):
            z.write(tmp_path / f"{n}.jsonl", f"x/{n}.jsonl")
    got, want = (files.read_json(spark, files.find(spark, w, "mixed.jsonl")) for w in (where, str(tmp_path)))
    assert got.schema == want.schema and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.where("late.deep = 1 and n = 'x'").count() == 1
    acts = {r["action"]: r for r in sources.get("wiki").load(spark, where).lifecycle.collect()}
    assert acts["recreate"]["related_event_id"] == "d1"


def test_corpus(spark, tmp_path):
    o = lambda site, lit, k="post": {"source_id": "s", "site": site, "title": "T", "url": "u", "source_date_literal": lit, "kind": k}
    lines(tmp_path / "records.jsonl", [{"id": "1", "text": "hello -- Bob", "origins": [o("a.com", "2026-06-01T10:00:00Z"), o("a.com", "2026-06-01T10:00:00Z"), o("a.com", "current"), o("a.com", "2026-09-01"), o("prowiki.org/dse", "2026-06-01")]}, {"id": "2", "text": "see [operational URL omitted; host=x.org; n=1]", "origins": [o("b.com", "1780000000")]}])
    (tmp_path / "shortener-logs.json").write_text(json.dumps({"sites": [{"site": "is.gd", "links": [{"keyword": "k", "title": "t", "url": "http://u", "time": "2026-06-01 10:00:00", "ip16": "1.2", "clicks": 3}]}]}))
    (tmp_path / "other-wikis.json").write_text(json.dumps({"pages": [{"wiki": "w", "page_id": "w/p", "revisions": [{"seq": 1, "time": "2026-06-01T10:00:00Z", "ip16": "1.2", "added": ["x", "[content not recovered: 3]"]}, {"seq": 2, "time": "2026-06-01T10:00:00Z", "ip16": "1.2", "added": []}]}]}))
    lines(tmp_path / "links.jsonl", [{"host": "h"}, {"host": "h"}])
    (tmp_path / "site-coverage.csv").write_text("site,category\na,wiki\n")
    (tmp_path / "coverage-gaps.csv").write_text("site,category\nb,paste\n")
    b = sources.detect(spark, str(tmp_path)).load(spark, str(tmp_path))
    n = b.notes
    assert (n["n_kept"], n["n_duplicate"], n["n_no_time"], n["n_late"], n["n_excluded"]) == (2, 1, 1, 1, 1)
    assert {r["author_raw"] for r in b.events.collect()} == {"Bob", "anon@b.com", "ip16:1.2"}
    assert {r["text"] for r in b.events.where("site = 'b.com'").collect()} == {"see https://x.org/[omitted]"}
    assert n["coverage"] == {"wiki": {"sites": 1, "gaps": 0}, "paste": {"sites": 0, "gaps": 1}} and n["top_link_hosts"] == {"h": 2}


def test_roster_file(spark, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text("id\tagent_id\tshort_name\tname\tstart_time\tend_time\tcreated_at\n1\ta\tTop Role\tDo x\t2026-07-06 09:00\t\t2026-07-06 08:00\n2\tb\tOther\tDo y\t37:49.4\t\t2026-07-06 08:05\n3\ta\tTop Role\tDo z\t2026-07-06 12:00\t\t2026-07-06 11:00\n")
    b = sources.detect(spark, str(p)).load(spark, str(p))
    assert b.notes["goals"] == 3 and b.notes["timestamp_issues"] == {"start": {"n": 1, "examples": ["37:49.4"]}}
    assert {r["goal_id"]: (r["role"], r["batch"]) for r in b.roster.collect()} == {"1": ("top-role", "Jul06"), "2": ("other", "Jul06"), "3": ("top-role", "Jul06b")}


def test_rooms_folder(spark, tmp_path):
    lines(tmp_path / "agents.jsonl", [{"id": "a1", "name": "Ann", "model_string": "claude-x", "created_at": "2026-01-01"}])
    lines(tmp_path / "rooms.jsonl", [{"id": "r1", "name": "best", "created_at": "2026-01-01", "deleted_at": "2026-02-01", "whitelisted_agent_names": ["Ann"], "blacklisted_agent_names": []}])
    lines(tmp_path / "chat_messages.jsonl", [{"id": "m1", "agent_id": "a1", "chat_room_id": "r1", "created_at": "2026-01-05T00:00:00Z", "content": "hi"}])
    b = sources.detect(spark, str(tmp_path)).load(spark, str(tmp_path))
    e = b.events.first()
    assert (e["author_raw"], e["channel"], str(e["visible_until"])[:10]) == ("Ann", "best", "2026-02-01")
    assert b.directory.first()["vendor"] == "Anthropic" and b.channels.first()["allow"] == ["Ann"]


def test_rooms_report(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines(src / "agents.jsonl", [{"id": "a1", "name": "Ann", "model_string": "claude-x", "created_at": "2026-01-01"}])
    lines(src / "goals.jsonl", [{"id": "g1", "agent_id": "a1", "short_name": "r", "name": "n", "start_time": "2026-01-05T00:30:00Z", "end_time": None}])
    lines(src / "eras.jsonl", [{"id": "e1", "goal": "one", "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-04T00:00:00Z"}, {"id": "e2", "goal": "two", "start_time": "2026-01-05T00:00:00Z", "end_time": None}])
    lines(src / "sessions.jsonl", [{"id": str(i), "agent_id": "a1", "created_at": f"2026-01-{d:02}T{h:02}:00:00Z"} for i, (d, h) in enumerate([(4, 9), (6, 9), (7, 9), (8, 9), (9, 9), (9, 20)])])
    lines(src / "summaries.jsonl", [{"id": "s1", "type": "daily", "summary_target": "3", "summary_date": "2026-01-06", "generated_by": "m", "created_at": "2026-01-07T00:00:00Z", "content": "1. [2026-01-06 10:00 UTC] Ann did it"}])
    lines(src / "chat_messages.jsonl", [{"id": f"m{i}", "agent_id": "a1", "chat_room_id": "r1", "created_at": t, "content": "hi"} for i, t in enumerate(["2026-01-06T00:00:00Z", "2026-01-04T12:00:00Z"])])
    run = pipeline.RunStore(spark, str(tmp_path / "run"))
    pipeline.ingest(spark, str(src), run, "rooms")
    pipeline.extract(run)
    s = report.build(run)
    assert [r["offset_s"] for r in s["eras_handover"]] == [1800.0]
    assert sorted(r["posts"] for r in s["eras_posts"]) == [0, 1, 1]
    assert s["busy_hours_utc"] == [9]
    assert s["activity_in_goals"] == [{"agents_in_roster": 1, "rows_in_goal_window": 5}] and s["activity_in_transcript"] == [{"agents_in_transcript": 1}]
    by = s["summaries_by"]
    assert by["by_type"] == [{"type": "daily", "n": 1}] and by["generators"] == [{"generated_by": "m", "n": 1}] and by["by_kind"] == [{"kind": "event", "n": 1}]
    assert by["daily"][0]["n"] == 1 and by["daily"][0]["day_first"] == 3 and by["top_actors"] == [{"actor": "Ann", "n": 1}]


def test_release(spark, tmp_path):
    r = lambda i, p, t: {"id": i, "cite": i, "kind": "k", "parent_id": p, "time_utc": None, "tags": "x; y", "text": t}
    lines(tmp_path / "redacted.jsonl", [r("1", None, "[CREDENTIAL 1] [CREDENTIAL 2]"), r("2", "1", "b"), r("3", "9", "b")])
    b = sources.detect(spark, str(tmp_path)).load(spark, str(tmp_path))
    assert (b.notes["roots"], b.notes["children"], b.notes["orphans"], b.notes["repeated_texts"]) == (1, 1, 1, 1)
    assert b.notes["placeholders"] == {"CREDENTIAL": {"occurrences": 2, "records": 1}} and b.notes["tag_families"] == {"x": 3}


def test_hub():
    p = sources.parse_hub("hf://datasets/own/name@v1/data/x.jsonl")
    assert (p.repo, p.revision, p.file) == ("own/name", "v1", "data/x.jsonl")
    assert sources.resolve("/x") == "/x" and sources.resolve("hf://own/name", lambda h: h.repo) == "own/name"
    with pytest.raises(ValueError):
        sources.resolve("hf://bad")


def test_unknown(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps([{"zzz": 1}]))
    with pytest.raises(ValueError):
        sources.detect(spark, str(p))


def test_synthetic_recovery(spark, tmp_path):
    posts, truth = frames(spark, seed=2)
    src = lines(tmp_path / "transcript.jsonl", [r.asDict() for r in posts.collect()])
    truth = truth.collect()
    run = pipeline.run_all(spark, src, str(tmp_path / "run"), overrides=CONFIG)
    s = json.loads(run.read_text("summary.json"))
    t = s["A1"]["totals"][0]
    assert t["n_answers"] == len(truth) == 300
    public = sum(x.public_at_arrival for x in truth) / len(truth)
    assert public - 0.12 <= t["share_exposed"] <= public + 0.12
    effect = next(r for r in s["A2"] if r["outcome"] == "y_instant" and r["treatment"] == "D_cons")
    assert abs(effect["beta"] - 0.7) < 0.25 and effect["p"] < 0.05
    null = next(r for r in s["A2"] if r["outcome"] == "y_consensus" and r["treatment"] == "D_cons")
    assert abs(null["beta"]) < 0.2
    chains = run.read("chains_merged").where("family <> 'url'")
    edges = run.read("edges_merged").where("kind in ('relay', 'relay_xchannel')").count()
    assert edges == sum(r["n_agents"] - 1 for r in chains.collect())
    assert os.path.exists(tmp_path / "run" / "report.md") and "<graphml" in run.read_text("provenance_merged.graphml")


def test_a_blank_save_hides_no_labelled_one(spark):
    from hearsay.operators.lifecycle import probe_links

    probes = spark.sql("select * from values ('p1', timestamp'2026-06-01 12:00:00', '2.2'), ('p2', timestamp'2026-06-01 12:00:00', '3.3'), ('p3', timestamp'2026-06-01 12:00:00', '4.4'), ('p4', timestamp'2026-06-01 12:00:00', '5.5') as t(probe_id, ts, ip16)")
    saves = spark.sql("""select * from values
      (timestamp'2026-06-01 12:00:00', '', '2.2'), (timestamp'2026-06-01 12:00:01', 'B', '2.2'),
      (timestamp'2026-06-01 12:00:00', '', '3.3'), (timestamp'2026-06-01 13:00:00', 'C', '3.3'),
      (timestamp'2026-06-01 12:00:00', 'D', '4.4'), (timestamp'2026-06-01 11:00:00', 'E', '4.4') as t(ts, label, ip16)""")
    got = {r["probe_id"]: (r["cotimed_label"], r["n_labels_on_prefix"]) for r in probe_links(probes, saves).collect()}
    assert got == {"p1": ("B", 1), "p2": (None, 1), "p3": (None, 2), "p4": (None, 0)}
