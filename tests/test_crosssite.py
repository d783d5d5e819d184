import datetime
import json

from hearsay import cli
from hearsay.plans import pipeline
from hearsay.schema import RunStore, conform


def _corpus(folder):
    o = lambda site, lit: {"source_id": "s", "site": site, "title": "T", "url": "u", "source_date_literal": lit, "kind": "post"}
    records = [{"id": str(i), "text": f"note {i} -- Bob{i % 3}", "origins": [o("is.gd" if i % 2 else "mywiki.org", f"2026-06-{10 + i:02}T10:00:00Z")]} for i in range(12)]
    records += [{"id": "x", "text": "a copy", "origins": [o("dse", "2026-06-02T10:00:00Z"), o("is.gd", "current")]}]
    (folder / "records.jsonl").write_text("\n".join(map(json.dumps, records)))
    (folder / "site-coverage.csv").write_text("site,category\na,wikis\nb,wikis\n")
    (folder / "coverage-gaps.csv").write_text("site,category\nc,pastes\n")


def test_the_view_across_sites(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    _corpus(corpus)
    t = datetime.datetime(2026, 6, 1)
    rows = [(f"w{i}", t + datetime.timedelta(days=i % 3), "dse/P", "A" if i else "B", f"text {i}") for i in range(7)]
    wiki = RunStore(spark, str(tmp_path / "wiki"))
    wiki.write("events", conform(spark.createDataFrame(rows, "event_id string, ts timestamp, channel string, author_raw string, text string"), "events"))
    out = RunStore(spark, str(tmp_path / "out"))
    s = pipeline.crosssite(spark, wiki, str(corpus), out)
    # the corpus's copy of a dumped site goes; sites of the run come from its channels
    assert (s["n_wiki"], s["n_corpus"], s["n_duplicate_rows"], s["n_sites"]) == (7, 12, 1, 3)
    assert {r["surface"]: (r["posts"], r["days"]) for r in s["timeline"]} == {"main wiki (dse)": (7, 3), "shorteners": (6, 6), "other wikis": (6, 6)}
    text = out.read_text("report.md")
    assert "19 posts across 3 surfaces" in text and "1 corpus rows dropped" in text and "13 timed origins out of 14" in text
    assert "| category |" in text and "## Activity timeline" in text and out.read("timeline").count() == 15
    assert json.loads(out.read_text("summary.json"))["coverage"]["wikis"] == {"sites": 2, "gaps": 0}


def test_the_command_line(spark, tmp_path):
    src = tmp_path / "chat.jsonl"
    posts = [{"id": str(i), "timestamp": f"2026-06-01T1{i}:00:00Z", "room": "general", "sender": "June1-runner", "message": f"R{i + 1} CONFIRMED: Poland arrived 10:00:0{i}; answered 16.{i}0% instantly"} for i in range(3)]
    src.write_text("\n".join(map(json.dumps, posts)))
    cli.main(["run", str(src), "-o", str(tmp_path / "run")], spark)
    run = RunStore(spark, str(tmp_path / "run"))
    assert run.read("events").count() == 3 and run.read_text("report.md").startswith("# Provenance report")
