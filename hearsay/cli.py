"""python -m hearsay.cli run|ingest|extract|expose|graph|report|sample-gold|validate|crosssite|synth"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import synth
from .plans import pipeline, report, validation
from .schema import RunStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hearsay", description=__doc__)
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run", "ingest"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("-o", "--out", default="runs/latest")
        s.add_argument("--adapter", default="auto")
        s.add_argument("--config", help="JSON file with settings over the adapter's")
        s.add_argument("--roster")
    for name in ("extract", "expose", "graph"):
        sub.add_parser(name).add_argument("run")
    s = sub.add_parser("report")
    s.add_argument("run")
    s.add_argument("--mapping", choices=sorted(pipeline.MAPPINGS), default="merged")
    s = sub.add_parser("sample-gold")
    s.add_argument("run")
    s.add_argument("-n", type=int, default=120)
    s.add_argument("--seed", type=int, default=0)
    s = sub.add_parser("validate")
    s.add_argument("run")
    s.add_argument("gold", help="JSON lines with event_id and is_answer")
    s = sub.add_parser("crosssite")
    s.add_argument("wiki_run")
    s.add_argument("corpus")
    s.add_argument("-o", "--out", default="runs/crosssite")
    s = sub.add_parser("synth")
    s.add_argument("-o", "--out", default="data/synth")
    s.add_argument("--agents", type=int, default=60)
    s.add_argument("--copy-rate", type=float, default=0.7)
    s.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("hearsay").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = lambda path: RunStore(spark, path)
    if a.cmd in ("run", "ingest"):
        over = json.loads("\n".join(r[0] for r in spark.read.text(a.config).collect())) if a.config else None
        if a.cmd == "run":
            pipeline.run_all(spark, a.input, a.out, a.adapter, over, a.roster)
        else:
            pipeline.ingest(spark, a.input, store(a.out), a.adapter, over, a.roster)
    elif a.cmd in ("extract", "expose", "graph"):
        getattr(pipeline, a.cmd)(store(a.run))
    elif a.cmd == "report":
        report.build(store(a.run), a.mapping)
    elif a.cmd == "sample-gold":
        run = store(a.run)
        picked = validation.stratified(run.read("tags"), a.n, a.seed)
        picked.join(run.read("events").select("event_id", "family", "text"), "event_id").coalesce(1).write.mode("overwrite").json(f"{a.run}/gold_template.jsonl")
    elif a.cmd == "validate":
        run = store(a.run)
        gold = spark.read.json(a.gold)
        counts = validation.presence(gold, gold.where("is_answer"), run.read("claims").where("event_type = 'answer'"))
        run.write_text("validation.json", json.dumps(report.plain(validation.precision_recall(counts).first().asDict())))
    elif a.cmd == "crosssite":
        pipeline.crosssite(spark, store(a.wiki_run), a.corpus, store(a.out))
    elif a.cmd == "synth":
        synth.write(spark, a.out, n_agents=a.agents, copy_rate=a.copy_rate, seed=a.seed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
