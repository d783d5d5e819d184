"""Rosters, side tables around a transcript, and reconstruction releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators import rooms as places
from ..operators import roster, trees
from ..schema import conform, empty
from . import chat, files
from .base import AdapterConfig, Bundle, Capabilities

# Columns that tell what a table is, checked in this order.
SIGNATURES = (
    ("goals", {"agent_id", "start_time"}), ("agents", {"id", "name", "model_string"}), ("rooms", {"id", "name", "deleted_at"}),
    ("sessions", {"agent_id", "created_at"}), ("eras", {"goal", "start_time"}),
)
TEXT_KEYS = {"content", "text", "message", "body", "msg"}
META_KEYS = {"schedule", "village_goal", "is_chat_open"}
RELEASE_KEYS = {"id", "cite", "kind", "parent_id", "time_utc", "tags", "text"}


def classify(columns: set[str]) -> str | None:
    if {"type", "summary_target", "content"} <= columns:
        return "summaries"
    if columns & TEXT_KEYS:
        return "messages"
    if {"id", "name"} <= columns and columns & META_KEYS:
        return "meta"
    for kind, need in SIGNATURES:
        if need <= columns and (kind != "goals" or columns & {"short_name", "name"}):
            return kind
    return None


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV or text with a header, all columns as text; or JSON."""
    if path.endswith((".csv", ".tsv", ".txt")):
        head = spark.read.text(path).first()[0]
        return files.read_csv(spark, path, max((",", "\t", ";", "|"), key=head.count))
    return chat.read(spark, path)


class RosterAdapter:
    name = "roster"

    def sniff(self, spark: SparkSession, path: str) -> bool:
        c = set(read_rows(spark, path).columns)
        return "agent_id" in c and bool(c & {"role", "short_name", "goal", "name"}) and bool(c & {"start", "start_time"}) and not c & TEXT_KEYS

    def config(self) -> AdapterConfig:
        return AdapterConfig(name=self.name)

    def load(self, spark: SparkSession, path: str) -> Bundle:
        rows = read_rows(spark, path)
        goals = roster.normalize(rows)
        n = goals.agg(F.count(F.lit(1)), F.countDistinct("agent_id"), F.countDistinct("role")).first()
        issues = {r["field"]: {"n": r["n"], "examples": r["examples"]} for r in roster.timestamp_issues(rows).collect() if r["n"]}
        return Bundle(events=empty(spark, "events"), roster=conform(goals, "roster"), capabilities=Capabilities(has_roster=True), notes={"goals": n[0], "agents": n[1], "roles": n[2], "timestamp_issues": issues})


class RoomsAdapter:
    """A folder of tables, recognised by their columns."""

    name = "rooms"

    def discover(self, spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], list[str]]:
        found, odd = {}, []
        for n in files.names(spark, path):
            if not n.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz", ".csv", ".tsv")):
                continue
            try:
                rows = read_rows(spark, f"{path}/{n}")
            except ValueError:
                odd.append(n)
                continue
            kind = classify(set(rows.columns))
            if kind and kind not in found:
                found[kind] = rows
            else:
                odd.append(n)
        return found, odd

    def sniff(self, spark: SparkSession, path: str) -> bool:
        return files.is_folder(spark, path) and bool({"goals", "agents", "rooms", "eras", "summaries"} & set(self.discover(spark, path)[0]))

    def config(self) -> AdapterConfig:
        return AdapterConfig(name=self.name)

    def load(self, spark: SparkSession, path: str) -> Bundle:
        t, odd = self.discover(spark, path)
        out = Bundle(events=empty(spark, "events"), notes={"tables": sorted(t), "unrecognised": odd})
        if "agents" in t:
            out.directory = conform(roster.directory(t["agents"]), "directory")
        if "goals" in t:
            out.roster = conform(roster.normalize(t["goals"]), "roster")
        if "eras" in t:
            out.eras = conform(roster.eras(t["eras"]), "eras")
        if "rooms" in t:
            out.channels = conform(rooms(t["rooms"]), "channels")
            out.lifecycle = conform(lc.lifecycle_from_channels(out.channels), "lifecycle")
        if "sessions" in t:
            s = t["sessions"]
            act = s.select(F.col("agent_id").cast("string").alias("agent_id"), roster.roster_timestamp(F.col("created_at")).alias("ts"), F.lit("session").alias("kind"), roster.pick(s, ("sdk_session_id", "session_id", "id")).alias("ref"))
            if out.directory is not None:
                act = act.join(out.directory.select("agent_id", F.col("name").alias("agent_name")), "agent_id", "left")
            out.activity = conform(act, "activity")
        if "summaries" in t:
            out.summaries = conform(roster.summaries(t["summaries"]), "summaries")
            out.digest = conform(roster.parse_digest(out.summaries, out.directory), "digest")
        if "messages" in t:
            out.events = self._events(t["messages"], out)
        if "meta" in t:
            out.notes["meta"] = [r.asDict(recursive=True) for r in t["meta"].limit(1).collect()]
            one = places.place(t["meta"], out.directory).first()
            windows = places.schedule(t["meta"]) if "schedule" in t["meta"].columns else None
            out.notes["place"] = one.asDict() if one else None
            out.notes["schedule"] = [] if windows is None else [r.asDict() for r in windows.orderBy("n").collect()]  # one row a weekly window
            out.notes["open_hours_per_week"] = 0.0 if windows is None else windows.transform(places.open_hours).first()[0]
        out.capabilities = Capabilities(has_wall_clock=True, has_roster=out.roster is not None, has_audience=out.channels is not None, has_deletions=out.lifecycle is not None)
        return out

    @staticmethod
    def _events(rows: DataFrame, b: Bundle) -> DataFrame:
        e = chat.normalize(rows)
        if b.directory is not None:
            e = e.join(b.directory.select(F.col("agent_id").alias("author_raw"), "name"), "author_raw", "left").withColumn("author_alt", F.when(F.col("name").isNotNull(), F.col("author_raw")).otherwise(F.col("author_alt"))).withColumn("author_raw", F.coalesce("name", "author_raw")).drop("name")
        if b.channels is not None:
            room = b.channels.select(F.col("channel_id").alias("channel"), F.col("channel").alias("room"), "deleted")
            e = e.join(room, "channel", "left").withColumn("channel", F.coalesce("room", "channel")).withColumn("visible_until", F.col("deleted")).drop("room", "deleted")
        return conform(e, "events")


def rooms(rows: DataFrame) -> DataFrame:
    from ..functions.text import names_list

    def listed(name: str):
        if name not in rows.columns:
            return F.array().cast("array<string>")
        is_list = rows.schema[name].dataType.typeName() == "array"
        return F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>")) if is_list else names_list(F.col(name).cast("string"))

    stamp = lambda *n: roster.roster_timestamp(roster.pick(rows, n))
    return rows.select(F.col("name").alias("channel"), F.col("id").cast("string").alias("channel_id"), stamp("created_at").alias("created"), stamp("deleted_at").alias("deleted"), listed("whitelisted_agent_names").alias("allow"), listed("blacklisted_agent_names").alias("deny"))


class ReleaseAdapter:
    """Reconstruction releases: redacted records that form trees."""

    name = "release"

    def _where(self, spark: SparkSession, path: str) -> str | None:
        if path.endswith(("redacted.jsonl", "redacted.jsonl.gz")):
            return path
        return files.find(spark, path, "redacted.jsonl") or files.find(spark, path, "redacted.jsonl.gz")

    def sniff(self, spark: SparkSession, path: str) -> bool:
        rows = files.read_json(spark, self._where(spark, path))
        return rows is not None and RELEASE_KEYS - {"parent_id", "time_utc"} <= set(rows.columns)

    def config(self) -> AdapterConfig:
        return AdapterConfig(name=self.name)

    def load(self, spark: SparkSession, path: str) -> Bundle:
        r = files.with_columns(files.read_json(spark, self._where(spark, path)), "parent_id", "time_utc")
        notes = trees.tree_summary(r).first().asDict() | trees.text_repeats(r).first().asDict() | trees.integrity(r).first().asDict()
        notes["kinds"] = {x["kind"]: x["n"] for x in trees.kinds(r).collect()}
        notes["placeholders"] = {x["category"]: {"occurrences": x["occurrences"], "records": x["records"]} for x in trees.placeholders(r).orderBy(F.desc("occurrences"), "category").limit(15).collect()}
        notes["tag_families"] = {x["family"]: x["n"] for x in trees.tag_families(r.withColumn("tags", F.col("tags").cast("string"))).collect()}
        return Bundle(events=empty(spark, "events"), records=r, capabilities=Capabilities(has_threading=True), notes=notes)
