"""Wiki dumps: revisions, events, pages, labels and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_timestamp
from ..operators import lifecycle as lc
from ..schema import conform, empty
from . import files
from .base import AdapterConfig, Bundle, Capabilities, Technique

# Page families that name infrastructure, not a task.
INFRA_FAMILIES = (
    "source-cache-url-list", "relay-coordination", "source-or-unclassified", "off_store_unclassified",
    "loop-chain-infrastructure", "probe-test", "unknown", "mixed-task",
)

# Task families, more specific first.
FAMILIES = {
    "oecd-equity": r"OECD\s*(?:Education\s*)?Equity|Education\s*Equity|pre-?primary",
    "oecd-regional-co2": r"Regional\s*Recovery|\bRRP|CO2",
    "oecd-household-income": r"Household\s*Disposable\s*Income",
    "datausa-clothing-workforce": r"Clothing",
    "datausa-grocery-workforce": r"Grocery",
    "datausa-cashiers-bachelors": r"Cashier\w*\s*Bachelor",
    "datausa-cashier-skills": r"Cashier\s*Skills",
    "datausa-cashiers-masters": r"Cashier",
    "datausa-construction-wage": r"Construction\s*Wage",
    "datausa-construction-workforce": r"Construction",
    "datausa-sector61-state": r"Sector\s*61|S61x62|61-62",
    "datausa-occupation-salary-61-62": r"Occupation\s*Salary|School\s*Psych",
    "ihme-cvd-deaths": r"\bCVD\b|Healthdata\s*CVD",
    "ihme-family-planning": r"Family\s*Planning",
    "ihme-mcv2": r"MCV2",
    "ihme-smoking": r"Healthdata\s*Smoking",
    "ihme-lymphatic-filariasis": r"Lymphatic|LFSequence",
    "datausa-language-french": r"French|DataUSALang",
    "fuel-poverty-ni": r"Fuel\s*Poverty",
    "world-poverty-clock": r"World\s*Poverty\s*Clock",
    "datausa-poverty-state": r"Poverty\s*State",
    "datausa-poverty-county": r"Poverty",
    "datausa-maids-wage": r"\bMaids?\b",
    "datausa-police-wage-age": r"Police",
    "datausa-finance-gender-gap": r"Finance|financial\s*managers",
    "aihw-pbs": r"\bPBS\b|AIHW",
    "datausa-transport-production": r"Transport",
    "datausa-production-share": r"Production\s*Occupation|DataUSAProd",
    "datausa-slp-ethnicity": r"\bSLP\b|Speech\s*Path",
    "datausa-ivy-tuition": r"\bIvy\b",
    "uefa-pass-accuracy": r"UEFA",
    "vermont-rent": r"Vermont|Lamoille",
    "nyc-veterans": r"NYC\s*Veterans",
    "datausa-elpaso-foreign-born": r"El\s*Paso",
    "datausa-enrollment-asian": r"Enrollment\s*Asian",
    "unaids-bosnia-hiv": r"UNAIDS",
    "sdg-index-score": r"SDG\s*Index",
    "gapminder-age80": r"Gapminder",
}

# Techniques and what shows them.
TECHNIQUES = (
    Technique("blob-hostname-bypass", r"blob\s*host(?:name)?|blob\.core\.windows|allowed\s+blob|blob-host", ("oecd-equity",), "embed calls through an allowed blob host"),
    Technique("live-tooltip-value", r"(?:real|live|actual)[-\s]?(?:dashboard[-/\s]?)?tooltip|tooltip\s+(?:says|shows|value)", ("oecd-equity",), "the rendered tooltip instead of the rounded table"),
    Technique("heartbeat-beacon", r"heart\s?beat|beacon", (), "background writes that test whether the container lives on"),
    Technique("zzz-backup-pages", r"ZZZ", (), "backup and link list pages"),
    Technique("rng-seed-crack", r"random\.shuffle|\bseed\s*\d{4,}|\bRNG\b", (), "question order from a guessed shuffle seed"),
    Technique("clock-wait-fastforward", r"clock\.wait", (), "advancing the task clock"),
)
BOILERPLATE = ["Beschreibe hier die neue Seite.", "Describe the new page here."]


def _list(df: DataFrame, name: str):
    """A field that is a value or a list of values, as a list of text."""
    if name not in df.columns:
        return F.array(F.lit(None).cast("string"))
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(c.cast("array<string>"), F.array(F.lit(None).cast("string")))
    return F.when(F.startswith(c.cast("string"), F.lit("[")), F.from_json(c.cast("string"), "array<string>")).otherwise(F.array(c.cast("string")))


def _cutoff(spark: SparkSession, path: str):
    """The time up to which the dump looked for recreations, from its manifest; a missing or
    broken one is none."""
    where = files.find(spark, path, "manifest.json")
    rows = files.read_json(spark, where) if where else None
    if rows is None or "recreation_source" not in rows.columns:
        return None
    text = F.get_json_object(F.to_json("recreation_source") if dict(rows.dtypes)["recreation_source"].startswith("struct") else F.col("recreation_source").cast("string"), "$.cutoff_unix_ts")
    found = rows.select(F.timestamp_seconds(text.try_cast("bigint")).alias("t")).where("t is not null").first()
    return found[0] if found else None


class WikiAdapter:
    name = "wiki"

    def sniff(self, spark: SparkSession, path: str) -> bool:
        where = files.find(spark, path, "revisions.jsonl")
        rows = files.read_json(spark, where)
        return rows is not None and {"rev_id", "page_id", "body", "label", "time"} <= set(rows.columns)

    def config(self) -> AdapterConfig:
        return AdapterConfig(
            name="wiki", families=FAMILIES, techniques=TECHNIQUES, featured_disputes=(("oecd-equity", "Poland"), ("oecd-equity", "Hungary"), ("oecd-equity", "Slovak Republic")),
            disputes=({"family": "datausa-grocery-workforce", "slot": "G5 (cracked-seed forecast vs observed)", "context": r"\bG5\b", "variants": {"Maryland (RNG forecast)": r"Maryland|\bMD\b", "Montana (observed)": r"Montana|\bMT\b"}},),
            ignore_authors=("[Admin1]", "[Admin2]", "[Person22]"),
        )

    def load(self, spark: SparkSession, path: str) -> Bundle:
        get = lambda n: files.read_json(spark, files.find(spark, path, n))
        revs, events, pages, labels = get("revisions.jsonl"), get("events.jsonl"), get("pages.jsonl"), get("labels.jsonl")
        revs = files.with_columns(revs, "ip16", "label", "relation_type", "time_grade", "wiki")
        revs = revs.withColumn("ts", iso_timestamp(F.col("time"))).withColumn("label", F.nullif(F.col("label"), F.lit(""))).withColumn("author_alt", F.coalesce("label", F.concat(F.lit("ip16:"), F.coalesce(F.col("ip16").cast("string"), F.lit("None"))))).withColumn("channel", F.col("page_id"))
        cycle, probes, notes = empty(spark, "lifecycle"), empty(spark, "probes"), {}
        if events is not None:
            events = files.with_columns(events, "actor_label", "page_held", "ip16", "request_action", "param_family", "success_observed", "time_grade", "wiki", "page")
            events = events.withColumn("ts", iso_timestamp(F.col("time"))).withColumn("channel", F.concat_ws("/", "wiki", "page"))
            cycle, probes = self._lifecycle(revs, events), self._probes(events, revs)
            if "request_time" in events.columns:
                lag = lc.delete_lag(events.where("event_type = 'delete'").withColumn("request_ts", iso_timestamp(F.col("request_time"))))
                notes["delete_request_lag_s"] = {int(r["lag_s"]): r["n"] for r in lag.collect() if r["lag_s"] is not None}
        dels = cycle.where("action = 'delete'").select("channel", "ts")
        posts = lc.snapshots_to_posts(revs.select("channel", "ts", F.col("rev_id").cast("string").alias("rev_id"), "author_alt", "body"), dels, BOILERPLATE)
        if pages is not None and "page_family" in pages.columns:
            fam = pages.select(F.col("page_id").alias("channel"), F.when(~F.col("page_family").isin(*INFRA_FAMILIES), F.col("page_family")).alias("channel_family"))
            posts = posts.join(fam, "channel", "left")
        else:
            posts = posts.withColumn("channel_family", F.lit(None).cast("string"))
        grade = revs.select(F.col("rev_id").cast("string").alias("parent_id"), F.col("time_grade").alias("ts_grade"))
        posts = posts.join(grade, "parent_id", "left").withColumn("channel_family", F.coalesce("channel_family", F.lit(""))).withColumn("source_ref", F.col("parent_id")).withColumn("site", F.split_part("channel", F.lit("/"), F.lit(1))).withColumn("source_kind", F.lit("revision"))
        n = cycle.agg(F.count_if(F.col("action") == "delete").alias("d"), F.count_if(F.col("action") == "recreate").alias("r")).first()
        notes |= {"n_revisions": revs.count(), "n_pages": pages.count() if pages is not None else 0, "n_deletions": n["d"], "n_recreations": n["r"], "n_probes": probes.count()}
        if n["r"]:
            saved = revs.select("channel", "ts", F.col("rev_id").cast("string").alias("rev_id"), F.monotonically_increasing_id().alias("row"), "body")
            notes["recreation_check"] = lc.recreation_check(saved, cycle, posts, _cutoff(spark, path), "row").first().asDict()
        if labels is not None and "is_human_handle" in labels.columns:
            notes["human_handles"] = sorted(r[0] for r in labels.where("is_human_handle").select("label").collect())
        caps = Capabilities(has_wall_clock=True, has_deletions=n["d"] > 0, has_probes=notes["n_probes"] > 0)
        return Bundle(events=conform(posts, "events"), lifecycle=cycle, probes=probes, capabilities=caps, notes=notes)

    @staticmethod
    def _lifecycle(revs: DataFrame, events: DataFrame) -> DataFrame:
        events = events.withColumn("rel", _list(events, "related_event_id")).withColumn("rounds", _list(events, "round_id"))
        dels = events.where("event_type = 'delete'").select("channel", "ts", F.lit("delete").alias("action"), F.col("actor_label").alias("actor"), "event_id", F.lit(None).cast("string").alias("related_event_id"), F.lit(None).cast("string").alias("revision_ref"), F.col("page_held").cast("boolean").alias("page_held"), F.get("rounds", F.lit(0)).alias("round_id"))
        reverts = events.where("event_type = 'revert'").select("channel", "ts", F.lit("recreate").alias("action"), F.col("actor_label").alias("actor"), "event_id", F.get("rel", F.lit(0)).alias("related_event_id"), F.lit(None).cast("string").alias("revision_ref"), F.col("page_held").cast("boolean").alias("page_held"), F.get("rounds", F.lit(0)).alias("round_id"))
        # a revision names the deletions it undoes in parallel lists
        edge = revs.where("relation_type = 'first_recreation_of'").withColumn("rel", _list(revs, "related_event_id")).withColumn("rounds", _list(revs, "round_id"))
        edge = edge.select("channel", "ts", "author_alt", "rev_id", "rounds", F.posexplode("rel").alias("k", "related_event_id"))
        held = dels.select(F.col("event_id").alias("related_event_id"), "page_held")
        recs = edge.join(held, "related_event_id", "left").select("channel", "ts", F.lit("recreate").alias("action"), F.col("author_alt").alias("actor"), F.concat(F.lit("recreate:"), "rev_id").alias("event_id"), "related_event_id", F.col("rev_id").cast("string").alias("revision_ref"), "page_held", F.get("rounds", "k").alias("round_id"))
        return conform(dels.unionByName(recs).unionByName(reverts), "lifecycle")

    @staticmethod
    def _probes(events: DataFrame, revs: DataFrame) -> DataFrame:
        p = events.where("event_type = 'probe'").withColumn("refs", _list(events, "source_refs"))
        site = F.nullif(F.regexp_extract("event_id", r"attacklog_raw_([a-z0-9]+)_", 1), F.lit(""))
        p = p.select(F.col("event_id").alias("probe_id"), "ts", F.coalesce(site, "wiki").alias("site"), F.concat(F.lit("ip16:"), "ip16").alias("actor"), F.col("ip16").cast("string").alias("ip16"), "request_action", "param_family", F.col("success_observed").cast("boolean").alias("success_observed"), "time_grade", F.get("refs", F.lit(0)).alias("source_ref"))
        saves = revs.select("ts", "label", F.col("ip16").cast("string").alias("ip16"))
        return conform(lc.probe_links(p, saves), "probes")
