"""Page snapshots to posts, deletions, recreations and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.repair import repaired
from ..functions.text import SIGNATURE, norm_key, rx, signature_of, stable_id
from .facts import seconds_between
from .scan import median
from .windows import next_at_or_after, sweeps


def split_posts(body: Column) -> Column:
    """Blank-line blocks, cut after every line that ends with a signature."""
    text = F.replace(body, F.lit("\\n"), F.lit("\n"))
    zero = F.struct(F.array().cast("array<string>").alias("cur"), F.array().cast("array<string>").alias("out"))

    def line(acc: Column, x: Column) -> Column:
        cur = F.concat(acc["cur"], F.array(x))
        signed = F.rlike(x, F.lit(rx(SIGNATURE)))
        return F.struct(F.when(signed, F.array().cast("array<string>")).otherwise(cur).alias("cur"), F.when(signed, F.concat(acc["out"], F.array(F.array_join(cur, "\n")))).otherwise(acc["out"]).alias("out"))

    blocks = F.transform(F.split(text, r"\n[ \t-\r\x1c-\x1f\x85\xa0]*\n"), lambda b: F.aggregate(F.split(b, "\n"), zero, line, lambda acc: F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n")))))
    trimmed = F.transform(F.flatten(blocks), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def _lifetimes(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """Adds the deletions so far (``ts`` <= the row's) and the next one after it,
    by one sorted pass per channel."""
    both = rows.select("channel", "ts", F.lit(1).alias("side"), "rev_id").unionByName(deletions.select("channel", "ts", F.lit(0).alias("side"), F.lit(None).cast("string").alias("rev_id")))
    w = W.partitionBy("channel").orderBy("ts", "side")
    marked = both.withColumn("lifetime", F.sum(1 - F.col("side")).over(w.rangeBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("visible_until", F.min(F.when(F.col("side") == 0, F.col("ts"))).over(w.rowsBetween(1, W.unboundedFollowing)))
    return marked.where("side = 1").select("channel", "rev_id", "lifetime", "visible_until")


def snapshots_to_posts(revs: DataFrame, deletions: DataFrame, boilerplate: list[str] | None = None) -> DataFrame:
    """A paragraph is a post the first time its key appears on the page since the
    page was last deleted.  ``revs``: channel, ts, rev_id, author_alt, body."""
    life = _lifetimes(revs, deletions)
    parts = revs.select("channel", "ts", "rev_id", "author_alt", F.posexplode(split_posts(F.col("body"))).alias("i", "post")).withColumn("key", norm_key(F.col("post"))).where("key <> ''")
    if boilerplate:
        spark = revs.sparkSession
        plain = spark.createDataFrame([(b,) for b in boilerplate], "b string").select(norm_key(F.col("b")).alias("key")).distinct()
        parts = parts.join(plain, "key", "left_anti")
    parts = parts.join(life, ["channel", "rev_id"])
    first = W.partitionBy("channel", "lifetime", "key").orderBy("ts", "rev_id", "i")
    new = parts.withColumn("rn", F.row_number().over(first)).where("rn = 1").withColumn("text", repaired(F.col("post")))
    return new.select(
        stable_id(F.col("rev_id"), F.col("i"), F.substring("key", 1, 200)).alias("event_id"), "ts", "channel", F.coalesce(signature_of(F.col("text")), "author_alt").alias("author_raw"), "author_alt", "text",
        F.col("rev_id").alias("parent_id"), "visible_until", "key", F.col("lifetime").cast("bigint").alias("lifetime"),
    )


def restored(revs: DataFrame, deletions: DataFrame) -> DataFrame:
    """(channel, key, restored) of paragraphs seen after a page's first deletion:
    restored if an earlier snapshot had them."""
    first = deletions.groupBy("channel").agg(F.min("ts").alias("first_del"))
    keys = revs.select("channel", "ts", F.explode(split_posts(F.col("body"))).alias("post")).withColumn("key", norm_key(F.col("post"))).where("key <> ''")
    seen = keys.groupBy("channel", "key").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).join(first, "channel").where("hi >= first_del")
    return seen.select("channel", "key", (F.col("lo") < F.col("first_del")).alias("restored"))


def recreations(deletes: DataFrame, revs: DataFrame, tie: str = "rev_id") -> DataFrame:
    """Each deletion with the first revision at or after it on its channel, its time and the
    seconds between; of revisions of one time the least ``tie`` counts.  Deletions that
    nothing follows have a null revision."""
    named = revs.select("channel", "ts", F.struct(F.col(tie).alias("tie"), F.col("rev_id").cast("string").alias("rev_id"), "ts").alias("v"))
    found = next_at_or_after(deletes, named, "channel", "event_id", "v")
    return found.select("event_id", "v.rev_id", F.col("v.ts").alias("rev_ts"), F.col("dt_s").alias("gap_s"))


def recreation_gaps(lifecycle: DataFrame) -> DataFrame:
    """Each recreation that names a known deletion, with the hours between the two."""
    dels = lifecycle.where("action = 'delete'").groupBy(F.col("event_id").alias("related_event_id")).agg(F.max("ts").alias("gone"))
    recs = lifecycle.where("action = 'recreate'").join(dels, "related_event_id")
    return recs.select("channel", "event_id", "related_event_id", "revision_ref", (seconds_between(F.col("ts"), F.col("gone")) / 3600).alias("gap_h"))


def restored_on_recreations(revs: DataFrame, lifecycle: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts on revisions that recreate a page: channel, event_id and whether their text stood
    on the page before the deletion.  ``posts``: event_id, channel, text, parent_id."""
    dels = lifecycle.where("action = 'delete'").select(F.col("event_id").alias("related_event_id"), F.col("ts").alias("gone"))
    first = lifecycle.where("action = 'recreate' and revision_ref <> ''").join(dels, "related_event_id").groupBy(F.col("revision_ref").alias("parent_id")).agg(F.min("gone").alias("gone"))
    new = posts.select("event_id", "channel", "parent_id", norm_key(F.col("text")).alias("key")).join(first, "parent_id")
    old = revs.select("channel", "ts", F.explode(split_posts(F.col("body"))).alias("post")).withColumn("key", norm_key(repaired(F.col("post")))).groupBy("channel", "key").agg(F.min("ts").alias("lo"))
    met = new.join(old, ["channel", "key"], "left")
    return met.select("channel", "event_id", F.coalesce(F.col("lo") < F.col("gone"), F.lit(False)).alias("restored"))


def recreation_check(revs: DataFrame, lifecycle: DataFrame, posts: DataFrame | None = None, cutoff=None, tie: str = "rev_id") -> DataFrame:
    """One row: the source's recreation edges against the rule 'each deletion, the first later
    revision on its page', and the posts on recreations by whether they restore old text.
    Edges of the rule behind ``cutoff`` lie outside of the source's window."""
    recs = lifecycle.where("action = 'recreate'")
    told = recs.where("revision_ref <> ''").select(F.col("related_event_id").alias("event_id"), F.col("revision_ref").alias("rev_id")).distinct().withColumn("told", F.lit(True))
    ruled = recreations(lifecycle.where("action = 'delete'"), revs, tie).where("rev_id is not null").groupBy("event_id", "rev_id").agg(F.max("rev_ts").alias("rev_ts"))
    late = F.col("rev_ts") > F.lit(cutoff).cast("timestamp") if cutoff is not None else F.lit(False)
    both = told.join(ruled.withColumn("ruled", F.lit(True)), ["event_id", "rev_id"], "full")
    edges = both.agg(
        F.count("told").alias("dump_edges_with_revision"), F.count("ruled").alias("pipeline_edges"), F.count_if(F.col("told") & F.col("ruled")).alias("overlap"), F.count_if(F.col("told").isNull()).alias("pipeline_only"),
        F.count_if(F.col("told").isNull() & late).alias("pipeline_only_after_cutoff"), F.count_if(F.col("ruled").isNull()).alias("dump_only"),
    )
    out = recs.agg(F.count(F.lit(1)).alias("dump_edges")).join(edges, how="cross").withColumn("dump_edges_without_revision", F.col("dump_edges") - F.col("dump_edges_with_revision"))  # one row each
    if posts is None:
        return out
    on = restored_on_recreations(revs, lifecycle, posts).agg(F.count(F.lit(1)).alias("posts_on_recreations"), F.count_if("restored").alias("restored_posts"), F.count_if(~F.col("restored")).alias("fresh_posts"))
    return out.join(on, how="cross")


def set_comparison(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """How many keys are in both sides, only left, only right."""
    a, b = left.select(*key, F.lit(1).alias("l")), right.select(*key, F.lit(1).alias("r"))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side")
    return a.join(b, key, "full").groupBy(side).agg(F.count(F.lit(1)).alias("n"))


def recreation_rows(events: DataFrame) -> DataFrame:
    """Revision and revert rows whose parallel lists name the deletions they undo."""
    pairs = events.select("*", F.explode(F.arrays_zip(F.col("related_event_id").alias("related"), F.col("round_id").alias("round"))).alias("p"))
    return pairs.select(*[c for c in events.columns if c not in ("related_event_id", "round_id")], F.col("p.related").alias("related_event_id"), F.col("p.round").alias("round_id"))


def deletion_summary(lifecycle: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    d = lifecycle.where("action = 'delete'")
    out = d.agg(F.count(F.lit(1)).alias("deletions"), F.countDistinct("channel").alias("pages"), F.countDistinct("actor").alias("actors"), F.count_if(F.col("page_held")).alias("held"), F.count_if(~F.col("page_held")).alias("unheld"))
    for gap in (30, 15, 60):
        s = sweeps(d, gap).agg(F.count(F.lit(1)).alias(f"sweeps_{gap}"), F.max("n").alias(f"largest_{gap}"))
        out = out.join(s, how="cross")  # one row each
    out = out.join(median(sweeps(d, 30).select(F.col("n").alias("sweep_median")), "sweep_median").select("sweep_median"), how="left")
    gaps = recreation_gaps(lifecycle)
    recs = lifecycle.where("action = 'recreate'").agg(F.count(F.lit(1)).alias("n_recreate"), F.count_if(F.col("revision_ref") != "").alias("recreate_with_revision"))
    out = out.join(recs, how="cross").join(median(gaps, "gap_h").select(F.col("gap_h").alias("recreate_gap_median_h")), how="left")
    if posts is not None:
        gone = posts.join(d.select("channel").distinct(), "channel", "left_semi").agg(F.count(F.lit(1)).alias("posts_on_deleted"))
        last = posts.agg(F.max("ts").alias("last_write"), F.count(F.lit(1)).alias("posts"), F.count("visible_until").alias("posts_on_deleted_pages"))
        before = d.join(F.broadcast(last.select("last_write")), F.col("ts") <= F.col("last_write")).agg(F.count(F.lit(1)).alias("deleted_before_last_write"))  # one row
        while_writing = posts.join(F.broadcast(last.select("last_write")), F.col("visible_until") <= F.col("last_write")).agg(F.count(F.lit(1)).alias("posts_deleted_while_writing"))
        for one in (gone, last, before, while_writing):
            out = out.join(one, how="cross")
    return out


def deletion_text(s: dict) -> str:
    """The paragraph on deletions and recreations."""
    share = lambda a, b: f"{a / b:.0%}" if b else "0%"
    out = [f"{s['deletions']:,} deletions by {s['actors']:,} actors named {s['pages']:,} pages ({s['held']:,} with a published revision, {s['unheld']:,} without). A gap of over 30 minutes starts a new sweep: {s['sweeps_30']} sweeps, median {s['sweep_median'] or 0:.0f} deletions, the largest {s['largest_30'] or 0:,} ({s['sweeps_15']} at 15 minutes, {s['sweeps_60']} at 60)."]
    if s.get("posts"):
        out.append(f"{s['deleted_before_last_write']:,} deletions ({share(s['deleted_before_last_write'], s['deletions'])}) happened before the last post; {s['posts_on_deleted_pages']:,} of {s['posts']:,} posts ({share(s['posts_on_deleted_pages'], s['posts'])}) sit on pages that were deleted later, {s['posts_deleted_while_writing']:,} of them while others still wrote.")
    if s.get("n_recreate"):
        gap = f", median {s['recreate_gap_median_h']:.1f} h after the deletion" if s.get("recreate_gap_median_h") is not None else ""
        out.append(f"Recreations: {s['n_recreate']} in the source ({s['recreate_with_revision']} with a stored revision{gap}).")
    c = s.get("check")
    if c:
        late = f" ({c['pipeline_only_after_cutoff']} after the source's cutoff)" if c.get("pipeline_only_after_cutoff") else ""
        out.append(f"The rule 'each deletion, the first later revision' finds {c['pipeline_edges']} edges: {c['overlap']} shared with the source, {c['pipeline_only']} not in it{late}, {c['dump_only']} of the source's {c['dump_edges_with_revision']} missed.")
        if "posts_on_recreations" in c:
            out.append(f"Of {c['posts_on_recreations']} posts on recreations {c['restored_posts']} restore text that stood there before and {c['fresh_posts']} are new.")
    return " ".join(out) + "\n"


def probe_links(probes: DataFrame, saves: DataFrame, within_s: float = 1.0) -> DataFrame:
    """Each probe with the nearest save on its prefix, how many labels the prefix
    has, and its only label if a save that carries it lies within ``within_s``
    (saves without a label never hide one that has a label)."""
    from .windows import nearest

    labelled = saves.where("label <> ''")
    near = nearest(probes, saves, "ip16", "probe_id", "label").select("probe_id", F.expr("nullif(label, '')").alias("nearest_save_label"), F.col("dt_s").alias("nearest_save_dt_s"))
    labels = labelled.groupBy("ip16").agg(F.countDistinct("label").cast("int").alias("n_labels_on_prefix"), F.min("label").alias("only"))
    close = nearest(probes, labelled, "ip16", "probe_id", "label").where(F.abs("dt_s") <= within_s).select("probe_id", F.lit(True).alias("close"))
    out = probes.join(near, "probe_id", "left").join(close, "probe_id", "left").join(labels, "ip16", "left")
    cotimed = F.when(F.col("close") & (F.col("n_labels_on_prefix") == 1), F.col("only"))
    return out.withColumn("cotimed_label", cotimed).withColumn("n_labels_on_prefix", F.coalesce("n_labels_on_prefix", F.lit(0))).drop("only", "close")


def probe_summary(probes: DataFrame) -> DataFrame:
    return probes.groupBy("request_action", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("probes"), F.countDistinct("ip16").alias("prefixes"), F.count_if(F.col("success_observed")).alias("succeeded"), F.count("cotimed_label").alias("cotimed"))


def probe_totals(probes: DataFrame) -> DataFrame:
    """One row: probes, prefixes, successes, co-timed ones, the busiest day and prefix (ties:
    the first), and how many different payloads - actions with markup - there are."""
    action = F.col("request_action")
    out = probes.agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("ip16").alias("n_ip16"), F.count_if(F.col("success_observed")).alias("n_success"),
        F.count("cotimed_label").alias("n_cotimed"), F.countDistinct(F.when(action.contains("<"), action)).alias("n_payloads"), F.count_if(action.contains("<")).alias("with_payload"),
    )
    for name, key in (("top_day", F.date_format("ts", "yyyy-MM-dd")), ("top_ip16", F.col("ip16").cast("string"))):
        by_count = probes.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c")).where("k is not null").groupBy("c").agg(F.min("k").alias("k"))
        out = out.join(by_count.agg(F.max_by("k", "c").alias(name), F.max("c").alias(f"{name}_n")), how="cross")  # one row each
    return out


def probe_actions(probes: DataFrame) -> DataFrame:
    """Probes by action; all payloads are one."""
    action = F.when(F.col("request_action").contains("<"), "<payload>").otherwise(F.col("request_action"))
    return probes.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("probes"))


def delete_lag(events: DataFrame) -> DataFrame:
    """Histogram of whole seconds from request to success."""
    lag = F.floor(seconds_between(F.col("ts"), F.col("request_ts"))).alias("lag_s")
    return events.where("request_ts is not null").groupBy(lag).agg(F.count(F.lit(1)).alias("n"))


def lifecycle_from_channels(channels: DataFrame) -> DataFrame:
    rows = channels.select("channel", F.explode(F.array(F.struct(F.col("created").alias("ts"), F.lit("create").alias("action")), F.struct(F.col("deleted").alias("ts"), F.lit("delete").alias("action")))).alias("x"))
    return rows.select("channel", "x.ts", "x.action").where("ts is not null")
