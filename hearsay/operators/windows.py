"""Sessions, versions, interval joins and as-of joins over timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import checkpoint, written
from .facts import seconds_between
from .scan import previous, ranged, running


def sessions(df: DataFrame, gap_s: float, by: list[str], ts: str = "ts", order: list[str] | None = None, page: str | None = None) -> DataFrame:
    """Gap sessionisation: a gap longer than ``gap_s`` starts a new session.

    Without ``by`` the one timeline is cut into days: rows compare within their
    day, and only one row a day - its last time, its number of sessions - goes
    through an unpartitioned window.
    """
    order = order or []
    if by:
        w = W.partitionBy(*by).orderBy(ts, *order)
        fresh = F.coalesce((seconds_between(F.col(ts), F.lag(ts).over(w)) > gap_s).cast("int"), F.lit(1))
        numbered = df.withColumn("session", F.sum(fresh).over(w.rowsBetween(W.unboundedPreceding, 0)))
    else:
        days = W.orderBy("__day")
        d = df.withColumn("__day", F.to_date(ts))
        w = W.partitionBy("__day").orderBy(ts, *order)
        last = d.groupBy("__day").agg(F.max(ts).alias("__last")).withColumn("__last", F.lag("__last").over(days))
        before = F.coalesce(F.lag(ts).over(w), F.col("__last"))
        d = d.join(last, "__day").withColumn("__fresh", F.coalesce((seconds_between(F.col(ts), before) > gap_s).cast("int"), F.lit(1)))
        so_far = d.groupBy("__day").agg(F.sum("__fresh").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        numbered = d.join(so_far, "__day").withColumn("session", F.col("__n") + F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    more = [F.countDistinct(page).alias("pages")] if page else []
    return numbered.groupBy(*by, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), *more)


def sweeps(deletes: DataFrame, gap_min: float = 30, by: list[str] | None = None) -> DataFrame:
    """Deletions in one go; one run over all channels unless ``by`` splits it."""
    return sessions(deletes.where("ts is not null"), gap_min * 60, by or [], order=["channel"], page="channel")


def latest_versions(df: DataFrame, key: list[str], version: str, tie: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("latest", F.row_number().over(w) == 1)


def batches(goals: DataFrame, gap_s: float = 600) -> DataFrame:
    """Goals created together: a gap over ``gap_s`` starts a batch; its name is the
    day ('Jul06'), later batches of a day get b, c, ...; without a time it is ''."""
    at = F.coalesce("created", "start")
    known = goals.withColumn("at", at).where("at is not null").withColumn("day", F.date_format("at", "MMMdd"))
    order = ["at", "goal_id"]
    rows = previous(ranged(known.select("at", "goal_id", "day"), order), {"before": "at"}, order)
    fresh = F.coalesce((seconds_between(F.col("at"), F.col("before")) > gap_s).cast("bigint"), F.lit(1))
    numbered = running(rows, {"run": fresh}, order)
    heads = numbered.groupBy("run").agg(F.min_by("day", F.struct("at", "goal_id")).alias("token"))
    place = F.row_number().over(W.partitionBy("token").orderBy("run"))
    named = heads.withColumn("k", place).withColumn("batch", F.concat("token", F.when(F.col("k") > 1, F.char(F.lit(96) + F.col("k"))).otherwise("")))
    return goals.drop("batch").join(numbered.select("goal_id", "run"), "goal_id", "left").join(named.select("run", "batch"), "run", "left").withColumn("batch", F.coalesce("batch", F.lit(""))).drop("run")


def goal_changes(goals: DataFrame) -> DataFrame:
    """Each goal of an agent against the one before it."""
    w = W.partitionBy("agent_id").orderBy("start", "goal_id")
    before, until = F.lag("role").over(w), F.lag("end").over(w)
    kind = F.when(before.isNull(), "first").when(before == F.col("role"), "reworded").otherwise("reassigned")
    return goals.select("goal_id", "agent_id", "role", "start", kind.alias("change"), F.coalesce(until.isNull() & before.isNotNull() | (until > F.col("start")), F.lit(False)).alias("overlaps"))


def window_gaps(eras: DataFrame, by: list[str], key: str) -> DataFrame:
    """Seconds from a window's end to the next one's start: gap > 0, overlap < 0."""
    w = W.partitionBy(*by).orderBy("start", key)
    return eras.select(*by, key, "start", "end", seconds_between(F.lead("start").over(w), F.col("end")).alias("diff_s"))


def _inside(ts: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (start <= ts)) & (end.isNull() | (ts < end))


#: One row of so many may have the same key before the key is cut into buckets of time.
OFTEN = 1000
#: The share of rows that are looked at to find such keys.
LOOK = 0.01
#: The bucket of keys that are not cut.
WHOLE = -(1 << 62)


def _often(keys: DataFrame) -> DataFrame:
    """(__key, often): keys with over one of ``OFTEN`` rows, by a sample - fewer than ``OFTEN`` keys.
    It only says which keys are cut; results are the same for any cut."""
    n = checkpoint(keys.where("__key is not null").sample(LOOK, seed=0).groupBy("__key").agg(F.count(F.lit(1)).alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    return n.where((F.col("n") * OFTEN > total) & (F.col("n") >= 10)).select("__key", F.lit(True).alias("often"))


def _held(points: DataFrame, windows: DataFrame, window_id: str, bucket_s: int, edges: bool) -> DataFrame:
    """``points``: __key, ts and ``row``; ``windows``: __key, start, end and an id.  Adds to
    each point ``held``, (start, id) of the last window by start that holds it, and with
    ``edges`` ``near``, (microseconds, id) of the nearest edge of a window of its key.

    Starts, ends and points of a key go through sorted passes in one shuffle.  Keys with a large
    share of the rows are cut into buckets of time; a bucket starts from what the buckets before
    (and after) it carry.  The last window to start is the answer unless it has ended; only points
    after its end ask the tree of ``era_join``.  Both tables are read several times.
    """
    us = F.unix_micros
    begin = F.coalesce("start", F.lit("0001-01-01").cast("timestamp"))
    w = windows.select("__key", "start", "end", begin.alias("s"), F.col(window_id).alias("w"))
    h, edge = F.struct("s", "w", "end"), F.struct("w")
    # a window that ends where it starts holds nothing
    some = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < F.col("end"))
    side = w.select("__key", F.col("s").alias("ts"), F.when(some, h).alias("h"), F.when(F.col("start").isNotNull(), edge).alias("edge"))
    kinds = {c: side.schema[c].dataType for c in ("h", "edge")}
    if edges:
        side = side.unionByName(w.where("end is not null").select("__key", F.col("end").alias("ts"), F.lit(None).cast(kinds["h"]).alias("h"), edge.alias("edge")))
    row = points.schema["row"].dataType
    rows = side.select("*", F.lit(0).alias("side"), F.lit(None).cast(row).alias("row"))
    rows = rows.unionByName(points.where("ts is not null").select("__key", "ts", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], F.lit(1).alias("side"), "row"))
    often = _often(points.select("__key").union(windows.select("__key")))
    rows = rows.join(F.broadcast(often), "__key", "left").withColumn("bucket", F.when(F.col("often"), F.floor(us("ts") / F.lit(bucket_s * 1_000_000)).cast("bigint")).otherwise(F.lit(WHOLE)))
    rows = rows.drop("often").repartition("__key", "bucket")
    # of equal edges the least window counts: minima of (distance from one end of time, window)
    told = {"past": F.struct((-us("ts")).alias("at"), F.col("edge.w").alias("w")), "next": F.struct(us("ts").alias("at"), F.col("edge.w").alias("w"))} if edges else {}
    rows = rows.withColumns({c: F.when(F.col("edge").isNotNull(), v) for c, v in told.items()}) if edges else rows
    key = W.partitionBy("__key").orderBy("bucket")
    before, after = key.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("__key").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.where(F.col("bucket") != WHOLE).groupBy("__key", "bucket").agg(F.max("h").alias("th"), *[F.min(c).alias(f"t_{c}") for c in told])
    carried = totals.select("__key", "bucket", F.max("th").over(before).alias("ch"), *[F.min(f"t_{c}").over(over).alias(f"c_{c}") for c, over in zip(told, (before, after), strict=False)])
    place = W.partitionBy("__key", "bucket")
    up, down = place.orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0), place.orderBy(F.desc("ts"), "side").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"lh": F.max("h").over(up), **{f"l_{c}": F.min(c).over(over) for c, over in zip(told, (up, down), strict=False)}}).where("side = 1")
    away = lambda c, sign: F.when(F.col(c).isNotNull(), F.struct(F.abs(sign * F.col(f"{c}.at") - us("ts")).alias("d"), F.col(f"{c}.w").alias("w")))
    found = rows.join(carried, ["__key", "bucket"], "left").select("__key", "ts", "row", F.greatest("lh", "ch").alias("h"), *[F.least(f"l_{c}", f"c_{c}").alias(c) for c in told])
    near = F.least(away("past", -1), away("next", 1)) if edges else F.lit(None).cast("struct<d:bigint,w:int>")
    opened = F.col("h").isNotNull() & (F.col("h.end").isNull() | (F.col("ts") < F.col("h.end")))
    ended = F.col("h").isNotNull() & ~opened
    # where a window is found nothing else is asked for
    found = written(found.select(*[F.when(ended, F.col(c)).alias(c) for c in ("__key", "ts")], "row", F.when(opened, F.struct("h.s", "h.w")).alias("held"), ended.alias("ended"), F.when(~opened, near).alias("near")))
    late = found.where("ended")
    if not late.isEmpty():
        asked = late.select("__key", "ts").distinct().withColumn("__p", F.struct("__key", "ts"))
        # only windows of keys that ask enter the tree
        theirs = windows.join(asked.select("__key").distinct(), "__key", "left_semi")
        deep = era_join(asked, theirs, bucket_s, window_id, "__p", ("__key",)).where(F.col(window_id).isNotNull())
        deep = deep.select("__p.*", F.struct(F.lit(None).cast("timestamp").alias("s"), F.col(window_id).alias("w")).alias("deep"))
        late = late.join(deep, ["__key", "ts"], "left").withColumn("held", F.coalesce("held", "deep"))
        found = found.where("not ended").unionByName(late.drop("deep"))
    # a point without a time is held by windows without edges; else the least window is as near as any
    edgeless = F.max(F.when(F.col("start").isNull() & F.col("end").isNull(), F.struct("s", "w")))
    known = w.groupBy("__key").agg(edgeless.alias("held"), F.min(F.struct(F.lit(1 << 62).alias("d"), F.col("w"))).alias("near"))
    timeless = points.where("ts is null").join(known, "__key", "left").select("row", "held", *(["near"] if edges else []))
    return found.select(*timeless.columns).unionByName(timeless)


def window_join(events: DataFrame, windows: DataFrame, key: str, window_id: str, event_id: str = "event_id", bucket_s: int = 30 * 86400) -> DataFrame:
    """Interval join on a key: the last window by start that holds the event, else
    the one with the nearest edge (``in_window`` false); one row per event.  Events
    meet windows in a sorted pass, not in pairs."""
    events = written(events.select(key, "ts", event_id))
    points = events.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), "ts", F.struct(F.col(event_id).alias("id")).alias("row"))
    windows = written(windows.select(F.col(key).alias("__key"), "start", "end", window_id))
    found = _held(points, windows, window_id, bucket_s, True).select("row.id", "held", "near")
    lost = events.where(F.col(key).isNull()).select(F.col(event_id).alias("id"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("held", "near")])
    out = found.unionByName(lost).groupBy("id").agg(F.max("held").alias("held"), F.min("near").alias("near"))
    return out.select(F.col("id").alias(event_id), F.coalesce("held.w", "near.w").alias(window_id), F.when(F.col("held").isNotNull(), True).when(F.col("near").isNotNull(), False).alias("in_window"))


def era_join(events: DataFrame, eras: DataFrame, bucket_s: int, era_id: str = "era_id", event_id: str = "event_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Interval join; the latest window wins, of those with the event's ``by`` if
    there is any.  One row per event id: rows that share an id, a missing one too,
    count as one event.

    Time is cut into buckets of ``bucket_s``.  The buckets that a window covers
    wholly are a few nodes of a binary tree over the buckets, and a node keeps its
    latest window only; a bucket asks its ancestors.  Only the buckets in which a
    window begins or ends compare events with that window.
    """
    keys = {c: f"__by{i}" for i, c in enumerate(by)}
    by, events, eras = list(keys.values()), events.withColumns({n: F.col(c) for c, n in keys.items()}), eras.withColumnsRenamed(keys)
    step, far = bucket_s * 1_000_000, 1 << 40
    at = lambda c: F.floor(F.unix_micros(c) / F.lit(step)).cast("bigint")
    lo, hi = at("start"), at("end")
    first = F.when(F.unix_micros("start") == lo * step, lo).otherwise(F.coalesce(lo + 1, F.lit(-far)))
    h = F.struct(F.coalesce("start", F.lit("0001-01-01").cast("timestamp")).alias("s"), F.col(era_id).alias("w"))
    w = eras.select(*by, "start", "end", lo.alias("lo"), hi.alias("hi"), first.alias("a"), F.coalesce(hi, F.lit(far)).alias("b"), h.alias("h"))
    ranges = w.groupBy(*by, "a", "b").agg(F.max("h").alias("h"))
    left, right = "-shiftright(-a, k)", "shiftright(b, k)"
    ends = [f"if({left} < {right} and {x} % 2 <> 0, named_struct('k', k, 'node', {y}), null)" for x, y in ((left, left), (right, f"{right} - 1"))]
    covered = F.expr(f"filter(flatten(transform(sequence(0, 41), k -> array({', '.join(ends)}))), x -> x is not null)")
    always = F.when((F.col("a") == -far) & (F.col("b") == far), F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("bigint").alias("node")))).otherwise(F.expr("cast(array() as array<struct<k:int,node:bigint>>)"))
    nodes = ranges.select(*by, "h", F.explode(F.concat(covered, always)).alias("n")).groupBy(*by, "n.k", "n.node").agg(F.max("h").alias("h"))
    ev = events.select(*by, event_id, "ts", at("ts").alias("bucket"))
    # an event without a time is held by windows without a start and an end
    up = F.expr("if(bucket is null, array(named_struct('k', -1, 'node', 0L)), transform(sequence(0, 41), k -> named_struct('k', k, 'node', shiftright(bucket, k))))")
    best = ev.select(*by, "bucket").distinct().select(*by, "bucket", F.explode(up).alias("n")).select(*by, "bucket", "n.k", "n.node").join(nodes, [*by, "k", "node"]).groupBy(*by, "bucket").agg(F.max("h").alias("h"))
    same = ev["bucket"].eqNullSafe(best["bucket"])
    for c in by:
        same = same & (ev[c] == best[c])
    # without keys there is one row a bucket of time, so events stay where they are;
    # an event that no node holds stays, with no window
    whole = ev.join(best if by else F.broadcast(best), same, "left").select(event_id, "h")
    edges = w.select(*by, "start", "end", "h", F.explode(F.array_compact(F.array_distinct(F.array(*[F.when(F.unix_micros(c) != F.col(n) * step, F.col(n)) for c, n in (("start", "lo"), ("end", "hi"))])))).alias("bucket"))
    cut = ev if by else ev.join(F.broadcast(edges.select("bucket").distinct()), "bucket", "left_semi")
    part = cut.join(edges, [*by, "bucket"]).where(_inside(F.col("ts"), F.col("start"), F.col("end"))).select(event_id, "h")
    held = whole.unionByName(part).groupBy(event_id).agg(F.max("h").alias("h"))
    return held.select(event_id, F.col("h.w").alias(era_id))


def _around(left: DataFrame, right: DataFrame, key: str, left_id: str, value: str, bucket_s: int = 30 * 86400) -> DataFrame:
    """Left rows (key, ts, lid) with the right rows around them, as (ts, v): ``b``, the last one
    before, and ``a``, the first one at or after; of equal times the greatest and the least v.

    Both sides go through two sorted passes, cut into buckets of time: a bucket starts from what
    the buckets before, or after, it carry.  No frame looks ahead, so a pass is linear."""
    us = F.unix_micros
    told = right.where("ts is not null")
    both = left.select(F.col(key).alias("key"), "ts", F.lit(0).alias("side"), F.col(left_id).alias("lid"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    both = both.unionByName(told.select(F.col(key).alias("key"), "ts", F.lit(1).alias("side"), F.lit(None).cast(left.schema[left_id].dataType).alias("lid"), F.col(value).alias("v")))
    both = both.withColumn("r", F.when(F.col("side") == 1, F.struct("ts", "v"))).withColumn("bucket", F.coalesce(F.floor(us("ts") / F.lit(bucket_s * 1_000_000)).cast("bigint"), F.lit(-(1 << 62))))
    over = W.partitionBy("key")
    earlier, later = (over.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("bucket", F.desc("bucket")))
    totals = both.groupBy("key", "bucket").agg(F.max("r").alias("hi"), F.min("r").alias("lo"))
    carried = totals.select(F.col("key").alias("__k"), F.col("bucket").alias("__b"), F.max("hi").over(earlier).alias("cb"), F.min("lo").over(later).alias("ca"))
    place = W.partitionBy("key", "bucket")
    up = place.orderBy("ts", "side", "v").rowsBetween(W.unboundedPreceding, -1)
    down = place.orderBy(F.desc("ts"), F.desc("side"), F.desc("v")).rowsBetween(W.unboundedPreceding, -1)
    rows = both.withColumns({"hb": F.last("r", ignorenulls=True).over(up), "ha": F.last("r", ignorenulls=True).over(down)}).where("side = 0")
    met = rows.join(carried, F.col("key").eqNullSafe(F.col("__k")) & (F.col("bucket") == F.col("__b")))
    alone = F.col("key").isNotNull()
    return met.select("key", "ts", "lid", F.when(alone, F.coalesce("hb", "cb")).alias("b"), F.when(alone, F.coalesce("ha", "ca")).alias("a"))


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, value: str) -> DataFrame:
    """Two-sided as-of join on a key: per left row the right row with the least
    distance in time; ties go to the earlier one.  No pairs are formed: the
    neighbours of a left row are the right rows around it."""
    near = _around(left, right, key, left_id, value)
    db, da = F.abs(seconds_between(F.col("ts"), F.col("b.ts"))), F.abs(seconds_between(F.col("a.ts"), F.col("ts")))
    pick = F.when(F.col("a").isNull() | (db <= da), F.struct(db.alias("d"), F.col("b.v").alias("v"))).otherwise(F.struct(da.alias("d"), F.col("a.v").alias("v")))
    return near.select(F.col("lid").alias(left_id), pick["v"].alias(value), pick["d"].alias("dt_s"))


def next_at_or_after(left: DataFrame, right: DataFrame, key: str, left_id: str, value: str) -> DataFrame:
    """Forward as-of join: per left row the first right row with ts >= its ts."""
    near = _around(left, right, key, left_id, value)
    return near.select(F.col("lid").alias(left_id), F.col("a.v").alias(value), seconds_between(F.col("a.ts"), F.col("ts")).alias("dt_s"))


def in_any_window(events: DataFrame, windows: DataFrame, key: str, bucket_s: int = 30 * 86400) -> DataFrame:
    """Interval semi-join: events that lie in at least one window of their key."""
    events = written(events)
    points = events.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), "ts", F.struct(*events.columns).alias("row"))
    spans = written(windows.select(F.col(key).alias("__key"), "start", "end", F.lit(0).alias("__w")))
    return _held(points, spans, "__w", bucket_s, False).where("held is not null").select("row.*")


def calendar_counts(events: DataFrame, group: str, first: str, last: str) -> DataFrame:
    """(group, day) counts, zero-filled from ``first`` to ``last``."""
    days = events.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    counts = events.groupBy(group, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # groups x days of the calendar: both are small dimensions
    grid = events.select(group).distinct().join(days, how="cross")
    return grid.join(counts, [group, "day"], "left").select(group, "day", F.coalesce("n", F.lit(0)).alias("n"))
