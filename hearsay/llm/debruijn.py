"""Substring dedup over words by de Bruijn compaction.

Edges of the graph are windows of 35 words; its nodes are the 34 words that an
edge begins or ends with.  What is wanted are the repeated edges.

1. Neighbouring edges of a document whose minimizer (the k-mer of words with the
   smallest hash) is at one place are a local path: at most 24 edges, so the hashes
   of its two end nodes and its length stand for all of its words.  Paths are dealt
   by minimizer, and those that are met once only leave the graph.
2. Where different paths meet under one minimizer the graph may branch inside of
   them: one path of each kind is opened into its edges, of which the repeated ones
   stay.
3. Multiplicities and degrees decide what is compacted.  A node is inner if one
   path enters it, one leaves it, and every occurrence of the one goes on with the
   other: no document begins or ends its repeat there.  Spark joins compact chains
   of such nodes by pointer doubling, so n links take about log2(n) joins.  All
   occurrences of a compacted path are whole, and it carries their number.
4. The occurrences of compacted paths seen twice or more are the long spans.  They
   are verified at their source coordinates: the words there must have one 128-bit
   BLAKE2b digest per compacted path.  Equal words have equal hashes, so no repeat is
   missed; if different words were taken for equal, all is done again with words
   hashed in another way.

Defined results: null, empty and short texts (fewer words than a window) lose
nothing; repeated rows are repeats of each other; windows never cross
documents; words are runs of bytes other than ASCII blanks and keep their form;
very long texts are read whole, and no step holds more than a batch of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SLICES, apply_spans, batches_of, by_part, covered, dealt, minimizer_runs, part_by_part, part_of, with_key
from .store import drop, materialize, partitions, small_batches, tidy
from .words import digests, give_back, grams, pair, runs, text_bytes, word_hashes, words_of

#: s, t: hashes of the nodes at both ends.
PATH = np.dtype([("h", "<u8"), ("s", "<u8"), ("t", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("many", "u1")])
EDGE = np.dtype([("s", "<u8"), ("t", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("many", "u1")])
#: Paths and edges that a task holds before it sends them.
HELD = 200_000
#: At most so many paths are broadcast.
HEAVY = 1000
PARTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
PLACES, ASKS, NODES = 0, 1, 2
#: An occurrence of a repeated path (PLACES: key, path, lo, n), or a path that is to
#: be opened (ASKS: key, lo, n), or the ends of a path (NODES: path, a, b, n).
ROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("path", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
ROW_SQL = "kind int, key bigint, path bigint, lo bigint, n bigint, a bigint, b bigint"


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(np.full(size, kind), pa.int32())]
    arrays += [pa.array(columns[f.name].astype(np.int64)) if f.name in columns else pa.nulls(size, pa.int64()) for f in list(ROW)[1:]]
    return pa.RecordBatch.from_arrays(arrays, schema=ROW)


def _grouped(r: np.ndarray, *by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r in order, where each content begins, how many rows it has)."""
    r = r[np.lexsort([r[f] for f in ("lo", "doc", "n", "t", "s", *by)])]
    fresh = np.append(True, np.zeros(len(r) - 1, bool)) if len(r) else np.empty(0, bool)
    for f in ("n", "t", "s", *by):
        fresh[1:] |= r[f][1:] != r[f][:-1]
    first = np.flatnonzero(fresh)
    return r, first, np.diff(np.append(first, len(r)))


def _ids(r: np.ndarray) -> np.ndarray:
    return pair(pair(r["s"], r["t"]), r["n"].astype(np.uint64)).view(np.int64)


def _places(r: np.ndarray) -> pa.RecordBatch:
    return _rows(PLACES, len(r), key=r["doc"], path=_ids(r), lo=r["lo"], n=r["n"])


def _nodes(r: np.ndarray) -> pa.RecordBatch:
    return _rows(NODES, len(r), path=_ids(r), n=r["n"], a=r["s"].view(np.int64), b=r["t"].view(np.int64))


def _heads(r: np.ndarray, *by: str) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each content, ``many`` where it has several; the other rows)."""
    r, first, size = _grouped(r, *by)
    heads = r[first]
    heads["many"] |= size > 1
    other = np.ones(len(r), bool)
    other[first] = False
    return heads, r[other]


def repeated_paths(keyed: DataFrame, length: int, k: int, salt: int = 0) -> list[DataFrame]:
    """Tables with the PLACES of repeated paths and edges, and their NODES."""
    spark = keyed.sparkSession
    parts = SLICES * partitions(spark)

    def words(data, offsets):
        starts, ends, first = words_of(data, offsets)
        return first, word_hashes(data, starts, ends, salt)

    def sent(held: list[np.ndarray], by: str | None) -> Iterator[tuple]:
        """One row of each content goes to meet others, the rest to the documents."""
        heads, other = _heads(np.concatenate(held), *([by] if by else []))
        for p, rows in by_part(heads, part_of(heads[by or "s"], parts)):
            yield p, 0, rows.tobytes()
        for p, rows in by_part(other, part_of(other["doc"].astype(np.uint64), parts)):
            yield p, 1, rows.tobytes()

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = text_bytes(batch.column(1))
            for a, b in runs(at):
                first, h = words(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                own, lo, n, _, kmer = minimizer_runs(h, first, length, k)
                node = grams(h, length - 1)
                r = np.empty(len(lo), PATH)
                r["h"], r["doc"], r["lo"], r["n"], r["many"] = kmer, keys[a:b][own], lo - first[own], n, 0
                r["s"], r["t"] = node[lo], node[lo + n]
                held.append(r)
                size += len(r)
                if size >= HELD:
                    yield from batches_of(sent(held, "h"), PARTS)
                    held, size = [], 0
        if held:
            yield from batches_of(sent(held, "h"), PARTS)
        held.clear()
        give_back()

    def meet(batches):
        for kinds, blobs in part_by_part(batches, [1, 2]):
            other = np.frombuffer(b"".join(x for i, x in zip(kinds, blobs, strict=True) if i == 1), PATH)
            r = np.frombuffer(b"".join(x for i, x in zip(kinds, blobs, strict=True) if i == 0), PATH)
            del blobs
            yield _places(other)
            r, first, size = _grouped(r, "h")
            if not len(r):
                continue
            many = np.logical_or.reduceat(r["many"] > 0, first) | (size > 1)
            yield _places(r[np.repeat(many, size)])
            heads = r[first]
            yield _nodes(heads[many])
            h = np.flatnonzero(np.append(True, heads["h"][1:] != heads["h"][:-1]))
            contents = np.diff(np.append(h, len(heads)))
            # different paths under one minimizer: edges of one may be edges of another
            ask = heads[np.repeat(contents, contents) > 1]
            yield _rows(ASKS, len(ask), key=ask["doc"], lo=ask["lo"], n=ask["n"])
        give_back()

    met = materialize(dealt(keyed.select("key", "text").mapInArrow(cut, "part int, kind int, blob binary"), parts).mapInArrow(meet, ROW_SQL), "paths")
    tidy(spark)

    def open_up(batches):
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = text_bytes(batch.column(1))
            asked, cuts = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
            cuts = cuts - cuts[0]
            asked_lo, asked_n = (asked.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, b in runs(at):
                first, h = words(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                node = grams(h, length - 1)
                asks = np.diff(cuts[a : b + 1])
                lo, n = asked_lo[cuts[a] : cuts[b]], asked_n[cuts[a] : cuts[b]]
                run, j = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = (lo + np.repeat(first[:-1], asks))[run] + j
                e = np.empty(len(run), EDGE)
                # an edge of a path that occurs again is repeated, and is covered by it
                e["s"], e["t"], e["doc"], e["lo"], e["n"], e["many"] = node[w], node[w + 1], np.repeat(keys[a:b], asks)[run], lo[run] + j, 1, 0
                held.append(e)
                size += len(e)
                if size >= HELD:
                    yield from batches_of(sent(held, None), PARTS)
                    held, size = [], 0
        if held:
            yield from batches_of(sent(held, None), PARTS)
        held.clear()
        give_back()

    def compare(batches):
        for kinds, blobs in part_by_part(batches, [1, 2]):
            edges, other = (np.frombuffer(b"".join(x for i, x in zip(kinds, blobs, strict=True) if i == kind), EDGE) for kind in range(2))
            del blobs
            yield _places(other)
            r, first, size = _grouped(edges)
            if not len(r):
                continue
            many = np.logical_or.reduceat(r["many"] > 0, first) | (size > 1)
            yield _places(r[np.repeat(many, size)])
            yield _nodes(r[first][many])
        give_back()

    asks = met.where(F.col("kind") == ASKS).groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("asks"))
    opened = keyed.select("key", "text").join(asks, "key").select("key", "text", "asks").mapInArrow(open_up, "part int, kind int, blob binary")
    found = materialize(dealt(opened, parts).mapInArrow(compare, ROW_SQL), "edges")
    tidy(spark)
    return [met, found]


def compacted(paths: DataFrame, followed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(path, root, ahead, seen) of every path that occurs twice or more: the first
    path of its nonbranching chain, the edges between that one's beginning and its
    own, and the number of occurrences that the whole chain has; and the tables
    written for it.  ``paths``: path, a, b, n, seen; ``followed``: path, next and
    the number ``both`` of places where the one goes on with the other."""
    paths = paths.where("seen > 1")
    touch = paths.select(F.col("b").alias("node"), F.struct("path", "seen", "n").alias("enters"), F.lit(None).cast("struct<path: bigint, seen: bigint>").alias("leaves"))
    touch = touch.unionByName(paths.select(F.col("a").alias("node"), F.lit(None).cast("struct<path: bigint, seen: bigint, n: bigint>").alias("enters"), F.struct("path", "seen").alias("leaves")))
    degrees = touch.groupBy("node").agg(F.count("enters").alias("into"), F.count("leaves").alias("out"), F.max("enters").alias("enters"), F.max("leaves").alias("leaves"))
    # one path in, one out, as often the one as the other, and always one after the other
    joints = degrees.where("into = 1 and out = 1 and enters.path <> leaves.path and enters.seen = leaves.seen")
    joints = joints.select(F.col("leaves.path").alias("path"), F.col("enters.path").alias("root"), F.col("enters.n").alias("ahead"), F.col("enters.seen").alias("both"))
    always = followed.select(F.col("next").alias("path"), F.col("path").alias("root"), "both")
    links = materialize(joints.join(always, ["path", "root", "both"], "left_semi").select("path", "root", "ahead"), "path-links")
    done = links.limit(0)
    written = [links]
    while not links.isEmpty():
        step = links.withColumn("ended", F.lit(False)).unionByName(done.withColumn("ended", F.lit(True)))
        step = step.select(F.col("path").alias("root"), F.col("root").alias("root2"), F.col("ahead").alias("ahead2"), "ended")
        moved = links.join(step, "root", "left").select("path", F.coalesce("root2", "root").alias("root"), (F.col("ahead") + F.coalesce("ahead2", F.lit(0))).alias("ahead"), F.coalesce("ended", F.lit(True)).alias("end"))
        moved = materialize(moved, "path-links")
        written.append(moved)
        ended = moved.where("end").drop("end")
        # some link of every chain ends in every round: what is left are rings, whose paths stay as they are
        if ended.isEmpty():
            break
        done = done.unionByName(ended)
        links = moved.where("not end").drop("end")
    out = paths.select("path", "seen").join(done, "path", "left")
    return out.select("path", F.coalesce("root", "path").alias("root"), F.coalesce("ahead", F.lit(0).cast("bigint")).alias("ahead"), "seen"), written


def long_spans(found: DataFrame) -> DataFrame:
    """(key, spans): (first edge, edges, compacted path) of each document."""
    places = materialize(found.where(F.col("kind") == PLACES).select("key", "path", "lo", "n").distinct(), "places")
    seen = places.groupBy("path").agg(F.count("*").alias("seen"))
    paths = found.where(F.col("kind") == NODES).select("path", "a", "b", "n").dropDuplicates(["path"]).join(seen, "path")
    after = places.select("key", F.col("path").alias("next"), F.col("lo").alias("end"))
    followed = places.select("key", "path", (F.col("lo") + F.col("n")).alias("end")).join(after, ["key", "end"]).groupBy("path", "next").agg(F.count("*").alias("both"))
    chains, written = compacted(paths, followed)
    chains = materialize(chains.where("seen > 1"), "chains")
    # fewer than HEAVY paths have over a HEAVY-th of all places: these meet their places without a shuffle
    heavy = F.col("seen") > places.count() / HEAVY
    often = chains.where(heavy).drop("seen")
    rest = places.join(F.broadcast(often.select("path")), "path", "left_anti").join(chains.where(~heavy).drop("seen"), "path")
    on = places.join(F.broadcast(often), "path").unionByName(rest).select("key", "lo", "n", "root", (F.col("lo") - F.col("ahead")).alias("origin"))
    # every occurrence of a chain is whole
    spans = on.groupBy("key", "root", "origin").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"))
    out = materialize(spans.groupBy("key").agg(F.collect_list(F.struct("lo", "n", "root")).alias("spans")), "long-spans")
    drop(found.sparkSession, places, chains, *written)
    return out


def mistaken(keyed: DataFrame, spans: DataFrame, length: int) -> bool:
    """Whether the words at the source coordinates of some compacted path differ."""

    def spelled(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            found, cuts = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
            cuts = cuts - cuts[0]
            lo, n, root = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b in runs(at):
                data, stops, first = single_spaced(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                own = slice(cuts[a], cuts[b])
                w = lo[own] + np.repeat(first[:-1], np.diff(cuts[a : b + 1]))
                same = digests(data.tobytes(), stops[w], stops[w + n[own] + length - 1])
                yield pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(same[:, 0]), pa.array(same[:, 1])], names=["root", "s", "t"])
        give_back()

    words = keyed.select("key", "text").join(spans, "key").select("text", "spans").mapInArrow(spelled, "root bigint, s bigint, t bigint")
    forms = words.groupBy("root").agg(F.min(F.struct("s", "t")).alias("least"), F.max(F.struct("s", "t")).alias("most"))
    return not forms.where("least <> most").isEmpty()


def single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words of all texts, a space after each; where each word begins, and the
    end; first word of each text)."""
    starts, ends, first = words_of(data, offsets)
    stop = np.cumsum(ends - starts + 1)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    solid = np.ones(len(out), bool)
    solid[stop - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    out[solid] = data[np.cumsum(inside[:-1]) > 0]
    return out, np.concatenate([[0], stop]), first


def substring_dedup(docs: DataFrame, window: int = 35, k: int = 12, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id``, ``n`` words, ``n_removed``, the removed
    spans (``removed_start``, ``removed_end``, in words) and ``kept``: the text
    that stays, its words joined by one space.  ``carry``: columns that come
    along in the struct ``carried``."""
    small_batches(docs.sparkSession)
    keyed = with_key(docs, id_col, text_col, carry)
    for salt in itertools.count():
        found = repeated_paths(keyed, window, k, salt)
        spans = long_spans(found[0].where(F.col("kind") != ASKS).unionByName(found[1]))
        drop(docs.sparkSession, *found)
        if not mistaken(keyed, spans, window):
            break
        drop(docs.sparkSession, spans)

    def read(found: list[dict]) -> np.ndarray:
        return np.array([(x["lo"], x["n"]) for x in found], np.int64).reshape(-1, 2)

    def keep(data: np.ndarray, found) -> tuple[int, np.ndarray, bytes]:
        words = data.tobytes().split()
        gone = covered(found, len(words), window)
        return len(words), gone, b" ".join(words if found is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])

    return apply_spans(keyed, spans, read, keep, pa.string(), "string")
