"""Exact Jaccard join of documents' word shingles, and its components.

Sets are their shingles in one global order: rarer ones first (a bounded list of
the most frequent shingles goes last), then by hash.  Two sets can only reach
the threshold if they share a shingle of both prefixes, at places and with sizes
that leave room for the overlap needed.  Each inverted list is sorted by size and
position; it falls into blocks of one size, and of every block what lies behind
the position that still leaves room is skipped.

Set relations save the rest.  Equal sets are one set.  Lists of more than
``SMALL`` sets are not paired out: every set is compared with its neighbour and
with the list's center, the set that stands in most lists, as the least changed of
a group of copies does.  Then the sets that are not yet in the component
of most of their list are compared with another member of it (``ROUNDS`` times).  Only
pairs of different components are left then, and for those the answers of the
center are carried over: with overlaps |c&y| and |c&z| known, |y&z| is at least
|c&y| + |c&z| - |c| and at most min(|c&y|, |c&z|) + min(|y-c|, |z-c|), which
settles most pairs unseen; the others are verified.  A long list is probed in
slices, each by its own task.

Hashes find, they do not decide: sets are equal if their 128-bit digests are, ids
of 64 bits that two digests share are told apart (``torn_ids``), and overlaps are
counted in the texts by 128 bits of each shingle, which are put together from the
BLAKE2b digests of its words.

Defined results: null, empty and wordless texts have no shingles, link with
nothing and are their own component; a text with fewer words than a shingle is
one shingle; rows that repeat an id, or have none, count as documents of their
own; ids may be of any type that has an order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SLICES, batches_of, by_part, dealt, part_by_part, part_of, with_key
from .store import drop, materialize, partitions, small_batches, tidy
from .words import LOWER, MIX, digests, distinct, give_back, grams, pair, runs, text_bytes, words_of

#: Lists up to this length are paired out.
SMALL = 4
#: Frequent shingles that are known to all tasks: one megabyte, whatever the input.
#: The list only orders the shingles; any order gives the same result.
FREQUENT, FREQUENT_FROM = 1 << 17, 48
#: Pairs of one set that are verified with one copy of it; entries of a long list
#: that one task probes it with.
SLICE = 4096
#: Rounds in which sets outside of their list's largest component meet a member of it.
ROUNDS = 1
#: Shingles, entries and sets that a map task holds at a time.
COUNTED, HELD, SEEN = 1_500_000, 400_000, 100_000

ENTRY = np.dtype([("tok", "<u8"), ("set", "<i8"), ("n", "<u4"), ("pos", "<u4")])
COUNT = np.dtype([("tok", "<u8"), ("n", "<i8")])


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each word's BLAKE2b digest, as two columns; each distinct word is digested once."""
    place, number = distinct(data, starts, ends)
    if not len(place):
        return np.empty((0, 2), np.uint64)
    return digests(data.tobytes(), starts[place], ends[place]).view(np.uint64)[number]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct shingles of each text, in order; A-Z count as a-z.  Two columns:
    128 bits, put together from the digests of the words."""
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    both = word_digests(data, starts, ends)
    columns = []
    for h in (np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])):
        short = np.zeros(len(first) - 1, np.uint64)
        few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
        for i in few.tolist():
            x = MIX
            for w in h[first[i] : first[i + 1]]:
                x = pair(x[None] if x.ndim else np.array([x]), w[None])[0]
            short[i] = x
        columns.append((grams(h, size), short))
    out = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        x = [full[a : b - size + 1] if b - a >= size else short[i : i + 1] if b > a else full[:0] for full, short in columns]
        order = np.argsort(x[0])
        one, two = x[0][order], x[1][order]
        if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():  # two shingles with one first column
            order = np.lexsort((x[1], x[0]))
            one, two = x[0][order], x[1][order]
        fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.empty(0, bool)
        out.append(np.stack([one[fresh], two[fresh]], 1))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in both; two columns each."""
    at = np.minimum(np.searchsorted(a[:, 0], b[:, 0]), len(a) - 1)
    same = a[at, 0] == b[:, 0]
    if (a[at[same], 1] == b[same, 1]).all():
        return int(same.sum())
    return len(set(map(tuple, a.tolist())) & set(map(tuple, b.tolist())))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two numbers."""
    d = blake2b(s, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of a and b shingles that reaches the threshold."""
    total = (a.astype(np.int64) + b.astype(np.int64)) * percent
    return -(-total // (100 + percent))


def _entries(s: np.ndarray, sid: int, rank: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of one set.  ``rank``: 0, or the place among frequent shingles."""
    n = len(s)
    if rank.any():
        s = s[np.lexsort((s, rank))]
    k = n - -(-n * percent // 100) + 1
    out = np.empty(k, ENTRY)
    out["tok"], out["set"], out["n"], out["pos"] = s[:k], sid, n, np.arange(k)
    return out


PROFILE = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("set", pa.int64()), ("more", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])
INDEX = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
FOUND = pa.schema([("kind", pa.int32()), ("tok", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
PAIR, LIST = 0, 1


def _columns(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fits(n_a, n_b, pos_a, pos_b, percent: int) -> np.ndarray:
    need = needed(n_a, n_b, percent)
    room = 1 + np.minimum(n_a.astype(np.int64) - pos_a, n_b.astype(np.int64) - pos_b) - 1
    return (100 * np.minimum(n_a, n_b).astype(np.int64) >= percent * np.maximum(n_a, n_b).astype(np.int64)) & (room >= need)


def join_lists(e: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as two columns, entries of long lists); lists in order of size and position."""
    # a set that lists a shingle twice (two hashes that collide) counts once
    e = e[np.lexsort((e["pos"], e["set"], e["tok"]))]
    e = e[np.append(True, (e["tok"][1:] != e["tok"][:-1]) | (e["set"][1:] != e["set"][:-1]))] if len(e) else e
    e = e[np.lexsort((e["set"], e["pos"], e["n"], e["tok"]))]
    twin = e["tok"][1:] == e["tok"][:-1]
    e = e[np.append(False, twin) | np.append(twin, False)] if len(e) else e
    if not len(e):
        return np.empty(0, np.int64), np.empty(0, np.int64), e
    first = np.flatnonzero(np.append(True, e["tok"][1:] != e["tok"][:-1]))
    size = np.diff(np.append(first, len(e)))
    start, long = np.repeat(first, size), np.repeat(size > SMALL, size)
    at, left, right = np.arange(len(e)), [], []

    def put(i, j):
        a, b = e[i], e[j]
        ok = (a["set"] != b["set"]) & _fits(a["n"], b["n"], a["pos"], b["pos"], percent)
        left.append(np.minimum(a["set"], b["set"])[ok])
        right.append(np.maximum(a["set"], b["set"])[ok])

    for d in range(1, SMALL):
        i = at[:-d]
        i = i[(start[i] == start[i + d]) & (~long[i] if d > 1 else True)]
        put(i, i + d)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if left else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], e[long]


def _profile(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Of every document its set's digest and size (kind 0), and counts of
    shingles that come often (kind 1)."""

    def run(batches):
        held, amount = [], 0

        def counts():
            tok, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 2
            r = np.empty(int(often.sum()), COUNT)
            r["tok"], r["n"] = tok[often], n[often]
            for p, rows in by_part(r, part_of(r["tok"], parts)):
                yield 1, None, None, None, None, p, rows.tobytes()

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, sizes = [], []
            for a, b in runs(offsets):
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    ids.append(set_digest(s) if len(s) else (None, None))
                    sizes.append(len(s))
                    held.append(s[:, 0].copy())
                    amount += len(s)
                if amount > COUNTED:
                    yield from batches_of(counts(), PROFILE)
                    held, amount = [], 0
            n = len(ids)
            yield _columns(PROFILE, [0] * n, batch.column(0), [x for x, _ in ids], [y for _, y in ids], sizes, [None] * n, [None] * n)
        if held:
            yield from batches_of(counts(), PROFILE)
        held.clear()
        give_back()

    return docs.mapInArrow(run, "kind int, key bigint, set bigint, more bigint, n bigint, part int, blob binary")


def torn_ids(profile: DataFrame) -> list[int]:
    """64-bit ids that sets with different digests share.  Of n sets about n^2 / 2^65
    ids are: none of a billion, some dozen of 50 billion."""
    found = profile.where("set is not null").groupBy("set").agg(F.min("more").alias("x"), F.max("more").alias("y")).where("x <> y")
    return [r["set"] for r in found.select("set").collect()]


def _own_id(torn: list[int]) -> Column:
    if not torn:
        return F.col("set")
    return F.when(F.col("set").isin(*torn), F.xxhash64("set", "more")).otherwise(F.col("set"))


def _frequent(profile: DataFrame, spark, parts: int) -> np.ndarray:
    def total(batches):
        for (blobs,) in part_by_part(batches, [1]):
            r = np.frombuffer(b"".join(blobs), COUNT)
            tok, back = np.unique(r["tok"], return_inverse=True)
            n = np.bincount(back, r["n"]).astype(np.int64)
            often = n >= FREQUENT_FROM
            yield pa.RecordBatch.from_arrays([pa.array(tok[often].view(np.int64)), pa.array(n[often])], names=["tok", "n"])
        give_back()

    seen = dealt(profile.where("kind = 1").select("part", "blob"), parts).mapInArrow(total, "tok bigint, n bigint")
    rows = seen.orderBy(F.desc("n"), "tok").limit(FREQUENT).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def _index(docs: DataFrame, size: int, percent: int, frequent: np.ndarray, torn: list[int], parts: int) -> DataFrame:
    order = np.argsort(frequent)
    toks, places = frequent[order], len(frequent) - order  # the most frequent is the last
    apart = frozenset(torn)

    def run(batches):
        held, amount, seen = [], 0, set()

        def send():
            e = np.concatenate(held)
            return ((p, rows.tobytes()) for p, rows in by_part(e, part_of(e["tok"], parts)))

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in runs(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                flat = np.concatenate([s[:, 0] for s in sets])
                rank = np.zeros(len(flat), np.int64)
                if len(toks):
                    at = np.minimum(np.searchsorted(toks, flat), len(toks) - 1)
                    hit = toks[at] == flat
                    rank[hit] = places[at[hit]]
                cuts = np.cumsum([len(s) for s in sets])
                for s, end in zip(sets, cuts.tolist(), strict=True):
                    if not len(s):
                        continue
                    both = set_digest(s)
                    if both not in seen:
                        seen.add(both)
                        sid = both[0] if both[0] not in apart else _xxhash(both)
                        held.append(_entries(s[:, 0], sid, rank[end - len(s) : end], percent))
                        amount += len(held[-1])
                if amount > HELD:
                    yield from batches_of(send(), INDEX)
                    held, amount = [], 0
                    if len(seen) > SEEN:
                        seen = set()
        if held:
            yield from batches_of(send(), INDEX)
        held.clear()
        seen.clear()
        give_back()

    return docs.mapInArrow(run, "part int, blob binary")


def _xxhash(both: tuple[int, int]) -> int:
    """What Spark's ``xxhash64`` of two numbers gives."""
    import xxhash

    h = 42
    for x in both:
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def _candidates(index: DataFrame, percent: int, parts: int, lengths_only: bool = False) -> DataFrame:
    """Pairs of short lists and neighbours of long ones (PAIR: a, b), and the entries
    of long lists (LIST: tok, set b, n, pos).  ``lengths_only``: the long lists'
    tokens and lengths (tok, n) alone."""

    def run(batches):
        for (blobs,) in part_by_part(batches, [1]):
            e = np.frombuffer(b"".join(blobs), ENTRY)
            blobs.clear()
            if lengths_only:
                e = e[np.lexsort((e["set"], e["tok"]))]
                e = e[np.append(True, (e["tok"][1:] != e["tok"][:-1]) | (e["set"][1:] != e["set"][:-1]))]
                tok, n = np.unique(e["tok"], return_counts=True)
                tok, n = tok[n > SMALL], n[n > SMALL]
                none = np.zeros(len(tok), np.int64)
                yield _columns(FOUND, np.full(len(tok), LIST, np.int32), tok.view(np.int64), none, none, n, none)
                continue
            a, b, rest = join_lists(e, percent)
            none = np.zeros(len(a), np.int64)
            if len(a):
                yield _columns(FOUND, np.full(len(a), PAIR, np.int32), none, a, b, none, none)
            if len(rest):
                none = np.zeros(len(rest), np.int64)
                yield _columns(FOUND, np.full(len(rest), LIST, np.int32), rest["tok"].view(np.int64), none, rest["set"], rest["n"].astype(np.int64), rest["pos"].astype(np.int64))
        give_back()

    return dealt(index, parts).mapInArrow(run, "kind int, tok bigint, a bigint, b bigint, n bigint, pos bigint")


def verify(pairs: DataFrame, members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, overlap, linked) for pairs of sets.

    Who stands where is settled in narrow rows; then each set's text (of its
    smallest key) moves to the slices that need it, and the shingles are made
    there: texts are half the size of their shingles and compress.
    """
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    right = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"), F.col("b").alias("set"))
    left = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), F.col("a").alias("set"))
    speaker = members.where("set is not null").groupBy("set").agg(F.min("key").alias("key"))
    placed = left.unionByName(right).join(speaker, "set").join(texts, "key").select("a", "slice", "role", "set", "text")
    both = placed.repartition(partitions(pairs.sparkSession), "a", "slice").sortWithinPartitions("a", "slice", "role", "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("overlap", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        current, items = None, None
        for batch in batches:
            data, offsets = text_bytes(batch.column(4))
            sets = (s for x, y in runs(offsets) for s in shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], words))
            out = []
            for a, role, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets, strict=True):
                if role == 0:
                    current, items = a, s
                elif a == current:
                    both = overlap(items, s)
                    out.append((a, b, len(items), len(s), both, 100 * both >= percent * (len(items) + len(s) - both)))
            yield from batches_of(iter(out), schema)
        give_back()

    return both.mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, overlap bigint, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): large-star and small-star rounds until the
    links are stars around each component's smallest node."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.join(least, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "links")


def _may_link(a: str, b: str, percent: int) -> Column:
    """The size and position filters on columns (n, pos) of two entries."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    need = F.ceil((na + nb) * percent / F.lit(100 + percent))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa_, nb - pb) >= need)


def _star(named: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of entries with their list's center."""
    found = named.where((F.col("lead") != F.col("b")) & _may_link("lead_", "", percent))
    return found.select(F.least("lead", "b").alias("a"), F.greatest("lead", "b").alias("b")).distinct()


def _centered(lists: DataFrame) -> DataFrame:
    """Entries of long lists with their list's center: the set in most lists."""
    spread = lists.groupBy("b").agg(F.count(F.lit(1)).alias("held"))
    center = lists.join(spread, "b").groupBy("tok").agg(F.max(F.struct("held", "b", "n", "pos")).alias("c")).select("tok", F.col("c.b").alias("lead"), F.col("c.n").alias("lead_n"), F.col("c.pos").alias("lead_pos"))
    return lists.select("tok", "b", "n", "pos").join(center, "tok")


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the lists that hold several components, with their component."""
    named = lists.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    several = named.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tok")
    return named.join(several, "tok")


def _outsiders(lists: DataFrame, roots: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of sets outside of their list's largest component with a member of it,
    another one in every turn."""
    named = _rooted(lists, roots).select("tok", "b", "n", "pos", "root")
    groups = named.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos"))).alias("c"))
    main = groups.groupBy("tok").agg(F.max(F.struct("size", "root", "c")).alias("m")).select("tok", F.col("m.root").alias("main"), "m.c.lead", "m.c.lead_n", "m.c.lead_pos")
    return _star(named.join(main, "tok").where("root <> main"), percent)


def _across(lists: DataFrame, roots: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists whose sets still lie in different components:
    (a, b, sure) where sure says that the bounds already link them."""
    named = _rooted(lists, roots)
    by_lead = checked.select(F.col("a").alias("lead"), F.col("b").alias("other"), "overlap", "n_a")
    by_lead = by_lead.unionByName(checked.select(F.col("b").alias("lead"), F.col("a").alias("other"), "overlap", F.col("n_b").alias("n_a")))
    named = named.join(by_lead.withColumnRenamed("other", "b"), ["lead", "b"], "left")
    rows = named.select("tok", "b", "n", "pos", "root", "lead", F.coalesce("overlap", F.lit(-1)).cast("bigint").alias("o"), F.coalesce("n_a", F.lit(0)).cast("bigint").alias("nc"))
    # a long list goes to several tasks, each probes it with a slice of its entries
    slices = rows.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    rows = rows.join(slices, "tok").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("tok", "slice", "slices", "b", "n", "pos", "root", "lead", "o", "nc").repartition(partitions(lists.sparkSession), "tok", "slice").sortWithinPartitions("tok", "slice", "n", "pos", "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def one_list(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slice_, slices, b, n, pos, root, lead, o, nc = x
        o = np.where(b == lead, n, o)
        nc = np.full(len(b), max(int(nc.max()), int(n[b == lead].max(initial=0))))
        # blocks of one size, each in order of position
        begins = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        wide = np.int64(max(int(pos.max()), 0) + 2)
        place = n * wide + pos
        left, right, certain = [], [], []
        for i in range(int(slice_[0]), len(b) - 1, int(slices[0])):
            # sizes ascend: the blocks from ``stop`` on are too large
            stop = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            blocks = begins[(begins < stop) & (n[begins] >= n[i])]
            size = n[blocks]
            need = needed(np.full(len(size), n[i]), size, percent)
            # behind the last position that leaves room the rest of a block is skipped
            last = np.where(n[i] - pos[i] >= need, np.clip(size - need, -1, wide - 1), -1)
            ends = np.searchsorted(place, size * wide + last, "right")
            starts = np.maximum(blocks, i + 1)
            count = np.maximum(ends - starts, 0)
            if not count.any():
                continue
            j = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
            need = np.repeat(need, count)
            most = np.minimum(o[i], o[j]) + np.minimum(n[i] - o[i], n[j] - o[j])
            known = (o[j] >= 0) & (o[i] >= 0)
            fine = (root[j] != root[i]) & (~known | (most >= need))
            j, need, known = j[fine], need[fine], known[fine]
            if len(j):
                left.append(np.minimum(b[i], b[j]))
                right.append(np.maximum(b[i], b[j]))
                certain.append(known & (o[i] + o[j] - nc[j] >= need))
            if sum(map(len, left)) > 100_000:
                yield _columns(schema, *map(np.concatenate, (left, right, certain)))
                left, right, certain = [], [], []
        if left:
            yield _columns(schema, *map(np.concatenate, (left, right, certain)))

    def run(batches):
        now, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(10)]
            t, s = columns[0], columns[1]
            cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]))) if len(t) else np.empty(0, int)
            for a, z in zip(cuts.tolist(), np.append(cuts[1:], len(t)).tolist(), strict=True):
                if (t[a], s[a]) != now:
                    if held:
                        yield from one_list([np.concatenate(c) for c in zip(*held, strict=True)])
                    now, held = (t[a], s[a]), []
                held.append([c[a:z] for c in columns[1:]])
        if held:
            yield from one_list([np.concatenate(c) for c in zip(*held, strict=True)])
        give_back()

    return rows.mapInArrow(run, "a bigint, b bigint, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` (the
    smallest id of its component) and ``key`` (unique, in the order of ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = SLICES * partitions(spark)
    keyed = with_key(docs, id_col, text_col)
    texts = keyed.select("key", "text")
    profile = materialize(_profile(texts, words, parts), "jaccard-sets")
    sets = profile.where("kind = 0")
    torn = torn_ids(sets)
    members = sets.select("key", _own_id(torn).alias("set"), "n")
    frequent = _frequent(profile, spark, parts)
    # a first index finds the shingles whose lists are long; they go behind the
    # rest of the order, and the second index has short lists
    met = materialize(_candidates(_index(texts, words, percent, frequent, torn, parts), percent, parts, lengths_only=True).select("tok", "n"), "jaccard-lists")
    long = met.orderBy(F.desc("n"), "tok").limit(FREQUENT).collect()
    known = dict.fromkeys(frequent.view(np.int64).tolist())
    # those of the sample stay the most frequent, the new ones follow by length
    more = [r["tok"] for r in long if r["tok"] not in known]
    frequent = np.array([*known, *more][:FREQUENT], np.int64).view(np.uint64)
    tidy(spark)
    found = materialize(_candidates(_index(texts, words, percent, frequent, torn, parts), percent, parts), "jaccard-candidates")
    tidy(spark)
    written = [profile, met, found]

    def checked_pairs(some: DataFrame, done: DataFrame | None = None) -> DataFrame:
        if done is not None:
            some = some.join(done.select("a", "b"), ["a", "b"], "left_anti")
        written.append(materialize(verify(some, members, texts, words, percent), "jaccard-checked"))
        return written[-1]

    def stars(roots: DataFrame) -> DataFrame:
        """Links that stand for components found before."""
        return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))

    lists = materialize(_centered(found.where(F.col("kind") == LIST).select("tok", "b", "n", "pos")), "jaccard-centers")
    written.append(lists)
    checked = checked_pairs(found.where(F.col("kind") == PAIR).select("a", "b").unionByName(_star(lists, percent)).distinct())
    links = checked.where("linked").select("a", "b")
    roots = components(links)
    for turn in range(ROUNDS):
        more = checked_pairs(_outsiders(lists, roots, turn, percent), checked)
        new = more.where("linked").select("a", "b")
        checked = checked.unionByName(more)
        if new.isEmpty():
            break
        links = stars(roots).unionByName(new)
        roots = components(links)
    left = materialize(_across(lists, roots, checked, percent).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-across")
    written.append(left)
    if not left.isEmpty():
        more = checked_pairs(left.where(~F.col("sure")).select("a", "b")).where("linked").select("a", "b")
        roots = components(stars(roots).unionByName(left.where("sure").select("a", "b")).unionByName(more))
    rooted = members.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    owner = materialize(rooted.join(least, "root", "left").select("key", "n", F.coalesce("least", "key").alias("least")), "jaccard-owners")
    drop(spark, *written)
    if keyed.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte") and keyed.select(F.max(F.col("key") != F.col("id"))).first()[0] is False:
        return owner.select(F.col("key").alias("id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "key")
    names = keyed.select("key", "id")
    return owner.join(names, "key").join(names.select(F.col("key").alias("least"), F.col("id").alias("component_id")), "least").select("id", F.col("n").alias("n_shingles"), "component_id", "key")
