"""Operators 11 to 13: turns, repair and shards."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from hearsay.llm import repair
from hearsay.llm.shards import range_of, shard
from hearsay.llm.turns import reassemble
from pyspark.sql import functions as F

from .brute import sha


def plain_events(arrivals, batches, patience):
    """{(event, conv, turn, batch, payload or details)} of (conv, turn, role, text, batch) rows."""
    rows = defaultdict(dict)
    first = {}
    for conv, turn, role, text, batch in arrivals:
        if turn is None:
            continue
        p = ((role or "") + "|" + (text or "")).encode(), role or ""
        rows[batch][conv, turn] = min(rows[batch].get((conv, turn), p), p)
        first[conv] = min(first.get(conv, turn), turn)
    kept, gone, last, closed, out = defaultdict(dict), defaultdict(int), {}, set(), []

    def close(conv, batch):
        k = kept[conv]
        breaks = sum(t - 1 in k and k[t - 1][1] == k[t][1] for t in k)
        out.append(("close", conv, None, batch, (max(k) - first[conv] + 1 - len(k), breaks, sorted(t for t in k if t >= first[conv] + gone[conv]))))
        closed.add(conv)

    for batch in range(batches):
        for (conv, turn), p in rows[batch].items():
            if conv in closed:
                out.append(("reject", conv, turn, batch, p[0].decode()))
                continue
            last[conv] = batch
            kept[conv].setdefault(turn, p)
        for conv in kept:
            while conv not in closed and first[conv] + gone[conv] in kept[conv]:
                t = first[conv] + gone[conv]
                out.append(("release", conv, t, batch, kept[conv][t][0].decode()))
                gone[conv] += 1
        for conv, b in last.items():
            if conv not in closed and batch - b >= patience:
                close(conv, batch)
    for conv in last:
        if conv not in closed:
            close(conv, batches)
    return sorted(out, key=repr)


def test_reassembly_against_plain(spark):
    rows = [(None, 3, None, None, 0), (None, 4, "user", "x", 0), ("hot", None, "user", "no turn", 1), ("", 2**60, "user", "far", 2), ("", 2**60 + 1, "user", "farther", 4)]
    for conv, turns in (("hot", 300), ("a", 9), ("b", 2), ("c", 14)):
        for t in range(turns):
            h = int(sha(f"{conv}:{t}")[:8], 16)
            if h % 11 == 0 and t:
                continue
            rows.append((conv, t, ("user", "assistant", None)[h % 3], ("", "\U0001f600 é", "x" * (h % 50), None)[h % 4], h // 8 % 7 if conv != "b" else 6 * t))
            if h % 5 == 0:
                rows.append((conv, t, "user", "again", (h // 8 + 3) % 7))
            if h % 7 == 0:  # twice in a batch: the smaller payload in bytes arrives
                rows.append((conv, t, "uses", "again", h // 8 % 7))
    df = spark.createDataFrame([r + (1, "k") for r in rows], "conv string, turn bigint, role string, text string, batch int, event int, heap string")
    out = reassemble(df, 7, 3).collect()
    got = sorted(((r["event"], r["conv"], r["turn"], r["batch"], (r["n_missing"], r["n_breaks"], list(r["unreleased"])) if r["event"] == "close" else r["role"] + "|" + r["text"]) for r in out), key=repr)
    assert got == plain_events(rows, 7, 3)
    assert {e for e, *_ in got} == {"release", "reject", "close"}


def test_reassembly_of_nothing_and_of_a_long_text(spark):
    kind = "conv bigint, turn bigint, role string, text string, batch int"
    assert reassemble(spark.createDataFrame([], kind), 2).collect() == []
    long = "é" * 2_000_000
    out = reassemble(spark.createDataFrame([(1, 5, "user", long, 0)], kind), 2).collect()
    assert sorted((r["event"], r["turn"], r["text"] and hashlib.sha256(r["text"].encode()).hexdigest()) for r in out) == [("close", None, None), ("release", 5, sha(long))]


def plain_repair(rows):
    """(counts, cost, audit, lines) of one conversation's (turn, role, text) rows; whole strings, no ranks."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: r[:2] + (r[2].encode(), r[3].encode()))
    turn = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    seen, kinds, best = set(), [], {0: (0, "", ())}

    def grown(found):
        out = dict(found)
        for _ in range(3):
            for q, (cost, audit, lines) in list(out.items()):
                role, to = turn[q]
                way = cost + 5, audit + "I", (*lines, role + ":")
                out[to] = min(out.get(to, way), way)
        return out

    for _, _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append((role[:1], fault))
        found = {}
        for q, (cost, audit, lines) in grown(best).items():
            ways = [(q, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = cost + 5 * (fault == "truncated")
                name, to = turn[q]
                ways.append((to, (more + 1, audit + "R", (*lines, f"{name}:{text}"))))
                if role[:1] == name[0]:
                    ways.append((to, (more, audit + "K", (*lines, f"{role}:{text}"))))
                if role[:1] == "s" and q == 0:
                    ways.append((1, (more, audit + "K", (*lines, f"{role}:{text}"))))
            for to, way in ways:
                found[to] = min(found.get(to, way), way)
        best = found
    cost, audit, lines = min(x for q, x in grown(best).items() if q in (0, 3))
    turns = [t for known, t, _, _ in rows if known]
    count = [sum(f == k for _, f in kinds) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit), list(lines)


def _talks():
    rng = random.Random(12)
    texts = ["Yes.", "no", "", " \t", "Why?", "Why?", "é!", "x. \n", None, "\x0b"]
    talks = {None: [(1, "user", "Hi."), (None, None, None)], "": [], "hot": [(t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!"]) + str(t)) for t in range(700)]}
    for i in range(120):
        roles = ["user", "assistant", "system", "tool", "", None] if i % 3 else ["user", "assistant"]
        talks[f"c{i}"] = [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 12))]
    return talks


def test_repair_against_plain(spark, monkeypatch):
    talks = _talks()
    rows = [(c, *r, 1, "z") for c, rs in talks.items() for r in rs]
    df = spark.createDataFrame(rows, "conv string, turn bigint, role string, text string, pos int, fault string")
    for block in (4096, 5):
        # a block of few rows: every conversation is folded from blocks
        monkeypatch.setattr(repair, "BLOCK", block)
        report, repaired = repair.repair(df)
        lines = defaultdict(list)
        for r in sorted(repaired.collect(), key=lambda r: (r["pos"], r["sub"])):
            lines[r["conv"]].append(f"{r['role']}:{r['text']}")
        got = {r["conv"]: ((r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]), lines[r["conv"]]) for r in report.collect()}
        assert got == {c: plain_repair(rs) for c, rs in talks.items() if rs}


def test_repair_of_nothing_and_of_a_long_text(spark):
    kind = "conv bigint, turn bigint, role string, text string"
    report, repaired = repair.repair(spark.createDataFrame([], kind))
    assert report.collect() == [] and repaired.collect() == []
    report, repaired = repair.repair(spark.createDataFrame([(1, 0, "assistant", "é " * 900_000 + ".")], kind))
    assert [r["audit"] for r in report.collect()] == ["D"] and repaired.collect() == []


def test_a_shared_prefix_is_solved_once(monkeypatch):
    calls = []
    plain = repair.step
    monkeypatch.setattr(repair, "step", lambda layer, letter: calls.append(letter) or plain(layer, letter))
    trie = repair.Trie((repair.NOTHING,))
    for signature in ["a", "dg", "dgd", "dgdg", "dgdg", "dgdh"]:
        trie.solve(signature)
    assert len(calls) == 1 + 4 + 1


def _sharded(spark, rows, shards, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, size int, key int")
    out = shard(df, shards, **more).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["crc"]) for r in out) == sorted((i is not None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, filled = defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in out:
        slots[r["shard"]].append(r["slot"])
        filled[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    return out, filled


def test_shards_are_near_equal(spark):
    rng = random.Random(5)
    rows = [(i, "x" * int(rng.paretovariate(0.8) * 30 % 20_000) + str(i)) for i in range(3000)]
    _, filled = _sharded(spark, rows, 8, ranges=256)
    assert max(filled.values()) <= 1.01 * sum(filled.values()) / 8


def test_hot_groups_are_subdivided_and_others_stay_whole(spark):
    # copies, empty texts and one id hold most rows; the rest are pairs of copies
    rows = [(i, "copy of a passage") for i in range(3000)] + [(i, None if i % 2 else "") for i in range(3000, 6000)] + [(-1, "same id " + str(i)) for i in range(1500)] + [(None, "no id")] * 500
    rows += [(10_000 + i, f"text of a pair, number {i // 2} " * 9) for i in range(3000)]
    out, filled = _sharded(spark, rows, 8, ranges=512)
    assert max(filled.values()) <= 1.01 * sum(filled.values()) / 8
    n = Counter(r["shard"] for r in out if r["doc_id"] is not None and 0 <= r["doc_id"] < 3000)
    assert len(n) == 8 and max(n.values()) < 2 * min(n.values())
    where = defaultdict(set)
    for r in out:
        if (r["doc_id"] or 0) >= 10_000:
            where[(r["doc_id"] - 10_000) // 2].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) < 60  # the ranges that hot groups share


def test_shards_of_little_and_of_nothing(spark):
    kind = "doc_id bigint, text string"
    assert shard(spark.createDataFrame([], kind), 8).collect() == []
    out, filled = _sharded(spark, [(1, "é" * 3_000_000), (2, None), (3, "a"), (3, "a")], 3)
    assert sorted(filled.values()) == [2, 3, 6_000_001] or sorted(filled.values()) == [1, 4, 6_000_001]


def test_range_of_every_key(spark):
    for begins in ([], [5], [-3, 0, 4], [-9, -2, 0, 1, 7, 8, 30]):
        got = spark.createDataFrame([(k,) for k in range(-12, 35)], "key bigint").select("key", range_of(F.col("key"), begins).alias("r")).collect()
        assert all(r["r"] == sum(b <= r["key"] for b in begins) for r in got)
