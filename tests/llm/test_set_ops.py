import random
import re

import numpy as np
import pytest
from hearsay.llm import chat, debruijn, exact, jaccard, licenses, oracles, queries, spans, suffixes
from hearsay.llm.words import Rolling, mix
from pyspark.sql import functions as F

from . import brute
from ..twins import same


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, key string, n int").repartition(3)


def corpus(seed=1, n=70, vocabulary=300):
    """Copies, edited copies, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    base = [[word() for _ in range(rng.randint(60, 160))] for _ in range(8)]
    passage = [word() for _ in range(60)]
    out = [(1000, None), (1001, ""), (1002, "one"), (1003, "one"), (1004, "ONE"), (1005, " \n "), (1006, "a b c d"), (1007, "A b c d")]
    for i in range(n):
        w = list(rng.choice(base)) if i % 3 else [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            w[rng.randrange(len(w))] = word()
        if i % 5 == 0:
            w[10:10] = passage[: rng.randint(20, 60)]
        out.append((i * 3, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = corpus(seed)
    rows.append((5000, " ".join(["loop"] * 90)))  # one word again and again
    got = {r["id"]: r for r in debruijn.substring_dedup(docs(spark, rows)).collect()}
    for (i, _), (kept, gone) in zip(rows, brute.substrings(rows, 35), strict=True):
        assert (got[i]["n_removed"], got[i]["kept"].encode()) == (gone, kept), i


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed):
    rows = corpus(seed) + [(5000, "ab" * 300), (5001, "é" * 200)]
    want = brute.suffixes(rows, 100)
    for r in suffixes.suffix_dedup(docs(spark, rows)).collect():
        assert (bytes(r["kept"]), r["n_removed"], len(r["removed_start"])) == want[r["id"]], r["id"]


def test_texts_move_as_compressed_blocks(spark):
    """No join of single rows carries texts; what a block moves is less than half of its
    texts, and spans that touch are one note of few bytes."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 900}" for j in range(400))) for i in range(200)]
    out = suffixes.suffix_dedup(docs(spark, rows))
    assert " Join " not in out._jdf.queryExecution().optimizedPlan().toString()
    keyed = spans.with_key(docs(spark, rows), "doc_id", "text")
    blocks = spans._blocks(keyed.select("key", "text"), 8).agg(F.count("*").alias("n"), F.sum(F.length("blob")).alias("size")).first()
    assert blocks["n"] <= 3 * 8 and blocks["size"] < sum(len(t) for _, t in rows) / 2
    told = np.zeros(5000, spans.SPAN)
    told["doc"], told["lo"], told["n"] = np.arange(5000) // 50, np.arange(5000) % 50 * 7, 7
    notes = dict(spans.notes_of(told[np.random.default_rng(4).permutation(5000)], 8))
    back = spans.unpacked(list(notes.values()), spans.SPAN)
    assert sorted(back.tolist()) == [(d, 0, 350) for d in range(100)] and sum(map(len, notes.values())) < 100 * 8


@pytest.mark.parametrize("hot", [0, 256])
def test_hot_contexts(spark, monkeypatch, hot):
    """One passage between many different texts; opened by window and by run."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(45)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(9))] + passage[rng.choice((0, 0, 3)) :] + [word() for _ in range(rng.randrange(9))])) for i in range(60)]
    got = {r["id"]: (r["kept"].encode(), r["n_removed"]) for r in debruijn.substring_dedup(docs(spark, rows)).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.substrings(rows, 35), strict=True)}
    want = brute.suffixes(rows, 100)
    assert {r["id"]: (bytes(r["kept"]), r["n_removed"], len(r["removed_start"])) for r in suffixes.suffix_dedup(docs(spark, rows)).collect()} == want


def test_suffix_sorter():
    rng = np.random.default_rng(0)
    symbols = mix(rng.integers(1, 3, 600).astype(np.uint64))
    starts, segments = rng.permutation(500)[:300], rng.integers(0, 5, 300).astype(np.uint64)
    s = suffixes.SuffixSorter(symbols, starts, segments, 40)
    order = s.order()
    keys = [(int(segments[i]), symbols[starts[i] : starts[i] + 40].tolist()) for i in order]
    assert keys == sorted(keys)
    a, b = starts[:50], starts[50:100]
    want = [next((k for k in range(40) if symbols[x + k] != symbols[y + k]), 40) for x, y in zip(a, b, strict=True)]
    assert s.common(a, b).tolist() == want


def test_runs_are_the_same_wherever_they_stand():
    rng = np.random.default_rng(2)
    shared = mix(rng.integers(1, 1 << 60, 200).astype(np.uint64))
    seen = []
    for lead in (0, 7, 50):
        x = np.concatenate([mix(rng.integers(1, 1 << 60, lead).astype(np.uint64)), shared])
        own, lo, n, at, h = spans.minimizer_runs(x, np.array([0, len(x)]), 35, 12)
        assert int(n.sum()) == len(x) - 34
        seen.append({(x[a : a + c + 34].tobytes(), p, k) for a, c, p, k in zip(lo.tolist(), n.tolist(), at.tolist(), h.tolist())})
    assert len(seen[0] & seen[1] & seen[2]) > 8


def thue_morse(a, b, n):
    """A word over a and b and its complement: every polynomial hash modulo a power of two takes them for equal."""
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return "".join((a, b)[x] for x in w), "".join((b, a)[x] for x in w)


def test_words_that_linear_hashes_confuse(spark):
    a, b = thue_morse("a", "b", 2048)
    lead = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}")]
    assert [r["n_removed"] for r in debruijn.substring_dedup(docs(spark, rows)).collect()] == [0, 0]
    got = {r["id"]: (bytes(r["kept"]), r["n_removed"], len(r["removed_start"])) for r in suffixes.suffix_dedup(docs(spark, rows)).collect()}
    assert got == brute.suffixes(rows, 100)
    rows = [(1, f"p q r s {a}"), (2, f"p q r s {b}")]
    assert {r["id"]: r["component_id"] for r in jaccard.jaccard_components(docs(spark, rows)).collect()} == {1: 1, 2: 2}


def test_colliding_hashes_are_noticed(monkeypatch):
    """With a hash that says that all suffixes are equal the bytes still decide."""
    rng = np.random.default_rng(3)
    symbols, starts = rng.integers(0, 2, 400).astype(np.uint8), np.arange(300)

    class Alike(suffixes.Rolling):
        def of(self, a, b):
            return np.zeros(len(a), np.uint64)

    monkeypatch.setattr(suffixes, "Rolling", Alike)
    group = suffixes.SuffixSorter(symbols, starts, np.zeros(300, np.uint64), 8).groups()
    words = [symbols[i : i + 8].tobytes() for i in starts]
    assert len(set(group.tolist())) == len(set(words)) == len(set(zip(group.tolist(), words, strict=True)))


def test_compacted_paths(spark):
    """A chain, a branch, a ring, a node where one document leaves, a path seen once."""
    rows = [(i, 100 + i, 101 + i, 2, 3) for i in range(1, 20)] + [(50, 120, 500, 1, 2), (51, 120, 501, 1, 2), (60, 700, 701, 1, 2), (61, 701, 700, 1, 2)]
    rows += [(70, 800, 801, 4, 2), (71, 801, 802, 4, 2), (72, 802, 803, 4, 1)]
    paths = spark.createDataFrame(rows, "path bigint, a bigint, b bigint, n bigint, seen bigint")
    pairs = [(i, i + 1, 3) for i in range(1, 19)] + [(19, 50, 2), (19, 51, 1), (60, 61, 2), (61, 60, 2), (70, 71, 1), (71, 72, 1)]
    followed = spark.createDataFrame(pairs, "path bigint, next bigint, both bigint")
    got = {r["path"]: (r["root"], r["ahead"], r["seen"]) for r in debruijn.compacted(paths, followed)[0].collect()}
    assert got == {i: (1, 2 * (i - 1), 3) for i in range(1, 20)} | {i: (i, 0, 2) for i in (50, 51, 60, 61, 70, 71)}


def test_compaction_decides(spark, monkeypatch):
    """A passage of 400 words in three documents is one span of each on one compacted
    path; a fourth document that leaves halfway makes it two; without compacted
    paths nothing is removed."""
    passage = [f"p{i}" for i in range(400)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(40)] + passage + [f"z{i}_{j}" for j in range(40)])) for i in range(3)]

    def spans_of(rows):
        keyed = spans.with_key(docs(spark, rows), "doc_id", "text")
        found = debruijn.repeated_paths(keyed, 35, 12)
        out = debruijn.long_spans(found[0].where("kind <> 1").unionByName(found[1]))
        assert not debruijn.mistaken(keyed, out, 35)
        return {r["key"]: {(x["lo"], x["n"], x["root"]) for x in r["spans"]} for r in out.collect()}

    def longest(found):
        return {k: max(n for _, n, _ in v) for k, v in found.items()}

    whole = spans_of(rows)
    # the opened edges at both ends of the passage may stay on their own
    assert min(longest(whole).values()) > 300 and len(set.intersection(*({r for _, _, r in v} for v in whole.values()))) >= 1
    cut = spans_of([*rows, (3, " ".join([f"a3_{j}" for j in range(40)] + passage[:200] + [f"z3_{j}" for j in range(40)]))])
    assert max(longest(cut).values()) < 250
    assert {r["n_removed"] for r in debruijn.substring_dedup(docs(spark, rows)).collect()} == {400}
    compacted = debruijn.compacted
    monkeypatch.setattr(debruijn, "compacted", lambda *a: (compacted(*a)[0].limit(0), []))
    assert {r["n_removed"] for r in debruijn.substring_dedup(docs(spark, rows)).collect()} == {0}


def test_heavy_and_rare_paths(spark, monkeypatch):
    """A passage in 200 documents, which is broadcast, and passages in two, which are not."""
    monkeypatch.setattr(debruijn, "HEAVY", 20)
    hot = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(20)] + hot + [f"r{i // 2}_{j}" for j in range(50)])) for i in range(200)]
    got = {r["id"]: (r["kept"].encode(), r["n_removed"]) for r in debruijn.substring_dedup(docs(spark, rows)).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.substrings(rows, 35), strict=True)}


def test_words_with_one_hash_are_verified(spark):
    """Two words share their hash: the digests at the coordinates differ, and all is done again."""
    x, y = "7}k\x7f!{a", '"\x01!\x00h\x01*b'
    lead, tail = [f"w{i}" for i in range(50)], [f"t{i}" for i in range(50)]
    rows = [(1, " ".join([*lead[:34], x])), (2, " ".join([*lead[:34], y])), (3, " ".join([*lead[20:], x, *tail])), (4, " ".join([*lead[20:], y, *tail])), (5, " ".join([*lead[30:], y, *tail[:20]]))]
    keyed = spans.with_key(docs(spark, rows), "doc_id", "text")
    found = debruijn.repeated_paths(keyed, 35, 12)
    assert debruijn.mistaken(keyed, debruijn.long_spans(found[0].where("kind <> 1").unionByName(found[1])), 35)
    got = {r["id"]: (r["kept"].encode(), r["n_removed"]) for r in debruijn.substring_dedup(docs(spark, rows)).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute.substrings(rows, 35), strict=True)}


def test_long_text_of_repeats(spark):
    """A text of 60,000 words that holds passages of itself, periods and copies of others' ends."""
    rng = random.Random(12)
    w = [f"v{rng.randrange(5000)}" for _ in range(20_000)]
    long = w + ["loop"] * 300 + ["x", "y", "z"] * 50 + w[5_000:25_000] + [f"u{i}" for i in range(1_000)] + w[:15_000]
    rows = [(1, " ".join(long)), (2, " ".join(w[19_950:])), (3, " ".join(w[100:133])), (4, " \t\n ".join(w[100:180]))]
    got = {r["id"]: (r["kept"].encode(), r["n_removed"]) for r in debruijn.substring_dedup(docs(spark, rows)).collect()}
    assert got == {i: v for (i, _), v in zip(rows, brute.substrings(rows, 35), strict=True)}


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs(spark, [(None, text), (1, text), (1, text), (2, "short"), (None, None)])
    got = debruijn.substring_dedup(rows).collect()
    assert sorted((r["n"], r["n_removed"]) for r in got) == [(0, 0), (1, 0), (60, 60), (60, 60), (60, 60)]
    got = suffixes.suffix_dedup(rows).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 0, len(text), len(text)]
    assert jaccard.jaccard_components(rows).count() == 5
    assert exact.exact_dedup(rows).count() == 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed):
    rows = corpus(seed)
    want = brute.components(rows)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == want


def test_jaccard_long_lists(spark):
    """A chain of many near copies, and unrelated texts around one common passage."""
    rng = random.Random(4)
    w = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(w)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(100 + i, common + " " + " ".join(f"u{i}_{k}" for k in range(rng.choice((1, 2, 25, 60))))) for i in range(40)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute.components(rows)


def _weak_digest(s):
    return len(s) % 3, int(s.sum() >> np.uint64(1))


def test_sets_whose_ids_collide(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "set_digest", _weak_digest)
    rows = corpus(6, 40)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute.components(rows)


def test_ids_that_are_strings(spark):
    rows = [(f"doc-{i:05}", t) for i, t in corpus(1, 20)]
    src = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id string, text string, spans string")
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(src).collect()} == brute.components(rows)
    want = brute.suffixes(rows, 100)
    assert {r["id"]: (bytes(r["kept"]), r["n_removed"], len(r["removed_start"])) for r in suffixes.suffix_dedup(src).collect()} == want
    assert {r["id"]: r["n_removed"] for r in debruijn.substring_dedup(src).collect()} == {i: n for (i, _), (_, n) in zip(rows, brute.substrings(rows, 35), strict=True)}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in jaccard.components(links).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {45: 40, 50: 40}


@pytest.mark.parametrize("digest", ["sha", "weak"])
def test_exact(spark, digest):
    rows = corpus(5) + [(7000 + i, "Same TEXT é") for i in range(3)] + [(7100, "same text É"), (7101, "sAME text é")]
    f = exact.sha256 if digest == "sha" else lambda c: F.substring(F.sha2(c, 256), 1, 1)  # many collisions
    want = brute.exact(rows)
    got = exact.exact_dedup(docs(spark, rows), digest=f).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_state_goes_on(spark, tmp_path):
    """A second arrival meets what the state kept of the first."""
    path, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    part = lambda *r: spark.createDataFrame(list(r), "id bigint, digest string, locator string").write.mode("append").parquet(path)
    part((1, "x", "f1"), (2, "y", "f1"))
    assert {r["digest"]: r["group_size"] for r in exact.keyed_state(spark.read.parquet(path), state).collect()} == {"x": 1, "y": 1}
    part((5, "x", "f2"))
    got = {r["digest"]: (r["keep_id"], r["group_size"], r["locator"]) for r in exact.keyed_state(spark.read.parquet(path), state).collect()}
    assert got == {"x": (5, 2, "f2"), "y": (2, 1, "f1")}


def test_licenses(spark):
    rows = [(1, None), (2, ""), (3, "The MIT License, the mit-license! MIT  LICENSES"), (4, "x\nLicensed under CC BY-NC 4.0.\ny"), (5, "this is free and unencumbered software released into the domain"), (6, "cc by cc by"), (7, "the of and to " * 50)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert [got[i]["n_base"] for i in range(1, 8)] == [0, 0, 2, 1, 0, 2, 0]
    assert (got[3]["first_word"], got[3]["last_word"], got[3]["n_words"]) == (1, 4, 8)
    assert got[4]["labels"] == ["cc-by", "cc-by-nc"] and got[4]["base_labels"] == ["cc-by"] and got[5]["labels"] == ["unlicense"]
    assert 0.8 <= got[5]["score"] < 1 and got[3]["score"] == 1 and got[7]["score"] == 0 and got[1]["first_word"] is None
    assert (got[6]["first_word"], got[6]["last_word"]) == (0, 2)


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
    bsd = "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted */"
    mpl = "Subject to the terms of the Mozilla Public\nLicense"
    narrow = mit.replace(" ", "\n")
    tokens = next(t for _, t in licenses.TEMPLATES if t.startswith("permission is hereby")).split()
    scattered = " ".join(f"{w} x{i} y z" for i, w in enumerate(tokens))
    rows = [(1, mit), (2, bsd), (3, mpl), (4, narrow), (5, scattered), (6, scattered + " " + mit.replace("\n", " ")), (7, "hereby " * 40 + mit)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: (["mit"], 1), 2: (["bsd"], 1), 3: (["mpl"], 1), 4: (["mit"], 1), 5: ([], 0), 6: (["mit"], 1), 7: (["mit"], 1)}


def test_licenses_against_plain(spark):
    """Every window of every text against every template."""
    rng = random.Random(12)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "mit license"), (4, "filler words " * 20000 + licenses.TEMPLATES[2][1])]
    for i in range(60):
        notice = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            notice[rng.randrange(len(notice))] = rng.choice([*words, "odd"])
        for _ in range(rng.choice((0, 0, 1, 3))):
            notice.insert(rng.randrange(len(notice)), rng.choice(words))
        around = [rng.choice([*words, "x", "y"]) for _ in range(rng.randrange(30))]
        at = rng.randrange(len(around) + 1)
        rows.append((100 + i, rng.choice((" ", "\n", ", ")).join(around[:at] + notice + around[at:])))

    def plain(text):
        ws = [w for w in re.split(licenses.SEPARATORS, (text or "").lower()) if w]
        base = {label for phrase, label in licenses.PHRASES for i in range(len(ws)) if " ".join(ws[i : i + len(phrase.split())]) == phrase}
        found = {}
        for label, t in licenses.TEMPLATES:
            tokens, size = set(t.split()), licenses.reach(len(t.split()))
            if len(tokens & set(ws)) >= licenses.needed(len(tokens), licenses.THRESHOLD):
                best = max(len(tokens & set(ws[i : i + size])) for i in range(len(ws)))
                if best >= licenses.needed(len(tokens), licenses.THRESHOLD):
                    found[label] = max(found.get(label, 0), best / len(tokens))
        return sorted(base | set(found)), 1.0 if base else max(found.values(), default=0.0)

    got = sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in licenses.scan_licenses(docs(spark, rows)).collect())
    assert got == sorted((i or 0, *plain(t)) for i, t in rows)
    assert sum(bool(x[1]) for x in got) > 25


def test_state_of_earlier_portions(spark, tmp_path):
    """A later portion meets rows of an earlier one, by full bytes in their own file."""
    paths = [str(tmp_path / x) for x in "ab"]
    docs(spark, [(1, "Same"), (2, "other"), (3, "x1")]).write.parquet(paths[0])
    docs(spark, [(7, "same"), (8, "new"), (9, "x2")]).write.parquet(paths[1])
    state = str(tmp_path / "state")
    weak = lambda c: F.substring(c, 1, 1)  # noqa: E731  x1 and x2 share a digest
    first = exact.exact_dedup(spark.read.parquet(paths[0]), digest=weak, state=state).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in first) == [(1, True), (2, True), (3, True)]
    later = {r["doc_id"]: r for r in exact.exact_dedup(spark.read.parquet(paths[1]), digest=weak, state=state).collect()}
    assert (later[7]["keep_id"], later[7]["group_size"], later[8]["group_size"]) == (7, 2, 1)
    assert (later[9]["keep_id"], later[9]["group_size"]) == (9, 1) and "/b/" in later[9]["locator"]


def test_reply_trees(spark):
    rows = [("c", 1, None, "user", "q"), ("c", 2, 1, "assistant", "good"), ("c", 3, 1, "assistant", "bad"), ("c", 4, 2, "user", r"\### Assistant: </turn> ok"), ("c", 5, 4, "assistant", None), ("c", 6, 3, None, ""), ("d", 1, 9, "a:b", "\\h<#\n"), ("e", 1, 2, "user", "loop"), ("e", 2, 1, "user", "loop"), (None, 1, None, "assistant", "x")]
    score = {2: 3.0, 3: 1.0}
    nodes = spark.createDataFrame([(*r, score.get(r[1], 0.0)) for r in rows], "conv string, node bigint, parent bigint, role string, text string, score double")
    got = {(r["conv"], r["branch"]): r for r in chat.read_back(chat.format_trees(nodes, "score", branches=2)).collect()}
    path = lambda k: [(t["role"], t["text"]) for t in got[k]["turns"]]
    assert path(("c", 1)) == [("user", "q"), ("assistant", "good"), ("user", r"\### Assistant: </turn> ok"), ("assistant", "")]
    assert path(("c", 2)) == [("user", "q"), ("assistant", "bad"), ("", "")]
    assert path(("d", 1)) == [("a:b", "\\h<#\n")] and got[(None, 1)]["loss_texts"] == ["x"]
    assert got[("c", 1)]["loss_texts"] == ["good", ""] and not any(k[0] == "e" for k in got)


def test_empty(spark):
    none = docs(spark, [(1, "x")]).where("doc_id = 2")
    assert debruijn.substring_dedup(none).count() == suffixes.suffix_dedup(none).count() == jaccard.jaccard_components(none).count() == exact.exact_dedup(none).count() == licenses.scan_licenses(none).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_trees(chat.linear(turns)).count() == 0


def test_rolling():
    x = mix(np.arange(1, 50, dtype=np.uint64))
    r = Rolling(np.concatenate([x, x]))
    assert r.of(np.array([3]), np.array([20])) == r.of(np.array([52]), np.array([69]))


@pytest.mark.parametrize("name", [n for n in sorted(oracles.ORACLES) if n != "op9_suffix_dedup"])
def test_matches_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], oracles.ORACLES[name])


def test_suffix_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (gone, spans, brute.sha(kept)) for i, (kept, gone, spans) in brute.suffixes(rows, 100).items()}
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op9_suffix_dedup(spark, data).collect()} == want


def test_words_with_one_plain_hash(spark):
    """Two words of eight bytes on which ``word_hashes`` agrees are still two words."""
    import numpy as np
    from hearsay.llm.words import word_hashes

    x, y = "7}k\x7f!{a", '"\x01!\x00h\x01*b'
    data = np.frombuffer((x + y).encode(), np.uint8)
    h = word_hashes(data, np.array([0, len(x)]), np.array([len(x), len(x) + len(y)]))
    assert h[0] == h[1]
    # one word of five differs: nothing links them, and a text that has both has two shingles more
    rows = [(1, f"p q r s {x}"), (2, f"p q r s {y}"), (3, f"p q r s {x} p q r s {y}")]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.components(rows) == {1: (1, 1), 2: (1, 2), 3: (6, 3)}


def test_jaccard_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 977} v{i % 7919}" for i in range(60_000))
    rows = [(1, long), (2, long.upper() + " more"), (3, "x" * 300_000), (4, "short text of five words")]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.components(rows)
