import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hearsay.llm import bpe, packing, pieces, queries, rules, transducer
from pyspark.sql import functions as F

from . import brute

LONG = "langes Wort " * 4000
TEXTS = [None, "", " ", "a", "Hello  world", "don't we'll 're'ready ''s\n\n x", "ñandú é 漢字 🙂", "<|endoftext|> x<|endoftext|>", "\tA\x1cB\x85C\u3000D", "▁▁a ▁b", "x" * 3000, LONG, "Hello  world", "a\x00b", "İΣσς"]


def docs(spark, texts, more=False):
    rows = [(i, t) + (("x", 1) if more else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + (", ids string, kept int" if more else ""))


def fuzz(n=300, seed=5):
    rng = random.Random(seed)
    letters = "ab'strevmld  \n\t.,!1 2é ñ漢½\u2003<|endoftext|>▁🙂Σ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    texts = TEXTS + fuzz()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in transducer.count_tokens(docs(spark, texts, True), P.path("byte_bpe_50k.json")).collect()}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert got == {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}


def test_counts_of_words_that_linear_hashes_confuse():
    from tokenizers import Tokenizer

    from hearsay.llm.words import text_bytes

    from .test_set_ops import thue_morse

    texts = [x for pair in ("th", "in") for x in thue_morse(*pair, 2048)[::-1]]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = transducer.TokenCounter(P.path("byte_bpe_50k.json"))
    assert counter.count(*text_bytes(pa.array(texts))).tolist() == [len(lib.encode(t).ids) for t in texts]


def test_word_machine_starts_over(monkeypatch):
    monkeypatch.setattr(transducer, "TRANSITIONS_KEPT", 50)
    machine = transducer.TokenCounter(P.path("byte_bpe_50k.json")).machine
    words = [w.encode() for t in fuzz(50) for w in t.split()] + [b" international", b"tokenization" * 30]
    assert [machine.count(w) for w in words] == [machine.count(w) for w in words]
    assert [len(machine.steps) <= 500 for _ in (1,)] == [True]


def no_spaces(n, size, seed=8):
    rng = random.Random(seed)
    return ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(size)) for _ in range(n)]


def test_caches_are_bounded_by_bytes():
    """Distinct texts without spaces, which never come again: what is held stays near the limit."""
    import sentencepiece
    from tokenizers import Tokenizer

    from hearsay.llm.units import groups
    from hearsay.llm.words import text_bytes

    texts = no_spaces(1200, 400)
    encoder = pieces.PieceEncoder(P.path("piece_bpe_32k.model"))
    encoder.cache.limit = 300_000
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for a in range(0, len(texts), 100):
        got = encoder.encode(texts[a : a + 100])
        assert got[7].tolist() == lib.encode(texts[a + 7], add_bos=True, add_eos=True)
        assert encoder.cache.held < 1_500_000 and len(encoder.cache.ids) < 1_000_000
    counter, lib = transducer.TokenCounter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packer = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    packer.odd.limit = packer.words.limit = 300_000
    transducer_kept, transducer.WORDS_KEPT = transducer.WORDS_KEPT, 300_000
    try:
        for a, b in groups(texts, 40_000):
            data, offsets = text_bytes(pa.array(texts[a:b]))
            assert counter.count(data, offsets).tolist() == [len(lib.encode(t).ids) for t in texts[a:b]]
            assert counter.held < 600_000
            packer.encode_bytes(data, offsets)
            assert packer.odd.held + packer.words.held < 1_500_000
    finally:
        transducer.WORDS_KEPT = transducer_kept


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_vocabulary_is_small_and_blocks_agree(monkeypatch, name):
    """Two workers of an executor hold a vocabulary each, beside all that its JVM took before."""
    from tokenizers import Tokenizer

    v = bpe.from_json(P.path(name))
    assert sum(a.nbytes for a in vars(v).values() if isinstance(a, np.ndarray)) < 20_000_000
    lib, word = Tokenizer.from_file(P.path(name)), v.width > 256
    rng = random.Random(6)
    words = ["", "a", "internationalization" * 40, *("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 30))) for _ in range(400)), ""]
    flat = [[*w.encode()[:-1], w.encode()[-1] + 256 * word] if w else [] for w in words]
    symbols, ends = np.array([s for w in flat for s in w], np.int32), np.cumsum([0, *map(len, flat)])
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    for cells in (bpe.CELLS, 7):
        monkeypatch.setattr(bpe, "CELLS", cells)
        ids, n = v.encode_many(symbols, ends)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [x.tolist() for x in v.encode_many(symbols[:0], ends[:1])] == [[], []]


def test_one_very_long_word(monkeypatch):
    """The transitions are counted inside of a word too."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    monkeypatch.setattr(transducer, "BLOCK", 100)
    monkeypatch.setattr(transducer, "TRANSITIONS_KEPT", 500)
    machine = transducer.TokenCounter(P.path("byte_bpe_50k.json")).machine
    assert machine.count(word.encode()) == len(lib.encode(word).ids)
    assert len(machine.steps) <= 700


def test_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)], "doc_id bigint, text string")
    assert sorted(r["n_tokens"] for r in transducer.count_tokens(rows, P.path("byte_bpe_50k.json")).collect()) == [0, 3, 3, 3]
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in packing.pack(rows, P.path("word_bpe_49k.json")).collect()) == [(0, 1), (0, 4), (1, 4), (1, 4)]
    assert pieces.encode_decode(rows, P.path("piece_bpe_32k.model")).count() == rules.apply_rules(rows).count() == 4


def test_prefix_scan():
    s = transducer.Splitter()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, 5000)
    e = s.element[x]
    scanned = s.act[s.scan(e), 0]
    state = 0
    for i, sym in enumerate(x.tolist()):
        state = transducer._step(state, sym)[0]
        assert scanned[i] == state


def test_pieces_match_the_library(spark):
    import sentencepiece

    texts = TEXTS + fuzz()
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in pieces.encode_decode(docs(spark, texts, True), model).collect():
        ids = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == sp.decode(ids)


def test_packing_is_whole(spark, data):
    from tokenizers import Tokenizer

    texts = TEXTS + fuzz() + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts, True).repartition(2), P.path("word_bpe_49k.json"), shard_tokens=50_000).collect()
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(parts) == set(want)
    for i, p in parts.items():
        ids, at = [], 0
        for r in sorted(p, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[i])
            ids += np.frombuffer(r["ids"], "<u4").tolist()
            at += r["length"]
        assert ids == want[i]
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_packing_takes_neighbours_first():
    a, b = np.arange(100, 140), np.arange(500, 540)
    shard = [np.append(x, 2) for x in (a, b, a[:30], b[:30], np.arange(900, 930), np.arange(950, 980))]
    first = next(packing.pack_shard(shard, 70))
    assert [d for d, _, _ in first] == [0, 2]


def test_packing_searches_all_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    topics = [" ".join(word() for _ in range(30)) for _ in range(40)]
    texts = topics + topics  # a copy of each lies 40 documents on, in another partition
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartitionByRange(8, "doc_id")
    rows = packing.pack(table, P.path("word_bpe_49k.json"), window=256, shard_tokens=1000).collect()
    together, shards = {}, {r["sequence_id"] >> 32 for r in rows}
    for r in rows:
        together.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 40)
        together.setdefault(("docs", r["sequence_id"]), set()).add(r["doc_id"])
    met = {d % 40 for k, v in together.items() if isinstance(k, tuple) for d in v if d + 40 in v}
    assert len(shards) > 1 and len(met) >= 30


def test_packing_weighs_by_the_corpus():
    shard = [np.array(x) for x in ([1, 2, 3, 9], [1, 1, 4, 9], [2, 5, 6, 9], [7, 8, 7, 9], [8, 6, 5, 9])]
    df = np.array([0, 400, 3, 2, 2, 2, 2, 2, 2, 1000])  # 1 is common in the corpus, though not in this shard
    index = packing.Bm25([np.unique(d, return_counts=True) for d in shard], packing.Corpus(df, 1000, 4000))
    assert index.ranked(0, np.array([True, False, False, False, False])).tolist() == [2, 1]
    own = packing.Bm25([np.unique(d, return_counts=True) for d in shard], packing.Corpus.of(shard))
    assert own.ranked(0, np.array([True, False, False, False, False])).tolist() == [1, 2]


def test_packing_routes_without_a_sort_of_terms_and_one_lookup_a_unit():
    """Operator 1: the rarest terms come from ids as they are, repeats included."""
    corpus = packing.Corpus(np.array([5, 2, 3, 9, 1, 2]), 10, 100)
    ids = np.array([0, 1, 1, 5, 3, 4, 5, 2])
    want = sorted(corpus.rank[t] for t in (0, 1, 2, 5))  # 3 is too frequent, 4 in one document
    assert corpus.rarest(ids, 3).tolist() == want[:3] and corpus.rarest(ids, 6).tolist() == [*want, packing.LAST, packing.LAST]

    class Counted(dict):
        looked = 0

        def __contains__(self, unit):
            Counted.looked += 1
            return super().__contains__(unit)

    cache = packing.UnitCache(lambda units: (np.arange(len(units), dtype=np.int32), np.ones(len(units), np.int64)))
    cache.code = Counted()
    assert cache.codes(["a", "b", "a"]).tolist() == [0, 1, 0] and cache.codes(["c", "b"]).tolist() == [2, 1] and Counted.looked == 0


def test_words_at_the_borders_of_texts():
    """Operator 1: apostrophes, control strings and accents at the ends of texts, against the library."""
    tok = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    texts = ["<", "|endoftext|> it's", "\u00c3", "\u00e9t\u00c9 A1b22", "", "don't<|endoftext|>x", "plain, words.", "\u00d7 \u00f7<", "'", "1'2"]
    for some in (texts, [t for t in texts if t.isascii()], ["only plain 12 words"]):
        assert [x.tolist() for x in tok.encode(some)] == [tok.library.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_a_document_longer_than_a_shard(spark):
    texts = ["alpha beta gamma", "delta epsilon", LONG, "alpha beta gamma", "delta", "some other words", "more of other words"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = packing.pack(docs(spark, texts).coalesce(1), P.path("word_bpe_49k.json"), window=64, shard_tokens=6000).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    length, total = {}, {}
    for r in rows:
        length[r["sequence_id"]] = length.get(r["sequence_id"], 0) + r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert max(total.values()) > 6000 and sum(length.values()) == sum(total.values())
    # one shard: only its last window is cut
    assert sum(n < 64 for n in length.values()) == (sum(total.values()) % 64).bit_count()


def test_query_columns(spark, data):
    r = queries.op1_packing(spark, data)
    assert r.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(b"abc")


def test_rules_against_plain(spark):
    texts = TEXTS + ["a b c a b c a b c\n\nx\nx\n \n x" * 20, "# | < " * 40] + fuzz(60)
    got = {r["doc_id"]: r for r in rules.apply_rules(docs(spark, texts, True)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.measures(t), t
        assert not (r["base_failed"] and r["kept"]) and r["ids"] == "x"


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1]])
def test_order_never_changes_the_verdict(order):
    import pyarrow as pa
    from hearsay.llm.words import text_bytes

    texts = ["word " * 80, "few words", "a#b " * 70, "line one two three four five\n" * 30, " ".join(f"w{i}" for i in range(90)), ""]
    m = rules.Measures(*text_bytes(pa.array(texts)))
    assert rules.cascade(m, tuple(rules.RULES[i] for i in order)).tolist() == [4]


def test_ordering():
    e = [rules.Estimate("few_words", 1.0, 0.1), rules.Estimate("symbols", 0.1, 0.1), rules.Estimate("repeated_windows", 1.0, 0.5), rules.Estimate("repeated_lines", 1.0, 0.0), rules.Estimate("word_length", 1.0, 0.0)]
    assert [r.name for r in rules.ordered(rules.RULES, e)][:3] == ["symbols", "repeated_windows", "few_words"]


def test_empty(spark):
    none = docs(spark, [])
    assert transducer.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert pieces.encode_decode(none, P.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert rules.apply_rules(none).count() == 0
