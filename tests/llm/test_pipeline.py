import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from hearsay.llm.rules import RULES, Measures, cascade
from hearsay.llm.words import text_bytes

from . import brute


def plain(rows):
    """{id: text} after each filtering stage."""
    import pyarrow as pa

    docs = dict(rows)
    kept = []
    for i, t in docs.items():
        n, chars, symbols, _, repeats = brute.measures(t)
        fine = len(cascade(Measures(*text_bytes(pa.array([t], pa.string()))), RULES)) == 1
        assert not fine or (n >= 50 and 100 * repeats <= 50 * n and 10 * symbols <= n and 2 * n <= chars <= 15 * n)
        if fine:
            kept.append(i)
    stages = [{i: docs[i] for i in kept}]
    same = brute.exact(stages[-1].items())
    stages.append({i: t for i, t in stages[-1].items() if same[i][0] == i})
    comp = brute.components(list(stages[-1].items()))
    stages.append({i: t for i, t in stages[-1].items() if comp[i][1] == i})
    left = list(stages[-1].items())
    stages.append({i: (k.decode() if n else t) for (i, t), (k, n) in zip(left, brute.substrings(left, 35), strict=True)})
    return stages


def test_stages_against_plain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 4000")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows)
    for (name, stage), texts in zip(cp.STAGES[:4], want, strict=True):
        docs = cp.materialize(stage(spark, docs, data), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == texts, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = cp.STAGES[4][1](spark, docs, data).collect()
    n = {}
    for r in pieces:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["length"]
    assert n == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_run(spark, data):
    out = cp.run(spark, data)
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert np.all([len(s) == 2 for s in cp.STAGES])


def test_stages_take_odd_rows(spark, data):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = " ".join(f"word{i}" for i in range(80))
    odd = spark.createDataFrame([(None, text, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text + " more", None, None, None)], kind)
    for docs in (odd, odd.where("doc_id > 99")):
        for name, stage in cp.STAGES:
            docs = cp.materialize(stage(spark, docs, data), "odd")
            assert docs.count() >= 0, name
