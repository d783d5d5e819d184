"""Packing documents into fixed windows by lexical retrieval.

Documents are tokenised once, into a table.  Document frequency, document count
and mean length are counted over all of it.  Then documents are routed by content:
they are dealt and sorted by their rarest indexed terms, so that those that share
them meet in one shard whatever the files they came from, and each task builds BM25
inverted indexes over its shards, with the weights of the whole corpus.  Documents
that share only commoner terms may lie in different shards.  A window starts with a seed document (or what was left of the last one that was
cut); the index ranks the shard's unused documents against the seed's tokens
and the best neighbours fill the window.  A document that does not fit is cut
and its rest opens the next window, so full windows carry no padding.  A shard's
last, unfilled window is cut at powers of two, which need no padding either.  A
document as long as a shard fills windows of its own with all but its end.

Defined results: null and empty texts are documents of the end token alone;
repeated rows and repeated or null ids are documents of their own; ties of the
score go to the earlier document of the shard in the order of routing; an empty table packs to no rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .store import materialize, partitions, small_batches
from .units import UnitCache
from .words import BLANK, LOWER, distinct, give_back, runs, text_bytes, words_of

K1, B = 1.2, 0.75
#: Documents are routed by so many terms; those that have fewer go last.
KEYS, LAST = 4, np.iinfo(np.int32).max
_ODD_SPACE = re.compile(r"[\x1c-\x1f\s]")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[BLANK] = 0
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
#: Bytes of chunks that are cut all at once: ASCII without control characters and the apostrophe.
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_PLAIN[BLANK] = True
_PLAIN[39] = False
#: Bytes of units that a worker remembers; then it starts over.
WORDS_KEPT, ODD_KEPT = 40_000_000, 40_000_000


def _translated(raw: bytes, table: np.ndarray) -> np.ndarray:
    """table[byte] for each byte, as new bytes."""
    return np.frombuffer(bytearray(raw.translate(table.tobytes())), np.uint8)


class WordTokenizer:
    """The lower-casing word vocabulary, over whole batches of bytes.

    Chunks between blanks never interact.  Chunks of ASCII and Latin letters are
    cut where the kind of character changes, all at once; others (apostrophes,
    further alphabets, control strings) are cut by pattern or go to the library.
    Each distinct unit of a batch is looked up once.
    """

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = bpe.from_json(path)
        del self.vocabulary.pairs, self.vocabulary.reachable  # lockstep encoding reads neither
        give_back()
        self.words = UnitCache(self._encode_words, WORDS_KEPT)
        self.odd = UnitCache(self._encode_odd, ODD_KEPT)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([0, *map(len, words)], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        flat[ends[1:] - 1] += 256
        return self.vocabulary.encode_many(flat, ends)

    def _encode_odd(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[list[bytes] | None] = []
        for c in chunks:
            t = c.decode()
            # composed Latin letters are their own normal form and lower-case one by one
            plain = (t.isascii() or max(t) < "İ") and "<|" not in t and not _ODD_SPACE.search(t)
            parts.append([w.encode() for w in _WORD.findall(t.lower())] if plain else None)
        words = [w for p in parts if p for w in p]
        ids, ends = self.words.spread(self.words.codes(words)) if words else (np.empty(0, np.int32), np.empty(0, np.int64))
        ends = np.concatenate([[0], ends])
        strange = [i for i, p in enumerate(parts) if p is None]
        found = iter(self.library.encode_batch_fast([chunks[i].decode() for i in strange], add_special_tokens=False)) if strange else iter(())
        out, at = [], 0
        for p in parts:
            if p is None:
                out.append(np.asarray(next(found).ids, np.int32))
            else:
                out.append(ids[ends[at] : ends[at + len(p)]])
                at += len(p)
        return np.concatenate(out).astype(np.int32), np.array([len(x) for x in out])

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's begin and the total)."""
        starts, ends, first = words_of(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        fine = _translated(raw, _PLAIN).view(bool)
        low = _translated(raw, LOWER)
        if (high := data >= 0x80).any():
            latin = np.append(False, data[:-1] == 0xC3)
            fine |= (data == 0xC3) & np.append(high[1:], False) | latin & high & (data != 0x97) & (data != 0xB7)
            low[latin & high & (data <= 0x9E) & (data != 0x97)] += 32
        fine[:-1] &= (data[:-1] != 60) | (data[1:] != 124)  # a control string may begin
        odd = np.zeros(len(starts), bool)
        # blanks are fine, so each other byte is in a chunk
        odd[np.searchsorted(starts, np.flatnonzero(~fine), "right") - 1] = True
        # where the kind changes, and at each digit, a unit of a plain chunk begins
        kind = _translated(raw, _KIND)
        begins = kind == _DIGIT
        begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
        heads = np.zeros(len(data), bool)
        heads[starts] = True
        at = np.flatnonzero(begins | heads)
        head = heads[at]
        chunk = np.cumsum(head, dtype=np.int32) - 1
        strange = odd[chunk]
        if odd.any():
            # a strange chunk is one unit
            keep = ~strange | head
            at, chunk, strange = at[keep], chunk[keep], strange[keep]
        stop = np.minimum(np.append(at[1:], len(data)), ends[chunk])
        codes = np.empty(len(at), np.int64)
        counts = np.empty(len(at), np.int64)
        sources = []
        rows_odd = np.flatnonzero(strange)
        for cache, rows, bytes_ in ((self.words, np.flatnonzero(~strange) if len(rows_odd) else slice(None), low), (self.odd, rows_odd, data)):
            begin, end = at[rows], stop[rows]
            place, number = distinct(bytes_, begin, end)
            text = raw if bytes_ is data else bytes_.tobytes()
            units = [text[a:b] for a, b in zip(begin[place].tolist(), end[place].tolist(), strict=True)]
            code = cache.codes(units) if units else np.empty(0, np.int64)
            codes[rows] = cache.start[code][number] if units else 0
            counts[rows] = cache.count[code][number] if units else 0
            sources.append(cache.ids)
            # codes hold until the next call only: the ids of the first cache must not move meanwhile
        total = np.concatenate([[0], np.cumsum(counts)])
        gather = np.repeat(codes - total[:-1], counts)
        gather += np.arange(total[-1])
        where = total[np.searchsorted(at, offsets)]
        if not len(rows_odd):
            return sources[0][gather], where
        from_odd = np.repeat(strange, counts)
        ids = np.empty(total[-1], np.int32)
        ids[~from_odd] = sources[0][gather[~from_odd]]
        ids[from_odd] = sources[1][gather[from_odd]]
        return ids, where

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, cuts = self.encode_bytes(*text_bytes(pa.array(texts, pa.string())))
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Corpus:
    """Document frequency by term, documents and mean length of all documents."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.df, self.n, self.mean = df, n, tokens / max(n, 1)
        # terms of one document, and terms of more than half of the documents
        # (whose BM25 weight is negative), rank nothing and are left out
        self.indexed = (df > 1) & (2 * df <= n)
        self.idf = np.log((n - df + 0.5) / (df + 0.5))
        self.rank = np.empty(len(df), np.int32)
        self.rank[np.argsort(df, kind="stable")] = np.arange(len(df), dtype=np.int32)
        self.key = np.where(self.indexed, self.rank, LAST).astype(np.int32)

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        return cls(frequency(docs), len(docs), sum(map(len, docs)))

    def rarest(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Ranks of the k rarest indexed terms among ids, which may repeat; then ``LAST``."""
        r = np.unique(self.key[ids])[:k]
        return np.concatenate([r, np.full(k - len(r), LAST, np.int32)])


def frequency(docs: list[np.ndarray]) -> np.ndarray:
    found = [np.unique(d) for d in docs]
    return np.bincount(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Bm25:
    """An inverted index over one shard: term -> documents with their BM25 weight
    in the whole corpus.  ``counts``: terms and their counts of each document."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], corpus: Corpus):
        self.n = n = len(counts)
        lens = np.array([c.sum() for _, c in counts])
        doc = np.repeat(np.arange(n), [len(t) for t, _ in counts])
        term, tf = np.concatenate([t for t, _ in counts]), np.concatenate([c for _, c in counts])
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        df = np.diff(np.append(first, len(term)))
        # what no other document of the shard holds finds nothing here
        keep = (df > 1) & corpus.indexed[term[first]]
        norm = K1 * (1 - B + B * lens / max(corpus.mean, 1))
        weight = corpus.idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        kept = np.repeat(keep, df)
        self.doc, self.weight = doc[kept], weight[kept].astype(np.float32).astype(np.float64)
        self.df = df[keep]
        self.start = np.cumsum(self.df) - self.df
        # the kept terms of each document, as places in the index
        place = np.repeat(np.arange(len(self.df)), self.df)
        order = np.argsort(self.doc, kind="stable")
        self.terms = place[order]
        self.first = np.searchsorted(self.doc[order], np.arange(n + 1))

    def ranked(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        t = self.terms[self.first[seed] : self.first[seed + 1]]
        if not len(t):
            return t
        n = self.df[t]
        at = np.repeat(self.start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        hits = np.flatnonzero(score > 0)
        return hits[np.argsort(-score[hits], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int, corpus: Corpus | None = None, counts: list | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first id, number of ids)."""
    index = Bm25(counts or [np.unique(d, return_counts=True) for d in docs], corpus or Corpus.of(docs))
    used = np.zeros(len(docs), bool)
    rest: tuple[int, int] | None = None
    nxt = 0
    while True:
        if rest is None:
            while nxt < len(docs) and used[nxt]:
                nxt += 1
            if nxt == len(docs):
                return
            rest = (nxt, 0)
            used[nxt] = True
        seed, out, space = rest[0], [], window
        near = None
        while rest is not None:
            d, a = rest
            take = min(space, len(docs[d]) - a)
            out.append((d, a, take))
            space -= take
            rest = (d, a + take) if a + take < len(docs[d]) else None
            if not space:
                break
            if near is None:
                near = iter(index.ranked(seed, used).tolist())
            d = next(near, None)
            while d is None and nxt < len(docs):
                if not used[nxt]:
                    d = nxt
                nxt += 1
            if d is not None:
                used[d] = True
                rest = (d, 0)
        yield out


def cut_at_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """An unfilled window as windows whose sizes are powers of two."""
    pieces = list(pieces)[::-1]
    left = sum(p[2] for p in pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            d, a, n = pieces.pop()
            if n > room:
                pieces.append((d, a + room, n - room))
                n = room
            out.append((d, a, n))
            room -= n
        yield out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _words(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids`` (binary:
    little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``shard_tokens`` bounds a shard's memory; every document is packed.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    small_batches(spark)
    # two bytes an id where the vocabulary allows it
    kept_as = "<u2" if max(_words(tokenizer), end_id + 1) <= 1 << 16 else "<u4"

    def tokenise(batches):
        give_back()  # the workers stay, with what earlier tasks freed
        tok = _tokenizer(tokenizer)
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 33
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in runs(offsets, 1_000_000):
                ids, cuts = tok.encode_bytes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                # every document ends with its end token
                n = b - a
                out = np.empty(len(ids) + n, kept_as)
                last = cuts[1:] + np.arange(n)
                out[last] = end_id
                body = np.ones(len(out), bool)
                body[last] = False
                out[body] = ids
                borders = np.concatenate([[0], last + 1]) * out.itemsize
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), raw, pa.array(np.arange(at, at + n))], names=["__id", "__ids", "__at"])
                at += n
        give_back()

    tokens = materialize(src.mapInArrow(tokenise, f"__id {kind}, __ids binary, __at bigint"), "packing-tokens")

    def count(batches):
        _tokenizer.cache_clear()  # the workers stay, and no longer need what they remember of words
        give_back()
        df, n, size = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            found = _documents(batch.column(0), kept_as)
            more = frequency(found)
            wide = max(len(df), len(more))
            df = np.pad(df, (0, wide - len(df))) + np.pad(more, (0, wide - len(more)))
            n, size = n + len(found), size + sum(map(len, found))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], held), pa.int64()), pa.array(np.append([n, size], df[held]), pa.int64())], names=["term", "df"])

    # as many rows as the vocabulary has terms, whatever the input
    counted = {r["term"]: r["df"] for r in tokens.select("__ids").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n, size = counted.pop(-1, 0), counted.pop(-2, 0)
    df = np.zeros(max(counted, default=-1) + 1, np.int64)
    df[list(counted)] = list(counted.values())
    corpus = Corpus(df, n, size)
    keys = [f"__r{i}" for i in range(KEYS)]

    def route(batches):
        _tokenizer.cache_clear()
        for batch in batches:
            found = _documents(batch.column(1), kept_as)
            r = np.array([corpus.rarest(d, KEYS) for d in found], np.int32).reshape(-1, KEYS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(r[:, i], pa.int32()) for i in range(KEYS)]], names=["__id", "__ids", "__at", *keys])

    shards = -(-size // shard_tokens)
    parts = max(1, min(shards, max(partitions(spark), -(-shards // 8))))
    routed = tokens.mapInArrow(route, f"__id {kind}, __ids binary, __at bigint, " + ", ".join(f"{k} int" for k in keys))
    routed = routed.repartitionByRange(parts, *keys, "__at").sortWithinPartitions(*keys, "__at").select("__id", "__ids")

    def run(batches):
        _tokenizer.cache_clear()
        give_back()
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        id_type = pa.int64()
        shard: list[tuple] = []  # id, ids that are left, their start, terms and counts, all ids
        out: list[list] = [[], [], [], [], [], [], []]
        size = 0

        def put(part):
            nonlocal sequence
            at = 0
            for key, a, ids, total in part:
                for c, v in zip(out, (key, a, len(ids), ids.astype("<u4").tobytes(), total, sequence, at), strict=True):
                    c.append(v)
                at += len(ids)
            sequence += 1

        def rows():
            nonlocal out
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out = [[], [], [], [], [], [], []]
            return batch

        def flush():
            nonlocal shard, size
            for full in pack_shard([x[1] for x in shard], window, corpus, [x[3] for x in shard]):
                for part in [full] if sum(p[2] for p in full) == window else cut_at_powers(full):
                    put([(shard[d][0], shard[d][2] + a, shard[d][1][a : a + k], shard[d][4]) for d, a, k in part])
            shard, size = [], 0
            return rows()

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), _documents(batch.column(1), kept_as), strict=True):
                counts, total, start = np.unique(ids, return_counts=True), len(ids), 0
                if total >= shard_tokens:
                    # whole windows of one document need no neighbours; its end does
                    start = (total - 1) // window * window
                    for a in range(0, start, window):
                        put([(key, a, ids[a : a + window], total)])
                    yield rows()
                    ids = ids[start:].copy()
                shard.append((key, ids, start, counts, total))
                size += max(len(ids), len(counts[0]))
                if size >= shard_tokens:
                    yield flush()
        if shard:
            yield flush()

    return routed.mapInArrow(run, f"__id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("__id", id_col)


def _documents(column, kept_as: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kept_as).astype(np.int32) for x in column.to_pylist()]
