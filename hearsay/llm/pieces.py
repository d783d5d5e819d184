"""SentencePiece encoding and decoding (BPE models with byte fallback).

Method: exact merge-type encoding by backtracking, see ``bpe.MergeVocabulary``.
No piece holds a space mark after another character, so a text falls apart into
units - space marks with the characters up to the next mark - that never merge
with each other.  Units are encoded once per worker while they stay cached.

Defined results: null and empty texts give the begin and end ids and decode to
an empty text; a character without a piece becomes its UTF-8 byte pieces; rows
repeat if the input repeats them; columns other than the two named ones are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .store import small_batches
from .units import UnitCache, filled, groups

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


class PieceEncoder:
    def __init__(self, model: str):
        self.vocabulary, self.byte_ids, self.processor = bpe.from_sentencepiece(model)
        self.known = {bytes(u).decode() for u in self.vocabulary.units}
        if any(MARK in self.processor.id_to_piece(i).lstrip(MARK) for i in range(self.processor.get_piece_size())):
            raise ValueError("pieces that hold a space inside are not supported")
        self.cache = UnitCache(self._encode_units)
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of known characters of all units are encoded together."""
        runs: list[str] = []
        plan: list[tuple[int, list]] = []  # units that are not one run: (unit, runs' places or ids)
        whole: list[int] = []
        for i, u in enumerate(units):
            if MARK + MARK not in u and self.known.issuperset(u):
                whole.append(i)
                runs.append(u)
        for i in np.setdiff1d(np.arange(len(units)), whole).tolist():
            parts: list = []
            for fine, chars in groupby(units[i], self.known.__contains__):
                run = "".join(chars)
                if not fine:
                    parts.append(self.byte_ids[list(run.encode())].tolist())
                elif MARK + MARK in run:
                    parts.append(self._merge_marks(run))
                else:
                    parts.append(len(runs))
                    runs.append(run)
            plan.append((i, parts))
        ids, n = self._runs(runs)
        if not plan:
            return ids, n
        starts = np.cumsum(n) - n
        counts = np.zeros(len(units), np.int64)
        counts[whole] = n[: len(whole)]
        odd = {i: np.concatenate([np.asarray(p, np.int32) if isinstance(p, list) else ids[starts[p] : starts[p] + n[p]] for p in parts]) for i, parts in plan}
        for i, x in odd.items():
            counts[i] = len(x)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        m = n[: len(whole)]
        out[np.repeat(at[whole] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] = ids[: int(m.sum())]
        for i, x in odd.items():
            out[at[i] : at[i] + len(x)] = x
        return out, counts

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [r.encode() for r in runs]
        return self.vocabulary.encode_many(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32), np.cumsum([0, *map(len, raw)], dtype=np.int64))

    def _merge_marks(self, run: str) -> list[int]:
        """The last mark may join the word; marks merge only after all words did."""
        marks = len(run) - len(run.lstrip(MARK))
        tail = run[marks - 1 :]
        ids = self._runs([tail])[0].tolist()
        one = self.vocabulary.units[tuple(MARK.encode())]
        if ids and ids[0] == one:
            return self._mark_ids(marks) + ids[1:]
        return self._mark_ids(marks - 1) + ids

    @lru_cache(maxsize=4096)
    def _mark_ids(self, n: int) -> tuple | list:
        # runs merge in pairs from the left, again and again
        ids = [self.vocabulary.units[tuple(MARK.encode())]] * n
        return self.vocabulary.merge(ids)[0]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " ":
            return _UNITS.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the begin and end ids."""
        each = [self.units(t) for t in texts]
        ids, ends = self.cache.spread(self.cache.codes([u for x in each for u in x]))
        stops = np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]
        one, two = np.array([self.begin], "<u4"), np.array([self.end], "<u4")
        ids = ids.astype("<u4")
        return [np.concatenate([one, ids[a:b], two]) for a, b in zip(stops[:-1], stops[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(model: str) -> PieceEncoder:
    return PieceEncoder(model)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (binary: little-endian unsigned
    32-bit ids) and ``decoded`` (the model's own decoding of them)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches):
        enc = _encoder(model)
        for batch in batches:
            texts = filled(batch.column(1))
            for a, b in groups(texts):
                ids = enc.encode(texts[a:b])
                back = enc.processor.decode([x.tolist() for x in ids], num_threads=1) if ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(back, pa.string())], names=["__id", "ids", "decoded"])

    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, ids binary, decoded string").withColumnRenamed("__id", id_col)
