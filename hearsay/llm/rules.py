"""Quality rules as a short-circuit cascade.

Every rule's cost (seconds a document) and selectivity (share of documents it
rejects) are estimated on a bounded sample; rules then run in the order of
rejections per cost, each only on the documents that all rules before it kept.
The order changes the work, never the verdict.  A measure that several rules or
the caller ask for is taken once.

Defined results: a null or empty text has no words and fails; repeated rows
repeat; other columns pass through when asked for, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .words import distinct, give_back, runs, text_bytes, words_of

#: Documents, and bytes of text, that the estimates of cost and selectivity read at
#: most; the verdicts do not depend on them.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


class Measures:
    """What the rules ask of a run of texts, taken when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = words_of(data, offsets)
        self.n_words = np.diff(self.first)

    def subset(self, rows: np.ndarray) -> "Measures":
        """The measures of some of the texts; what was taken is not taken again."""
        if len(rows) == len(self.offsets) - 1:
            return self
        parts = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        out = Measures(np.concatenate(parts) if parts else self.data[:0], np.cumsum([0, *map(len, parts)]).astype(np.int64))
        for name in set(self.__dict__) & {"word_chars", "n_symbols", "n_lines", "n_repeat_words"}:
            out.__dict__[name] = self.__dict__[name][rows]
        if "lines" in self.__dict__:
            out.__dict__["lines"] = tuple(x[rows] for x in self.__dict__["lines"])
        return out

    @cached_property
    def word_chars(self) -> np.ndarray:
        d = self.data
        blank = (d == 32) | ((d >= 9) & (d <= 13))
        return _sums(~blank & ((d & 0xC0) != 0x80), self.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _sums(_SYMBOL[self.data], self.offsets)

    @cached_property
    def n_letters(self) -> np.ndarray:
        """Letters of ASCII, and characters beyond it."""
        d = self.data
        return _sums(((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 0xC0), self.offsets)

    @cached_property
    def n_ellipses(self) -> np.ndarray:
        """Lines that break off in three full stops."""
        d, n = self.data, len(self.offsets) - 1
        stop = np.append(d[1:] == 10, True)
        ends = self.offsets[1:][np.diff(self.offsets) > 0]
        stop[ends - 1] = True
        dots = np.flatnonzero((d == 46) & stop) if len(d) else np.empty(0, np.int64)
        owner = np.searchsorted(self.offsets, dots, "right") - 1
        inside = dots - 2 >= self.offsets[owner]
        dots, owner = dots[inside], owner[inside]
        return np.bincount(owner[(d[dots - 1] == 46) & (d[dots - 2] == 46)], minlength=n)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those equal to an earlier one) of each text."""
        raw = self.data.tobytes()
        total = np.zeros(len(self.offsets) - 1, np.int64)
        again = np.zeros(len(self.offsets) - 1, np.int64)
        for i, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            total[i], again[i] = len(lines), len(lines) - len(set(lines))
        return total, again

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in three-word windows that the text has at least twice."""
        n = len(self.offsets) - 1
        if len(self.starts) < 3:
            return np.zeros(n, np.int64)
        word = distinct(self.data, self.starts, self.ends)[1]
        owner = np.repeat(np.arange(n), self.n_words)
        at = np.flatnonzero(owner[:-2] == owner[2:])
        # windows get numbers of their own in two steps: pairs of words, then a pair and a word
        width = np.int64(len(self.starts))
        two = np.unique(word[at] * width + word[at + 1], return_inverse=True)[1]
        three = np.unique(two * width + word[at + 2], return_inverse=True)[1]
        _, back, count = np.unique(three * np.int64(n) + owner[at], return_inverse=True, return_counts=True)
        again = at[count[back] > 1]
        covered = np.zeros(len(word), bool)
        for d in range(3):
            covered[again + d] = True
        return np.bincount(owner[covered], minlength=n)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


def _dup_lines(m: Measures) -> np.ndarray:
    total, again = m.lines
    return 10 * again > 3 * total


#: Each rule alone rejects a document; limits are the widely published ones.
RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("many_words", lambda m: m.n_words > 100_000),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", _dup_lines),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
    Rule("ellipses", lambda m: 10 * m.n_ellipses > 3 * m.lines[0]),
    Rule("letters", lambda m: 2 * m.n_letters < m.word_chars),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample_rows`` documents, up to
    about ``SAMPLE_BYTES`` of text.  Executors measure; a row a rule comes back."""

    def measure(batches):
        cost, rejected, seen, size = [0.0] * len(rules), [0] * len(rules), 0, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in runs(offsets):
                if size >= SAMPLE_BYTES:
                    break
                seen, size = seen + b - a, size + int(offsets[b] - offsets[a])
                for i, rule in enumerate(rules):
                    m = Measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    began = time.perf_counter()
                    rejected[i] += int(rule.rejects(m).sum())
                    cost[i] += time.perf_counter() - began
        n = max(seen, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([c / n for c in cost]), pa.array([r / n for r in rejected])], names=["rule", "cost", "rejected"])

    sample = docs.select(F.col(f"`{text_col}`").cast("string")).limit(sample_rows)
    found = {r["rule"]: r for r in sample.mapInArrow(measure, "rule int, cost double, rejected double").collect()}
    return [Estimate(rule.name, *(found[i]["cost"], found[i]["rejected"]) if i in found else (0.0, 0.0)) for i, rule in enumerate(rules)]


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """Most rejections per cost first; ties keep the given order, rules without
    an estimate come last."""
    worth = {e.name: e.rejected / max(e.cost, 1e-9) for e in estimates}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def cascade(m: Measures, rules: tuple[Rule, ...]) -> np.ndarray:
    """Places of the texts that no rule rejects."""
    alive = np.arange(len(m.offsets) - 1)
    for rule in rules:
        if not len(alive):
            break
        fine = np.flatnonzero(~rule.rejects(m))
        alive, m = alive[fine], m.subset(fine)
    return alive


def apply_rules(docs: DataFrame, text_col: str = "text", measures: bool = True, only_kept: bool = False, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``kept``; with ``measures`` also the base measures of every
    document.  ``only_kept`` leaves out rejected rows, and the column ``kept``.

    Columns of ``docs`` that are named like a new column are replaced.
    """
    small_batches(docs.sparkSession)
    chain = ordered(rules, estimate(docs, rules, text_col, sample_rows))
    new = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] if measures else []
    new += [T.StructField("base_failed", T.BooleanType())] if measures else []
    new += [] if only_kept else [T.StructField("kept", T.BooleanType())]
    fields = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    src = docs.select([docs[f"`{f.name}`"] for f in fields])
    place = [f.name for f in fields].index(text_col)
    schema = T.StructType([*fields, *new])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for a, b in runs(offsets):
                m = Measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = list(batch.slice(a, b - a).columns)
                if measures:
                    # the caller wants them of every document: the cascade finds them taken
                    taken = (m.n_words, m.word_chars, m.n_symbols, m.lines[1], m.n_repeat_words)
                    columns += [pa.array(v, pa.int64()) for v in taken]
                    columns.append(pa.array((m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)))
                kept = np.zeros(b - a, bool)
                kept[cascade(m, chain)] = True
                if not only_kept:
                    columns.append(pa.array(kept))
                out = pa.RecordBatch.from_arrays(columns, names=schema.names)
                yield out.filter(pa.array(kept)) if only_kept else out
        give_back()

    return src.mapInArrow(run, schema)
