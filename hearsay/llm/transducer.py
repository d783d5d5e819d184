"""Token counts from a compiled finite-state tokenizer (byte-level BPE files).

Two deterministic transducers run one after the other:

* the splitter reads character classes; its transitions say "a new word starts
  here".  Each character is a map from state to state; maps are elements of a
  small finite monoid, multiplied by table.  Blocks of characters reduce to one
  element each and the elements compose by parallel prefix scan, which gives the
  state before every character at once;
* the word machine reads bytes; its transitions carry how many tokens the
  encoding gains or loses (``WordMachine``).  Every word starts it anew, so the
  map of a word is constant - a number of tokens - and the maps of all words of a
  text compose by a prefix sum.

The word machine has finitely many states, but far more than any data visits; a
state and its transitions are compiled when they are first reached.  Words of a
batch are told apart by their bytes, and each distinct word runs once.

Defined results: null and empty texts have 0 tokens; an added special string
inside a text is one token; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .store import small_batches
from .words import distinct, give_back, runs, text_bytes

# classes of characters
LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
# symbols: a character with what follows it
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_LASTSPACE, S_LASTWHITE, S_WHITE = range(8)
# states: what is open
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
WHITE_SPACE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
#: Bytes of words, and transitions, that a worker keeps; then it starts over.  A
#: word counts with ``WORD_BYTES`` for its place in the table.
WORDS_KEPT, WORD_BYTES, TRANSITIONS_KEPT = 50_000_000, 150, 600_000
#: Bytes of a word after which the transitions are counted again.
BLOCK = 65_536


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = WHITE
    out[32] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether this character starts a word)."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return START, False
    if symbol == S_LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (IN_OTHER, ONE_MORE, TWO_MORE)[symbol - S_OTHER], True
    if symbol == S_LASTSPACE:
        return AFTER_SPACE, True
    if symbol == S_LASTWHITE:
        return START, True
    return IN_WHITE, state != IN_WHITE


class Splitter:
    """The transition monoid: element -> map of states, and products of elements."""

    def __init__(self):
        maps = [tuple(_step(s, x)[0] for s in range(8)) for x in range(8)]
        first = [tuple([_step(START, x)[0]] * 8) for x in range(8)]  # at the start of a text
        index: dict[tuple, int] = {tuple(range(8)): 0}
        order = [tuple(range(8))]
        for m in [*maps, *first]:
            if m not in index:
                index[m] = len(order)
                order.append(m)
        generators = list(order)
        i = 0
        while i < len(order):
            for g in generators:
                m = tuple(g[s] for s in order[i])
                if m not in index:
                    index[m] = len(order)
                    order.append(m)
            i += 1
        self.size = len(order)
        self.act = np.array(order, np.uint8)
        self.element = np.array([index[m] for m in [*maps, *first]], np.int32)
        self.product = np.array([index[tuple(b[s] for s in a)] for a in order for b in order], np.int32)
        self.fresh = np.array([[_step(s, x)[1] for x in range(8)] for s in range(8)])

    def scan(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Products of all prefixes."""
        n, m = len(x), self.size
        if n <= block:
            out = np.empty(n, np.int32)
            e = 0
            for i in range(n):
                e = out[i] = self.product[e * m + x[i]]
            return out
        rows = -(-n // block)
        a = np.zeros(rows * block, np.int32)
        a[:n] = x
        a = np.ascontiguousarray(a.reshape(rows, block).T)
        for j in range(1, block):
            a[j] = self.product[a[j - 1] * m + a[j]]
        before = np.concatenate([[0], self.scan(a[-1])[:-1]]).astype(np.int32)
        return self.product[before[None, :] * m + a].T.reshape(-1)[:n]

    def starts(self, symbols: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Positions where words start; texts lie end to end."""
        x = self.element[symbols]
        x[text_starts] = self.element[symbols[text_starts].astype(np.int64) + 8]
        state = np.zeros(len(x), np.uint8)
        state[1:] = self.act[self.scan(x)[:-1], START]
        state[text_starts] = START
        return np.flatnonzero(self.fresh[state, symbols])


def symbols_of(code: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Each character's class with what its text has next."""
    cls = character_classes()[code]
    nxt = np.append(cls[1:], END).astype(np.uint8)
    nxt[text_ends - 1] = END
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_LASTSPACE, S_LASTWHITE], np.uint8)[cls]
    out[(cls >= SPACE) & (nxt >= SPACE)] = S_WHITE
    quotes = np.flatnonzero(code == 39)
    if quotes.size:
        c = np.append(code, [0, 0])
        last = np.zeros(len(code) + 2, bool)
        last[text_ends - 1] = True
        one, two = c[quotes + 1], c[quotes + 2]
        has1 = ~last[quotes]
        has2 = has1 & ~last[quotes + 1]
        out[quotes[has1 & np.isin(one, [ord(x) for x in "stmd"])]] = S_QUOTE1
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        out[quotes[has2 & pair]] = S_QUOTE2
    return out


class WordMachine:
    """A deterministic transducer that counts the tokens of a word.

    The encoding of a prefix ends in the one token that fits behind the encoding of
    what lies before it (re-merging the two leaves them as they are).  Which token
    that is depends on a bounded part of the past, and this is the state: the longest
    end of the prefix that begins a token, and for every place in it the last token
    of the encoding up to there and its number of tokens, counted from the end.  A
    transition is annotated with the tokens that it adds (or takes back, when a byte
    completes a longer token).
    """

    #: A place is one number: the token before it plus one (0: nothing lies before),
    #: and in the low bits how many tokens the end has more, plus ``EVEN``.
    LOW, EVEN = 10, 512

    def __init__(self, vocabulary: bpe.MergeVocabulary):
        self.token = {bytes(symbols): t for symbols, t in vocabulary.reachable.items()}
        self.begins = {t[:i] for t in self.token for i in range(1, len(t) + 1)}
        self.fits = vocabulary.fits
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self._state(b"", (self.EVEN,))

    def _state(self, end: bytes, places: tuple) -> int:
        key = (end, places)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added) of one transition."""
        end, places = self.states[state]
        end += bytes((byte,))
        for at, place in enumerate(places):
            t = self.token.get(end[at:])
            if t is not None and (place < 1 << self.LOW or self.fits((place >> self.LOW) - 1, t)):
                added = 1 + self.EVEN - (place & (1 << self.LOW) - 1)
                break
        else:
            raise ValueError("a byte has no token")
        places = (*(x + added for x in places), (t + 1 << self.LOW) + self.EVEN)
        cut = next((i for i in range(len(end)) if end[i:] in self.begins), len(end))
        step = self.steps[state << 8 | byte] = self._state(end[cut:], places[cut:]), added
        return step

    def count(self, word: bytes) -> int:
        state, n, get = 0, 0, self.steps.get
        for a in range(0, len(word), BLOCK):
            if len(self.steps) > TRANSITIONS_KEPT:
                # the state that a long word has come to stays
                here = self.states[state]
                self._reset()
                state, get = self._state(*here), self.steps.get
            for b in word[a : a + BLOCK]:
                state, added = get(state << 8 | b) or self._compile(state, b)
                n += added
        return n


class TokenCounter:
    def __init__(self, path: str):
        self.machine = WordMachine(bpe.from_json(path))
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.splitter = Splitter()
        self.words: dict[bytes, int] = {}
        self.held = 0

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; texts lie end to end."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return self._plain(raw, data, offsets)
        # special strings are one token each, and what lies between them is on its own
        parts, owner = [], []
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = [raw[a:b]]
            for s in self.special:
                own = [q for p in own for q in p.split(s)]
            parts += own
            owner += [i] * len(own)
            out[i] = len(own) - 1
        joined = b"".join(parts)
        np.add.at(out, np.array(owner), self._plain(joined, np.frombuffer(joined, np.uint8), np.cumsum([0, *map(len, parts)])))
        return out

    def _plain(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        borders = np.searchsorted(byte_of, offsets)
        some = np.flatnonzero(np.diff(borders) > 0)
        starts = byte_of[self.splitter.starts(symbols_of(code, borders[some + 1]), borders[some])]
        stops = np.append(starts[1:], len(data))
        place, number = distinct(data, starts, stops)
        if self.held > WORDS_KEPT:
            self.words.clear()
            self.held = 0
        counts = np.empty(len(place), np.int64)
        for i, (a, b) in enumerate(zip(starts[place].tolist(), stops[place].tolist(), strict=True)):
            word = raw[a:b]
            n = self.words.get(word)
            if n is None:
                n = self.words[word] = self.machine.count(word)
                self.held += len(word) + WORD_BYTES
            counts[i] = n
        total = np.concatenate([[0], np.cumsum(counts[number])])
        return np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes`` and ``n_tokens``."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n = [counter.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in runs(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate(n) if n else np.empty(0, np.int64), pa.int64())], names=["__id", "n_bytes", "n_tokens"])
        give_back()

    kind = src.schema["__id"].dataType.simpleString()
    return src.mapInArrow(run, f"__id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("__id", id_col)
