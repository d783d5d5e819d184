"""Words, lines and hashes of whole Arrow batches, without a Python object per
word.

Positions are byte positions in a batch's text buffer; texts lie end to end.
Hashes only sort and deal out: what an operator acts on is decided by the words
themselves (``distinct`` compares them) or by a BLAKE2b digest of their bytes.
No hash here is linear in its input, so no family of strings (such as a
Thue-Morse word and its complement) is bound to collide.
"""

from __future__ import annotations

import ctypes
from hashlib import blake2b

import numpy as np
import pyarrow as pa

MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG = 64
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * FOLD
        x = (x ^ (x >> np.uint64(29))) * MIX
        return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a followed by b."""
    with np.errstate(over="ignore"):
        return mix(a * FOLD + b + MIX)


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * MIX)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k symbols, put together from halves."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, width, power, size = None, 0, h, 1
    while True:
        if k & size:
            out = power if out is None else pair(out[: len(h) - (width + size) + 1], power[width : len(h) - size + 1])
            width += size
        if width == k:
            return out
        power = pair(power[: len(power) - size], power[size:])
        size *= 2


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1_000_000):
    """Consecutive texts of about ``most`` bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total): words are runs of
    bytes other than blanks, cut at text borders."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~BLANK[data]
    before = np.append(False, solid[:-1])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.append(solid[1:], False)
    inner = offsets[1:-1]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the end."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the length takes part.  Eight bytes at
    a time are mixed in, for all words at once; words of over ``LONG`` bytes get a
    BLAKE2b digest.  Words that one ``salt`` confuses another one tells apart."""
    v, size = _eights(data), ends - starts
    turn = mix(np.array([salt], np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = mix((v[starts] & _HEADS[np.minimum(size, 8)]) * turn + size.astype(np.uint64) * MIX)
    more = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while more.size:
        h[more] = pair(h[more], v[starts[more] + at] & _HEADS[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return h


def _alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word equals word ``first`` of it, byte by byte."""
    v, size = _eights(data), ends - starts
    out = size == size[first]
    live, at = np.flatnonzero(out & (first != np.arange(len(first)))), 0
    while live.size and at < LONG:
        keep = _HEADS[np.minimum(size[live] - at, 8)]
        same = ((v[starts[live] + at] ^ v[starts[first[live]] + at]) & keep) == 0
        out[live[~same]] = False
        at += 8
        live = live[same & (size[live] > at)]
    for i in live.tolist():
        j = first[i]
        out[i] = bool((data[starts[i] : ends[i]] == data[starts[j] : ends[j]]).all())
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct word, the number of each word among them).
    Words are told apart by their bytes: a hash that two words share is noticed."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = word_hashes(data, starts, ends) if hashes is None else hashes
    order = np.argsort(h)
    fresh = np.append(True, h[order[1:]] != h[order[:-1]])
    first = order[fresh]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(fresh) - 1
    if not _alike(data, starts, ends, first[number]).all():
        code: dict[bytes, int] = {}
        raw = data.tobytes()
        number = np.fromiter((code.setdefault(raw[a:b], len(code)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        first = np.unique(number, return_index=True)[1]
    return first, number


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BLAKE2b digests (128 bits, as two numbers) of ranges of bytes."""
    found = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


PRIME = np.uint64((1 << 61) - 1)
_31, _30, _ONE = np.uint64(31), np.uint64(30), np.uint64(61)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _ONE)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(_reduced(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31)) + _reduced(a0 * b0))


#: The base of this process, and its powers and those of its inverse.
_base = int(np.random.default_rng().integers(1 << 40, int(PRIME) - 1))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    for name, base in (("up", _base), ("down", pow(_base, -1, int(PRIME)))):
        while len(_powers[name]) < n:
            have = _powers[name]
            _powers[name] = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), int(PRIME)), np.uint64))])
    return _powers["up"], _powers["down"]


class Rolling:
    """Prefix polynomial hashes modulo the prime 2^61 - 1, to a base that each
    process draws at random; ``of(a, b)`` hashes the ranges [a, b)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _powers_to(n + 1)
        terms = np.empty(n, np.uint64)
        for a in range(0, n, 1 << 16):  # in the processor's cache
            terms[a : a + (1 << 16)] = times(_reduced(symbols[a : a + (1 << 16)]), up[a : min(n, a + (1 << 16))])
        self.total = np.zeros(n + 1, np.uint64)
        high = _reduced(np.cumsum(terms >> _31))
        # high * 2^31: the bits from 30 on go round
        self.total[1:] = _reduced((high >> _30) + ((high & _LOW30) << _31) + _reduced(np.cumsum(terms & _LOW31)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.total[b] + PRIME - self.total[a]
        return times(np.where(d >= PRIME, d - PRIME, d), self.down[a])


def give_back() -> None:
    """Memory that this worker freed goes back to the machine; workers outlive
    their tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library: the memory stays with the worker
        pass
