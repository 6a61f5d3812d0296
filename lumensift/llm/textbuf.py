"""Words and rolling hashes of whole Arrow batches of texts, by numpy over the batch's byte buffer."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(7_919)
#: A random value for each byte, and an odd base: sums of value * base^position are hashes modulo 2^64.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Multipliers of MinHash functions, odd, and what their input is combined with.
FACTORS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes that are hashed at once, about, and powers that a worker keeps of a base.
PIECE = 1 << 20
KEPT_POWERS = 2 * PIECE

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64. Up to KEPT_POWERS of them are kept; beyond that they are made for the call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out, got = np.ones(size, np.uint64), 1
        while got < size:
            step = min(got, size - got)
            out[got : got + step] = out[:step] * np.uint64(pow(base, got, 1 << 64))
            got += step
        have = out
        if size <= KEPT_POWERS:
            _powers[base] = out
    return have[:n]


def releasing(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f over batches; behind its last one, the memory that an idle worker would keep goes back to the system."""

    @wraps(f)
    def over(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args, **kwargs)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return over


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def white_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text): words are runs of other bytes than ASCII white space, A-Z as a-z."""
    return runs(data, offsets, white_space(data))[:2]


def _piece_ends(n: int, offsets: np.ndarray, white: np.ndarray) -> list[int]:
    """Where to cut n bytes into pieces of PIECE bytes, about, so that no run goes on in the next piece."""
    ends, at = [], 0
    while n - at > PIECE + PIECE // 2:
        at += PIECE
        stop = int(offsets[np.searchsorted(offsets, at)])  # the end of the text that goes on there
        while at < stop:
            found = np.flatnonzero(white[at : min(at + 65_536, stop)])
            if len(found):
                at += int(found[0])
                break
            at = min(at + 65_536, stop)
        if at < n:
            ends.append(at)
    return [*ends, n]


def runs(data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its text, first byte) of each run of bytes that aren't white, with A-Z as a-z.

    What this takes besides the result is bounded by the longest run and by PIECE, however long the texts are.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, starts, at = [], [], 0
    for end in _piece_ends(n, offsets, white):
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        h, start = _runs(data[at:end], edges, white[at:end])
        hashes.append(h)
        starts.append(start + at)
        at = end
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(offsets, start, "right") - 1, start


def _runs(data: np.ndarray, edges: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the runs of one piece; edges: where texts begin or end in it."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[edges] = True
    first[[0, n]] = True
    word = ~white
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[lower] * powers(BASE, n), out=total[1:])
    h = (total[end] - total[start]) * powers(INVERSE, n)[start]
    return mixed(h + (end - start).astype(np.uint64)), start


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all shingles, repeats included, in order of their text; number of its text; key of each text, n x 2).

    A text of fewer words has its whole sequence as one shingle; one without words has none. The key is a 128-bit
    hash of the word sequence.
    """
    texts = len(offsets) - 1
    h, doc = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=texts)
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    keys = np.zeros((texts, 2), np.uint64)
    if len(h):
        have = np.flatnonzero(count)
        at = (np.cumsum(count) - count)[have]
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            part = mixed(h ^ np.uint64(salt)) * powers(BASE, int(place.max()) + 1)[place]
            keys[have, k] = mixed(np.add.reduceat(part, at) + count[have].astype(np.uint64))
    full = np.maximum(count - words + 1, 0)
    begin = np.flatnonzero(place < full[doc]) if len(h) else np.zeros(0, np.int64)
    acc = np.zeros(len(begin), np.uint64)
    for k in range(words):
        acc = mixed(acc + h[begin + k] * np.uint64(2 * k + 3))
    short = np.flatnonzero((count > 0) & (count < words))
    own = np.concatenate([doc[begin], short])
    order = np.argsort(own, kind="stable")
    return np.concatenate([acc, keys[short, 0]])[order], own[order], keys


def distinct(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats inside a text, by text and hash."""
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[keep], own[keep]
