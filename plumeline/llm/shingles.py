"""Words, five-word shingles and MinHash values of many texts at once, with numpy inside a task.

A word is a maximal run of bytes other than the six ASCII white-space characters. All hashing is on the UTF-8 bytes, so no
Python object is made for a word. A chunk of texts is worked on together; the chunk size bounds the memory, but
for a single longer text, which is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK_BYTES = 1 << 17
U64 = np.uint64
SET_BITS = 44  # of a shingle's hash that are kept beside the number of its text in a chunk

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _random.integers(1, 1 << 63, WORDS, dtype=U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE, CHUNK_BYTES), _powers(_INVERSE, CHUNK_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that lie one after another in `data`, text i from `starts[i]` to `starts[i + 1]`.

    Returns each word's hash, its text's number, and its first and last byte's place.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none, none, none
    up, down = (_up, _down) if n <= CHUNK_BYTES else (_powers(_BASE, n), _powers(_INVERSE, n))
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:]))
    total = np.cumsum(_BYTE[data] * up[:n])
    lower = np.where(first > 0, total[first - 1], U64(0))
    hashes = mix((total[last] - lower) * down[first])
    return hashes, np.searchsorted(starts, first, side="right") - 1, first, last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, for hashes of runs from differences of sums."""
    return (_up[:n], _down[:n]) if n <= CHUNK_BYTES else (_powers(_BASE, n), _powers(_INVERSE, n))


def _chunks(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(starts) - 1
    while at < n:
        end = int(np.searchsorted(starts, starts[at] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts (one more entry at the end). A null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def words_of(column: pa.Array) -> Iterator[tuple]:
    """For chunks of a string column: the number of the first text, the chunk's bytes, where its texts start, and what `word_hashes` returns."""
    data, starts = text_bytes(column)
    for low, high in _chunks(starts):
        chunk, part = data[starts[low] : starts[high]], starts[low : high + 1] - starts[low]
        yield low, chunk, part, *word_hashes(chunk, part)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of a string column: the number of the first text, the distinct shingles of all the chunk's texts, text
    after text and sorted within one, and where each text's start (one more entry at the end).

    A text of one to four words has one shingle, all its words; a text without words has none.
    """
    data, starts = text_bytes(column)
    for low, high in _chunks(starts):
        part = starts[low : high + 1] - starts[low]
        hashes, text, _, _ = word_hashes(data[starts[low] : starts[high]], part)
        yield low, *_distinct(hashes, text, high - low)


def _distinct(hashes: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    counts = np.bincount(text, minlength=n_texts)
    if n >= WORDS:
        whole = text[: n - WORDS + 1] == text[WORDS - 1 :]
        joined = np.zeros(n - WORDS + 1, dtype=U64)
        for k in range(WORDS):
            joined += hashes[k : n - WORDS + 1 + k] * _PLACE[k]
        joined, owner = mix(joined[whole]), text[: n - WORDS + 1][whole]
    else:
        joined, owner = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        place = np.arange(n) - begin[text]
        few = counts[text] < WORDS
        sums = np.zeros(n_texts, dtype=U64)
        np.add.at(sums, text[few], hashes[few] * _PLACE[place[few]])
        joined = np.concatenate((joined, mix(sums[short] + counts[short].astype(U64))))
        owner = np.concatenate((owner, short))
    keyed = np.sort((owner.astype(U64) << U64(SET_BITS)) | (joined >> U64(64 - SET_BITS)))
    keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))] if len(keyed) else keyed
    bounds = np.searchsorted(keyed, np.arange(n_texts + 1, dtype=U64) << U64(SET_BITS))
    return keyed & U64((1 << SET_BITS) - 1), bounds


def minhash(sets: np.ndarray, bounds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, one row per text and one column per factor; a text without shingles gets zeros.

    The 16 bits are mixed from the smallest 64-bit product, so that large sets do not meet by small values."""
    n = len(bounds) - 1
    out = np.zeros((n, len(factors)), dtype=np.uint16)
    has = np.flatnonzero(bounds[1:] > bounds[:-1])
    at = 0
    while at < len(has):
        end = int(np.searchsorted(bounds[has + 1], bounds[has[at]] + 16384, side="right"))
        end = min(max(end, at + 1), len(has))
        rows = has[at:end]
        x = mix(sets[bounds[rows[0]] : bounds[rows[-1] + 1]])
        begin = bounds[rows] - bounds[rows[0]]
        for k, factor in enumerate(factors):
            least = np.minimum.reduceat(x * factor, begin)
            out[rows, k] = (mix(least) >> U64(48)).astype(np.uint16)
        at = end
    return out


def factors(n: int, seed: int) -> np.ndarray:
    """Odd multipliers of `n` hash functions."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The sizes of all intersections of some sets, by products of 0/1 blocks of `columns` shingles."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    owner, place = owner[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    out = np.zeros((n, n), dtype=np.int64)
    if len(place):
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for low in range(0, int(place[-1]) + 1, columns):
            a, b = np.searchsorted(place, (low, low + columns))
            block = np.zeros((n, min(columns, int(place[b - 1]) - low + 1)), dtype=np.float32)
            block[owner[a:b], place[a:b] - low] = 1
            out += (block @ block.T).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out
