"""Words and word shingles of many texts at once, as numpy arrays over their bytes.

A word is a run of letters A-Z (as a-z), digits and non-ASCII characters.  Its hash is a polynomial of
its bytes modulo 2**64, mixed; a shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: A block's arrays take some fifty times its bytes.
BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    if starts.size == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    length = ends - starts
    bytes_in = np.flatnonzero(inside)
    offset = np.cumsum(length) - length
    power = _powers(int(length.max()))
    rank = np.arange(bytes_in.size) - np.repeat(offset, length)
    terms = (data[bytes_in].astype(np.uint64) + np.uint64(1)) * power[rank]
    hashes = mix(np.add.reduceat(terms, offset) + length.astype(np.uint64) * _STEP)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, counts


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words of one sequence; one of all words if there are fewer."""
    if words.size == 0:
        return words
    size = min(size, words.size)
    out = np.zeros(words.size - size + 1, np.uint64)
    for k in range(size):
        out = out * _STEP + words[k : words.size - size + 1 + k]
    return mix(out)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``counts`` elements laid end to end: the row of each element, and its place there."""
    row = np.repeat(np.arange(counts.size), counts)
    return row, np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)


def all_shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many texts laid end to end, and the number of shingles of each text.  A text of
    fewer words than ``size``, but some, has one shingle of all its words."""
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row, place = ragged(number)
    begin = (np.cumsum(counts) - counts)[row] + place
    out = np.zeros(row.size, np.uint64)
    short = np.minimum(counts, size)[row]
    for k in range(size):
        live = k < short
        nxt = out * _STEP
        nxt += words[np.where(live, begin + k, 0)] if words.size else np.uint64(0)
        out = np.where(live, nxt, out)
    return mix(out), number
