"""Elias-Fano sequences, and a trie of n-grams on top of them, in flat buffers that are read in place.

An Elias-Fano sequence keeps a sorted list of n numbers below u in about ``2 + log2(u / n)`` bits each: the low bits as
they are, the high bits in unary.  Element i is found by a select, and the successor of a number by two selects of zeros and
a binary search of the low bits between them.

A level of the trie holds the children of all nodes of the level above, in order.  A monotone sequence of pointers says where
each node's children begin.  Children are known by their word; to keep a whole level monotone, a child is stored as its word
plus the last value of the node before (so its value is relative to its context), and looked up as the successor of that
number within the node's range.  All searches take arrays of queries.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

_ONE, _SIXTY_THREE = np.uint64(1), np.uint64(63)
#: Queries of a search that run together, so that their arrays stay in the cache.
STEP = 1 << 15


#: For each byte and rank: the place of the set bit that so many set bits precede.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the bit that ``rank`` set bits precede stands in each word: halves down to a byte, then a table."""
    words, rank, at = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8):
        low = words & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = rank >= count
        rank -= count * up
        words = np.where(up, words >> np.uint64(width), low)
        at += width * up
    return at + _IN_BYTE[words.astype(np.uint8), rank]


def _or_into(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Sets bits in words; ``at`` is sorted."""
    if len(at):
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[starts]] |= np.bitwise_or.reduceat(bits, starts)


class EliasFano:
    """A sequence over three arrays of 64-bit words: sizes, low bits and high bits."""

    def __init__(self, sizes: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        self.n, self.bits = int(sizes[0]), int(sizes[1])
        self.lows, self.highs = lows, highs
        ones = np.zeros(len(highs) + 1, np.int64)
        np.cumsum(np.bitwise_count(highs), out=ones[1:], dtype=np.int64)
        self.ones, self.zeros = ones, 64 * np.arange(len(highs) + 1) - ones

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        """The arrays of a sorted list of numbers."""
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        lows = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            low = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & _SIXTY_THREE
            _or_into(lows, word, low << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            _or_into(lows, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        highs = np.zeros((n + (most >> bits)) // 64 + 2, np.uint64)
        _or_into(highs, (place >> np.uint64(6)).astype(np.int64), _ONE << (place & _SIXTY_THREE))
        return [np.array([n, bits], np.uint64), lows, highs]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & _SIXTY_THREE
        out = self.lows[word] >> shift
        # a shift by 64 is not one, so the next word moves in two steps
        out |= (self.lows[word + 1] << _ONE) << (_SIXTY_THREE - shift)
        return out & np.uint64((1 << self.bits) - 1)

    def _select(self, before: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before, i, side="right") - 1
        bits = self.highs[word]
        return 64 * word + _select_in_word(~bits if flip else bits, i - before[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        high = self._select(self.ones, i, False) - i
        return (high << self.bits) | self._low(i).astype(np.int64)

    def all(self) -> np.ndarray:
        """The whole list."""
        at = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return ((at[: self.n] - i) << self.bits) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element that is not below x, whether it is x), for a list without repeats."""
        high, low = x >> self.bits, (x & ((1 << self.bits) - 1)).astype(np.uint64)
        # zero number h ends the elements whose high part is h; beyond the last zero there are none
        last = int(self.zeros[-1])
        begin = np.where(high > 0, self._select(self.zeros, np.clip(high - 1, 0, last - 1), True) + 1, 0)
        first = begin - high
        # the elements of this high part are the ones from here to the next zero, mostly in the same word
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        zeros = ~(self.highs[np.minimum(word, len(self.highs) - 1)] >> shift)
        run = np.bitwise_count((zeros & (~zeros + _ONE)) - _ONE).astype(np.int64)
        end = first + run
        far = np.flatnonzero((run >= 64 - (begin & 63)) & (high < last))
        end[far] = self._select(self.zeros, high[far], True) - high[far]
        outside = high >= last
        first, end = np.where(outside, self.n, np.minimum(first, self.n)), np.where(outside, self.n, np.minimum(end, self.n))
        # elements crowd where a context has many words, so a bucket is halved, not scanned
        low_end, todo = end.copy(), np.flatnonzero(first < end)
        while todo.size:
            middle = (first[todo] + low_end[todo]) >> 1
            below = self._low(middle) < low[todo]
            first[todo] = np.where(below, middle + 1, first[todo])
            low_end[todo] = np.where(below, low_end[todo], middle)
            todo = todo[first[todo] < low_end[todo]]
        equal = first < end
        equal[equal] = self._low(first[equal]) == low[equal]
        return first, equal


def flat(arrays: list[np.ndarray]) -> bytes:
    """Arrays of eight-byte numbers end to end, after the number of arrays and their lengths."""
    return struct.pack(f"<{len(arrays) + 1}Q", len(arrays), *map(len, arrays)) + b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays)


def unflat(buffer) -> list[np.ndarray]:
    """The arrays as views of the buffer."""
    (count,) = struct.unpack_from("<Q", buffer)
    sizes, at, out = struct.unpack_from(f"<{count}Q", buffer, 8), 8 * (count + 1), []
    for size in sizes:
        out.append(np.frombuffer(buffer, "<u8", size, at))
        at += 8 * size
    return out


class Trie:
    """Levels of an n-gram trie.  Counts of the last levels, such as the n-grams and their contexts, are kept as their running sums."""

    def __init__(self, buffer) -> None:
        first, *rest = unflat(buffer)
        self.depth, counted = map(int, first)
        sequences = [EliasFano(*rest[i : i + 3]) for i in range(0, len(rest), 3)]
        #: Words of each level, and pointers from each level but the last to the next one.
        self.words, self.pointers, sums = sequences[: self.depth], sequences[self.depth : -counted], sequences[-counted:]
        #: Counts of the last levels.
        self.counts_of = [np.diff(s.all()) for s in sums]
        self.counts, self.context_counts = self.counts_of[-1], self.counts_of[-2] if counted > 1 else None

    @classmethod
    def map(cls, path: str) -> Trie:
        """A trie in a file, mapped into memory."""
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(grams: np.ndarray, counts: np.ndarray, context_counts: np.ndarray) -> bytes:
        """Of distinct n-grams in order (rows of words), their counts and those of their contexts (a gram each)."""
        depth, levels, above = grams.shape[1], [], np.zeros(len(grams), np.int64)
        context = np.zeros(len(grams), np.int64)
        for level in range(depth):
            new = np.ones(len(grams), bool)
            new[1:] = (above[1:] != above[:-1]) | (grams[1:, level] != grams[:-1, level])
            levels.append((above[new], grams[new, level]))
            above = np.cumsum(new) - 1
            if level == depth - 2:
                context = np.flatnonzero(new)
        return Trie.of_levels(levels, [context_counts[context], counts])

    @staticmethod
    def of_levels(levels: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray]) -> bytes:
        """Of the parent (its place in the level above) and the word of each node, in order, and the counts of the last levels.  Every
        node above the last level may lack children."""
        words, pointers = [], []
        for level, (parent, word) in enumerate(levels):
            word = word + 1
            if level:
                # the last word of each node's children, summed over all nodes before
                starts = np.searchsorted(parent, np.arange(len(levels[level - 1][0]) + 1))
                last = np.where(np.diff(starts) > 0, np.append(word, 0)[starts[1:] - 1], 0)
                word = word + (np.cumsum(last) - last)[parent]
                pointers += EliasFano.arrays(starts)
            words += EliasFano.arrays(word)
        sums = [x for c in counts for x in EliasFano.arrays(np.concatenate([[0], np.cumsum(c, dtype=np.int64)]))]
        return flat([np.array([len(levels), len(counts)], np.uint64), *words, *pointers, *sums])

    def _range(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the nodes' children in a level begin and end, and what their words are relative to."""
        begin, end = self.pointers[level - 1].get(node), self.pointers[level - 1].get(node + 1)
        base = np.zeros(len(node), np.int64)
        later = begin > 0
        base[later] = self.words[level].get(begin[later] - 1)
        return begin, end, base

    def _child(self, level: int, end: np.ndarray, base: np.ndarray, word: np.ndarray) -> np.ndarray:
        place, equal = self.words[level].successor(base + word + 1)
        return np.where(equal & (place < end), place, -1)

    def contexts(self, columns: list[np.ndarray]) -> np.ndarray:
        """Places of contexts (columns of words) in the last level but one, or -1."""
        out = np.full(len(columns[0]), -1, np.int64)
        for a in range(0, len(out), STEP):
            place, equal = self.words[0].successor(columns[0][a : a + STEP] + 1)
            node = np.where(equal, place, -1)
            for level, column in enumerate(columns[1:], 1):
                live = np.flatnonzero(node >= 0)
                _, end, base = self._range(level, node[live])
                node[live] = self._child(level, end, base, column[a : a + STEP][live])
            out[a : a + STEP] = node
        return out

    def after(self, level: int, nodes: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in a level, or -1, of words below nodes of the level above (places, or -1)."""
        out = np.full(len(word), -1, np.int64)
        for a in range(0, len(out), STEP):
            live = a + np.flatnonzero(nodes[a : a + STEP] >= 0)
            _, end, base = self._range(level, nodes[live])
            out[live] = self._child(level, end, base, word[live])
        return out

    def grams(self, contexts: np.ndarray, of: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in the last level, or -1, of words after contexts: ``of`` says which one of ``contexts`` (places) each follows."""
        known = contexts >= 0
        _, ends, bases = self._range(self.depth - 1, np.where(known, contexts, 0)) if known.any() else (None, *np.zeros((2, len(contexts)), np.int64))
        out = np.full(len(word), -1, np.int64)
        for a in range(0, len(out), STEP):
            live = a + np.flatnonzero(known[of[a : a + STEP]])
            out[live] = self._child(self.depth - 1, ends[of[live]], bases[of[live]], word[live])
        return out
