"""An n-gram language model of a corpus: counted, smoothed, kept in Elias-Fano tries, and asked for every text.

Texts are cut into words once and kept as blocks of local word numbers.  Words go to shards by their hash, which count them and
number them.  Then each block sends its distinct n-grams of all orders at once, as a tree read backwards from the last word, to
shards by their last two words; an n-gram and those that it ends in are then in one shard.  A shard merges what was learned into a
trie of the same order of words and answers the blocks from it.  N-grams whose last words are all more frequent than a shard holds
are spread by further words, by a rule of these counts alone, so every block deals alike and no shard grows with frequent words.
An n-gram with a word that no other block has is counted in its block and not sent; one with a word that no training text
has is not sent either, since its count is 0.  The count of a context is that of the n-gram that ends one token before, so the blocks
have all counts then, and smooth and quantise the probabilities of their tokens.

Smoothing interpolates with the order below (Jelinek and Mercer), with weights tied by the binary logarithm of the context's
count: a context keeps the share of its bin's tokens whose n-gram occurs once, the Good-Turing estimate of what is new.
A context that never occurs keeps everything.  The lowest order adds one to every count, with one more word for all unknown
ones.  Weights and probabilities are multiples of 1/``STEPS`` of a decimal logarithm.

Nothing is pruned, capped or sampled.  Only total counts and the bins (at most 64 rows) reach the driver.  Everything between jobs
is a table in the shared folder, so a lost executor costs its tasks.

Defined results: a null text is an empty one, which is one end; rows that share an id are each a document, learned from or not by
their id; rows with a null id are learned from; very long texts are cut in pieces between words, and one text is never in two
blocks; without training texts every word has the probability 1 of an unknown one; an empty table gives an empty result; other
columns are not read.  Sums of logarithms are of doubles, in the order of the text.
"""

from __future__ import annotations

import re
import struct
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, frugal
from shelfmark.llm.elias_fano import Trie
from shelfmark.llm.words import mix

#: The usual order of models that are kept in tries; the last orders are what tells a text that was learned from others.
ORDER = 5
#: Bytes of text in a block, and of text cut into words at a time.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Bytes of text that a shard of words stands for, and tokens that a shard of n-grams stands for.
SHARD_BYTES, SHARD_TOKENS = 16 << 20, 1 << 20
#: A quantised logarithm is a multiple of 1/STEPS.
STEPS = 256
BINS = 64
#: Differences of the words' places in a block are kept modulo this.
WRAP = 1 << 32
#: Word numbers: the beginning of a text (a context only), its end, and from FIRST on the words.
BEGIN, END, FIRST = 0, 1, 2
SPACE = re.compile(rb"[ \t-\r]")
ROW = "kind int, key bigint, block bigint, n bigint, m bigint, payload binary"


# --- packed arrays ----------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, by byte planes of the smallest type that holds them, compressed."""
    parts = []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        a = a.astype(f"<u{width}")
        parts.append(struct.pack("<BQ", width, len(a)))
        parts += [(a >> (8 * i)).astype(np.uint8).tobytes() for i in range(width)]
    body = b"".join(parts)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes, narrow: bool = False) -> list[np.ndarray]:
    """The arrays of ``pack``, of eight bytes a number or, if ``narrow``, as they were kept."""
    body = pa.decompress(blob[8:], decompressed_size=struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(body):
        width, size = struct.unpack_from("<BQ", body, at)
        planes = np.frombuffer(body, np.uint8, width * size, at + 9).reshape(width, size)
        kind = np.dtype(f"<u{width}" if narrow else np.int64)
        out.append(planes[0].astype(kind))
        for i in range(1, width):
            if planes[i].any():
                out[-1] |= planes[i].astype(kind) << kind.type(8 * i)
        at += 9 + width * size
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in ROW.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


# --- quantised logarithms ---------------------------------------------------------------------------


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log10(p) * STEPS).astype(np.int64)


def value(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code / STEPS)


def weight_of_lower(single: int, total: int) -> float:
    """What contexts of a bin leave to the order below."""
    return (single + 1) / (total + 2)


# --- words ------------------------------------------------------------------------------------------


class _Numbers(dict):
    """word -> its number in the order of first use"""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Two odd bases of polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        gap = SPACE.search(text, start + PIECE_BYTES)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def _words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words of texts end to end, the length of each, two hashes of each, and how many each text has."""
    data = _LOWER[np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)]
    inside = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
    found = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    body, offset = data[inside], np.cumsum(lengths) - lengths
    hashes = np.zeros((2, len(starts)), np.uint64)
    if len(starts):
        rank = np.arange(len(body)) - np.repeat(offset, lengths)
        terms = body.astype(np.uint64) + np.uint64(1)
        for k, base in enumerate(_BASES):
            power = np.full(int(lengths.max()), base, np.uint64)
            power[0] = 1
            hashes[k] = mix(np.add.reduceat(terms * np.multiply.accumulate(power)[rank], offset) + lengths.astype(np.uint64))
    return body, lengths, hashes, found


def _distinct(body: bytes, lengths: np.ndarray, hashes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, the word of each token): by the first hash, if the second one tells no two of its words apart."""
    ends = np.cumsum(lengths)
    slices = lambda at: [body[a:b] for a, b in zip((ends - lengths)[at].tolist(), ends[at].tolist(), strict=True)]
    values, which = np.unique(hashes[0], return_inverse=True)
    first = np.empty(len(values), np.int64)
    first[which] = np.arange(len(which))
    if (hashes[1][first][which] == hashes[1]).all():
        return slices(first), which
    numbers = _Numbers()
    which = np.fromiter((numbers[w] for w in slices(slice(None))), np.int64, len(lengths))
    return list(numbers), which


def _tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the word of each token, tokens of each text), some megabytes of text at a time."""
    parts, counts, pieces, owners, size = [], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        *part, found = _words(pieces)
        parts.append(part)
        np.add.at(counts, owners, found)
        pieces.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").encode()):
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= PIECE_BYTES:
                flush()
                size = 0
    flush()
    bodies, lengths, hashes = zip(*parts, strict=True)
    return *_distinct(np.concatenate(bodies).tobytes(), np.concatenate(lengths), np.concatenate(hashes, axis=1)), counts


def _block(ids: list, held: list, texts: list[str | None], block: int, shards: int) -> list[tuple]:
    """One row (kind 0) of a block's documents and tokens, and one of its words for each shard (kind 1)."""
    words, tokens, counts = _tokens(texts)
    shard = np.fromiter((crc32(w) % shards for w in words), np.int64, len(words))
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    tokens, held = rank[tokens], np.array(held, bool)
    # tokens are kept by the frequency of their words, which takes fewer bytes
    by_frequency = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int64)
    place[by_frequency] = np.arange(len(words))
    learned = np.repeat(~held, counts)
    n, every = np.bincount(tokens[learned], minlength=len(words)), np.bincount(tokens, minlength=len(words))
    known, ids = np.array([i is not None for i in ids], bool), np.array([i or 0 for i in ids], np.int64).view(np.uint64)
    rows = [(0, 0, block, int((counts[~held] + 1).sum()), int((~held).sum()), pack(ids, known, held, counts, np.diff(by_frequency, prepend=0) % WRAP, place[tokens]))]
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[s], edges[s + 1])
        text = np.frombuffer(b"\n".join([words[i] for i in order[own]]), np.uint8)
        rows.append((1, s, block, 0, 0, pack(n[own], every[own], text)))
    return rows


def _cut(shards: int):
    """Texts -> blocks and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        ids, held, texts, size, done, part = [], [], [], 0, 0, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            part = batch.column(3)[0].as_py() if batch.num_rows else part
            for i, h, text in zip(*columns, strict=True):
                ids.append(i)
                held.append(h)
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield _rows(_block(ids, held, texts, (part << 32) + done, shards))
                    ids, held, texts, size, done = [], [], [], 0, done + 1
        if texts:
            yield _rows(_block(ids, held, texts, (part << 32) + done, shards))

    return run


def _count_words(shards: int):
    """One shard: numbers and counts of its words, to each block in the block's order; block -1 tells how many were learned."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frugal()
        numbers, asked = _Numbers(), []
        blobs = table["payload"]
        for blob in blobs:
            n, every, text = unpack(blob.as_py())
            words = text.astype(np.uint8).tobytes().split(b"\n")
            asked.append((np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), n, every))
        n, every = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for number, some, all_ in asked:  # a block has a word once
            n[number] += some
            every[number] += all_
        shard = key[0].as_py()
        # frequent words have small numbers, which are packed better
        rank = np.empty(len(numbers), np.int64)
        rank[np.argsort(-every, kind="stable")] = np.arange(len(numbers))
        rows = [(1, shard, b, 0, 0, pack(rank[number] * shards + shard + FIRST, n[number], every[number])) for b, (number, _, _) in zip(table["block"].to_pylist(), asked, strict=True)]
        rows.append((1, shard, -1, int((n > 0).sum()), 0, None))
        return pa.Table.from_batches([_rows(rows)])

    return run


# --- n-grams ----------------------------------------------------------------------------------------


def _children(parent: np.ndarray, n: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a parent (below ``n``) and a word, in order: (the pair of each row, the parent and the word of each pair).
    Only rows of parents that have several are sorted."""
    rows = np.bincount(parent, minlength=n)
    alone = rows[parent] == 1
    several, alone = np.flatnonzero(~alone), np.flatnonzero(alone)
    bits = int(word.max(initial=0)).bit_length()
    keys, which = np.unique((parent[several] << bits) | word[several], return_inverse=True)
    of = keys >> bits
    size = (rows == 1) + np.bincount(of, minlength=n)
    begin = np.cumsum(size) - size
    # pairs of these parents stand in order, after the pairs of all parents before
    first = np.flatnonzero(np.diff(of, prepend=-1))
    at = begin[of] + np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    out, words = np.empty(len(parent), np.int64), np.empty(int(size.sum()), np.int64)
    out[alone], out[several] = begin[parent[alone]], at[which]
    words[out] = word
    return out, np.repeat(np.arange(n), size), words


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Block:
    """A block's tokens as n-grams, read backwards: a node of a level k is an n-gram of k words, and its parent is the n-gram
    without the first word.  Nodes of words that other blocks have too are sent to shards."""

    def __init__(self, blob: bytes, order: int, learned: int) -> None:
        self.order = order
        self.ids, self.known, held, counts, self.tokens, self.word, n, every, times = unpack(blob)
        self.held, self.counts = held.astype(bool), counts
        if len(self.word) and int(self.word.max()) < 1 << 31:
            self.word = self.word.astype(np.int32)
        self.tokens = self.tokens.astype(np.int32)
        ends = np.cumsum(counts)
        self.starts = ends - counts
        self.learned = np.repeat(~self.held, counts)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, counts)
        # the end and the beginning are in every block
        self.n, self.every = np.concatenate([n, [learned, learned]]), np.concatenate([every, [learned, learned]])
        self.settled = np.append(every == times, [False, False]) | (self.n == 0)

    def grow(self, answered: bool) -> None:
        """The nodes of all levels, and if they are to be ``answered``, the node of each token in each level."""
        begin, which = len(self.word) - 1, self.tokens
        self.which, self.parent, self.words, self.count = [], [None], [None], [None]
        for k in range(2, self.order + 1):
            at = np.flatnonzero(self.place >= k - 2)
            before = np.where(self.place[at] >= k - 1, self.tokens[at - k + 1], begin)
            # words are told apart, and put in order, by their numbers
            own, parent, _ = _children(which[at].astype(np.int64), len(self.word) if k == 2 else len(self.parent[-1]), self.word[before])
            # a block has few enough nodes for four bytes
            of = np.empty(len(parent), np.int32)
            of[own] = before
            which = np.full(len(self.tokens), -1, np.int32)
            which[at] = own
            if answered:
                self.which.append(which)
            self.parent.append(parent.astype(np.int32))
            self.words.append(of)
            self.count.append(np.bincount(own[self.learned[at]], minlength=len(parent)).astype(np.int32))

    def sent(self, shards: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
        """For each level that n-grams are dealt to shards by: (level, edges of the shards, columns of words of these n-grams,
        nodes of this and the further levels, numbers of their children that are sent).  N-grams go by their last two words, with
        all that end in them; where all of these are more frequent than a shard holds, by more words."""
        live, hot = ~self.settled, self.every > SHARD_TOKENS
        levels = []
        for k in range(1, self.order):
            parent, words = self.parent[k], self.words[k]
            live = live[parent] & ~self.settled[words]
            # the n-grams of two words, and those whose shorter ones were spread
            rooted = live & hot[parent] if k > 1 else live
            levels.append((live, rooted))
            hot = hot[parent] & (self.every[words] > SHARD_TOKENS)
        for k, (_, rooted) in enumerate(levels, 1):
            roots = np.flatnonzero(rooted)
            if not len(roots):
                continue
            columns, node = [], roots
            for j in range(k, 0, -1):
                columns.append(self.words[j][node])
                node = self.parent[j][node]
            columns = [node, *columns[::-1]]
            home = np.zeros(len(roots), np.uint64)
            for column in columns:
                home = mix(home * np.uint64(31) + self.word[column].astype(np.uint64) + np.uint64(1))
            shard = (home % np.uint64(shards)).astype(np.int64)
            by_shard = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
            edges = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            nodes, sizes = [roots[by_shard].astype(np.int32)], []
            for j in range(k + 1, self.order):
                parent, own = self.parent[j], levels[j - 1][0] & ~levels[j - 1][1]
                kept = np.flatnonzero(own)
                size = np.bincount(parent[kept], minlength=len(levels[j - 2][0]))
                first = np.cumsum(size) - size
                sizes.append(size[nodes[-1]].astype(np.int32))
                nodes.append(kept[_ranges(first[nodes[-1]], sizes[-1])].astype(np.int32))
            yield k + 1, edges, [c[by_shard] for c in columns], nodes, sizes

    def requests(self, shards: int) -> Iterator[tuple]:
        """(level, shard, arrays) of what is sent."""
        for level, edges, columns, nodes, sizes in self.sent(shards):
            # children of the roots of a shard stand together in each level
            cuts = [edges]
            for size in sizes:
                cuts.append(np.concatenate([[0], np.cumsum(size)])[cuts[-1]])
            columns = [self.word[c] for c in columns]
            words = [self.word[self.words[level + i - 1][x]] for i, x in enumerate(nodes)]
            counts = [self.count[level + i - 1][x] for i, x in enumerate(nodes)]
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = [slice(c[s], c[s + 1]) for c in cuts]
                first, *more = (c[own[0]] for c in columns)
                # a word's n-grams stand together
                new = np.flatnonzero(np.diff(first, prepend=-1))
                runs = np.diff(np.append(new, len(first)))
                yield level, s, pack(first[new], runs, *more, *(x[o] for x, o in zip(counts, own, strict=True)), *(x[o] for x, o in zip(sizes, own)), *(x[o] for x, o in zip(words[1:], own[1:])))

    def answer(self, shards: int, answers: dict[int, list[bytes]]) -> list[np.ndarray]:
        """For each order from 2 on: how often training texts have the n-gram that each token ends (0 where there is none)."""
        totals = [None if c is None else c.astype(np.int64) for c in self.count]
        for level, _, _, nodes, _ in self.sent(shards):
            parts = [unpack(b) for b in answers[level]]
            for i, (x, found) in enumerate(zip(nodes, zip(*parts, strict=True), strict=True)):
                totals[level + i - 1][x] = np.concatenate(found)
        out = []
        for which, total in zip(self.which, totals[1:], strict=True):
            out.append(np.append(total, 0)[which])  # tokens without an n-gram have -1
        return out


def _contexts(place: np.ndarray, n: np.ndarray, found: list[np.ndarray], learned: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 2 on: tokens that end an n-gram, its count and that of its context, which ends a token before."""
    below = n
    for k, total in enumerate(found, 2):
        at = np.flatnonzero(place >= k - 2)
        of_context = np.where(place[at] > 0, below[at - 1], learned)
        yield at, total[at], of_context
        below = total


def _number_words(learned: int):
    """One block and the answers to its words -> a row (kind 0) of its documents, its tokens by local words, and these words'
    numbers, counts in training texts and in all texts, and in the block's."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frugal()
        rows = sorted(zip(table["kind"].to_pylist(), table["key"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda r: r[:2])
        ids, known, held, counts, steps, ranks = unpack(rows[0][2])
        parts = [unpack(blob) for _, _, blob in rows[1:]]
        word, n, every = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(3))
        # words stay in the order of their frequency
        by_frequency = np.cumsum(steps) % WRAP
        times, counts = np.bincount(ranks, minlength=len(word)), counts + 1
        ends = np.cumsum(counts)
        tokens, inner = np.full(int(ends[-1]), len(word), np.int64), np.ones(int(ends[-1]), bool)
        inner[ends - 1] = False
        tokens[inner] = ranks
        numbers = np.concatenate([word[by_frequency], [END, BEGIN]])
        return pa.Table.from_batches([_rows([(0, 0, key[0].as_py(), 0, 0, pack(ids.view(np.uint64), known, held, counts, tokens, numbers, n[by_frequency], every[by_frequency], times))])])

    return run


def _ask(order: int, shards: int, learned: int):
    """Blocks -> their n-grams, packed for each shard (kind: the level that they are dealt by)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for number, blob in zip(batch.column(2).to_pylist(), batch.column(5), strict=True):
                block = _Block(blob.as_py(), order, learned)
                block.grow(answered=False)
                rows = [(level, s, number, 0, 0, packed) for level, s, packed in block.requests(shards)]
                del block
                if rows:
                    yield _rows(rows)

    return run


def _count_grams(order: int):
    """One shard: tries of the n-grams that training texts have, with their counts, which answer the blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frugal()
        kinds, rows = table["kind"].to_numpy(), []
        for level in np.unique(kinds).tolist():
            own = table.filter(pa.array(kinds == level))
            answers = _merge([unpack(b.as_py(), narrow=True) for b in own["payload"]], level, order)
            rows += [(level, key[0].as_py(), block, 0, 0, answer) for block, answer in zip(own["block"].to_pylist(), answers, strict=True)]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _merge(requests: list[list[np.ndarray]], level: int, order: int) -> list[bytes]:
    """Answers to requests of a level: n-grams that a request learned are merged into the trie, level by level, which gives
    their places; those that it only asks for are searched there."""
    deep = order - level
    # children and counts are few in a request, so they take four bytes
    kinds = [np.int64] * level + [np.int32] * (2 * deep + 1) + [np.int64] * deep
    joined = [np.concatenate(c, dtype=kind, casting="unsafe") for kind, c in zip(kinds, zip(*([np.repeat(first, runs), *rest] for first, runs, *rest in requests), strict=True), strict=True)]
    sizes_of = [[len(c) for c in r[1 + level : 2 + level + deep]] for r in requests]
    requests.clear()
    columns, counts = joined[:level], joined[level : level + deep + 1]
    children, words = joined[level + deep + 1 : level + 2 * deep + 1], joined[level + 2 * deep + 1 :]
    learned = np.flatnonzero(counts[0])
    parent, n, levels, totals, places = np.zeros(len(learned), np.int64), 1, [], [], []
    for column in columns:
        parent, of, word = _children(parent, n, column[learned])
        levels.append((of, word))
        n = len(word)
    for i, count in enumerate(counts):
        if i:
            above = np.repeat(np.arange(len(counts[i - 1])), children[i - 1])
            learned = np.flatnonzero(count)
            parent, of, word = _children(places[-1][above[learned]], n, words[i - 1][learned])
            levels.append((of, word))
            n = len(word)
        places.append(np.full(len(count), -1, np.int64))
        places[-1][learned] = parent
        totals.append(np.bincount(parent, weights=count[learned], minlength=n).astype(np.int64))
    trie = Trie(Trie.of_levels(levels, totals))
    out = []
    for i, (count, place) in enumerate(zip(counts, places, strict=True)):
        asked = np.flatnonzero(count == 0)
        if not i:
            place[asked] = trie.contexts([c[asked] for c in columns])
        else:
            above = np.repeat(np.arange(len(counts[i - 1])), children[i - 1])[asked]
            place[asked] = trie.after(level + i - 1, places[i - 1][above], words[i - 1][asked])
        found, hit = np.zeros(len(place), np.int64), place >= 0
        found[hit] = trie.counts_of[i][place[hit]]
        out.append(np.split(found, np.cumsum([s[i] for s in sizes_of])[:-1]))
    return [pack(*arrays) for arrays in zip(*out, strict=True)]


def _bin(count: np.ndarray) -> np.ndarray:
    """The bin of contexts with these counts."""
    return np.frexp(np.maximum(count, 1))[1] - 1


def _collect(order: int, shards: int, learned: int):
    """One block with all answers -> its row (kind 0) with the counts of each token's n-grams, and sums by order (kind) and bin of
    context (key): n-grams that occur once, and all occurrences.  An n-gram that occurs once is at one token, so tokens are summed."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frugal()
        answers: dict[int, list[bytes]] = {}
        for kind, _, blob in sorted(zip(table["kind"].to_pylist(), table["key"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda r: r[:2]):
            answers.setdefault(kind, []).append(blob)
        block = _Block(answers[0][0], order, learned)
        block.grow(answered=True)
        found, rows = block.answer(shards, answers), []
        for k, (at, total, of_context) in enumerate(_contexts(block.place, block.n[block.tokens], found, learned), 2):
            own = block.learned[at]
            bins = _bin(of_context[own])
            single, every = np.bincount(bins[total[own] == 1], minlength=BINS), np.bincount(bins, minlength=BINS)
            rows += [(k, i, -1, int(single[i]), int(every[i]), None) for i in np.flatnonzero(every).tolist()]
        rows.append((0, 0, key[0].as_py(), 0, 0, pack(block.ids.view(np.uint64), block.known, block.held, block.counts, block.tokens, block.n, *found)))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _sum_up(sizes: tuple[int, int, int], weights: dict[int, np.ndarray]):
    """Blocks with all counts -> their documents' scores, by smoothed and quantised probabilities."""
    total, vocabulary, learned = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for blob in batch.column(0):
                ids, known, held, counts, tokens, n, *found = unpack(blob.as_py())
                starts = np.cumsum(counts) - counts
                place = np.arange(len(tokens)) - np.repeat(starts, counts)
                single = (n + 1) / (total + vocabulary + 1)
                code, of_word = quantise(single)[tokens], n[tokens]
                for k, (at, count, of_context) in enumerate(_contexts(place, of_word, found, learned), 2):
                    bins, lower = _bin(of_context), code[at]
                    code[at] += np.where(of_context > 0, quantise(weights[k])[bins], 0)
                    hit = np.flatnonzero(count)
                    left, values = weights[k][bins[hit]], value(np.arange(int(lower.max(initial=0)) + 1))
                    code[at[hit]] = quantise((1 - left) * count[hit] / of_context[hit] + left * values[lower[hit]])
                columns = {
                    "id": pa.array(ids.astype(np.int64), pa.int64(), mask=known == 0),
                    "held_out": held.astype(bool),
                    "n_tokens": counts,
                    "n_known": np.add.reduceat((of_word > 0).astype(np.int64), starts),
                    "base_score": np.add.reduceat(np.log10(single)[tokens], starts),
                    "score": -np.add.reduceat(code, starts) / STEPS,
                }
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    return run


def scores(df: DataFrame, order: int = ORDER, held=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score (single words) and score (the model's log10
    probability).  ``held`` is a column: documents it is true of are not learned from."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    scratch = Scratch(df.sparkSession)
    hidden = F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % 7) == 2, F.lit(False)) if held is None else held
    docs = df.select(F.col(id_col).cast("long").alias("id"), hidden.alias("held"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    cut = scratch.keep(docs.select("id", "held", "text", F.spark_partition_id().alias("part")).mapInArrow(_cut(shards), ROW), by="kind")
    blocks, words = cut.where("kind = 0"), cut.where("kind = 1")
    total, learned = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    answered = scratch.keep(words.groupBy("key").applyInArrow(_count_words(shards), ROW))
    scratch.drop(cut, "kind=1")
    vocabulary = (answered.where("block < 0").agg(F.sum("n")).first()[0] or 0) + (learned > 0)
    # a block's words and their answers are one row, which no later step shuffles but the last one
    numbered = scratch.keep(blocks.unionByName(answered.where("block >= 0")).groupBy("block").applyInArrow(_number_words(learned), ROW))
    scratch.drop(cut, "kind=0")
    scratch.drop(answered)
    clean = df.sparkSession._jvm.System.gc  # lets go of the shuffle files of a step before the next one writes its own
    clean()
    shards = 1 + size // (8 * SHARD_TOKENS)
    # no name holds the requests, so that their shuffle files can go
    found = scratch.keep(numbered.mapInArrow(_ask(order, shards, learned), ROW).groupBy("key").applyInArrow(_count_grams(order), ROW))
    clean()
    counted = scratch.keep(numbered.unionByName(found).groupBy("block").applyInArrow(_collect(order, shards, learned), ROW))
    scratch.drop(numbered)
    scratch.drop(found)
    clean()
    weights = {k: np.ones(BINS) for k in range(2, order + 1)}
    for row in counted.where("block < 0").groupBy("kind", "key").agg(F.sum("n").alias("single"), F.sum("m").alias("total")).collect():
        weights[row["kind"]][row["key"]] = weight_of_lower(row["single"], row["total"])
    rows = counted.where("kind = 0").select("payload").mapInArrow(_sum_up((total, vocabulary, learned), weights), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return rows.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
