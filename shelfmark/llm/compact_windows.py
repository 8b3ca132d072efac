"""Repeated passages: compact windows over token min-hashes.

Tokens are the five-word shingles of a text; grams of fifteen words (three shingles) are hashed.  The node of a
text's Cartesian tree over the hashes with root c and range [l, r] is a compact window: every stretch inside it that
covers c has the min-hash of gram c.  Windows of fewer than GRAMS grams are left out, so about 2 / 12 of the grams stay.
Windows of two texts meet if their roots are the same gram.  That alone would gather every text that holds a common
line of 25 words, so windows that meet are joined with further hashes: for each root and side, HASHES min-hashes of the
shingles BAND behind (or before) the gram.  A key is a root with one of these; texts that share 30 words or fewer
have none in common.  A passage that is repeated word for word holds a root whose band lies inside as well.

Texts with the same words are one class, which goes on as its smallest id; the copies repeat it as a whole.  In every
group of a key all windows are first compared with that of the smallest id, the leader: stretches over the root, on its
diagonal, are candidates.  They are verified on the shingle sequences of both texts: a stretch of MIN_WORDS words
repeats another if their shingle sets have a Jaccard similarity of 0.8 or more, where edits may shift the text by up to
SHIFT words.  A window is settled when root and band lie in one verified stretch of its text.  Every other window is then
compared with all windows of its key, in blocks.

A stretch of 46 shingles with similarity 0.8 has at most five that match nothing.  A changed, added or dropped word inside
breaks four or five in a row, so that there is one such place, and a run of RUN = 21 shingles stays whole (words that
repeat themselves aside).  Such a run holds GRAMS = 11 grams, and the smallest of them is a root in both texts.

Defined results: null and empty texts, and texts of fewer than MIN_WORDS words, have no passages; rows that share an
id count as the smallest text of that id; rows with a null id are not compared; of equal hashes (ties) the leftmost is the
root; a very long text is one sequence, whose memory grows with it; each input row gives one output row; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, cut, frugal
from shelfmark.llm.words import SHINGLE, all_shingles, blocks, mix, word_hashes

MIN_WORDS = 50
SPAN = MIN_WORDS - SHINGLE + 1  # shingles of a passage
SIMILARITY = 0.8
SHIFT = 5
#: Shingles of a gram, from its first; equal shingles on one side of an edit, and the grams of them.
CONTEXT = (5, 10)
RUN = 21
GRAMS = RUN - CONTEXT[-1]
#: Min-hashes of each side of a root, and the shingles that they are of, from the gram's end (or its start).
HASHES, BAND = 2, (15, 25)
#: Windows of a key in a block of that comparison, and the shingles around a root that a stretch over it can touch.
BLOCK = 1024
REACH = SPAN - 1 + SHIFT
#: Of polynomial hashes modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Ids of documents to verify are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def _sliding(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = reduce(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return reduce(out[: out.size - rest], out[rest:]) if rest else out


def compact_windows(values: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree nodes that cover ``span`` values or more.  Zeros separate sequences;
    of equal values the leftmost is the root."""
    if values.size < span:
        none = np.empty(0, np.int64)
        return none, none, none
    least = _sliding(values, span, np.minimum)
    padded = np.zeros(least.size + 2 * (span - 1), values.dtype)
    padded[span - 1 : span - 1 + least.size] = least
    root = np.flatnonzero((_sliding(padded, span, np.maximum) == values) & (values > 0))
    tables = [values]
    while tables[-1].size > 1 << len(tables) - 1 and len(tables) < 32:
        step = 1 << len(tables) - 1
        grown = np.minimum(tables[-1][:-step], tables[-1][step:])
        if not grown.any():
            break  # every longer stretch holds a separator
        tables.append(grown)
    low, high, own = root.copy(), root + 1, values[root]
    for level in range(len(tables) - 1, -1, -1):
        step, table = 1 << level, tables[level]
        at = low - step
        ok = at >= 0
        ok[ok] = table[at[ok]] > own[ok]
        low = np.where(ok, at, low)
        ok = high < table.size
        ok[ok] = table[high[ok]] >= own[ok]
        high = np.where(ok, high + step, high)
    wide = high - low >= span
    return low[wide], root[wide], high[wide] - 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (key, id, place): the gram and the place of the root of each window."""
    frugal()
    for batch in batches:
        texts, ids = [t or b"" for t in batch.column(1).to_pylist()], batch.column(0).to_numpy()
        for a, b in blocks(texts):
            words, counts = word_hashes(texts[a:b])
            shingles, number = all_shingles(words, counts)
            # one zero before, between and after the sequences, and where no whole gram begins
            owner = np.repeat(np.arange(b - a), number)
            where = np.arange(shingles.size) + owner + 1
            begin = np.cumsum(number) - number + np.arange(b - a) + 1
            whole = where + CONTEXT[-1] < (begin + number)[owner]
            first, start = np.flatnonzero(whole), where[whole]
            key = shingles[first]
            for step in CONTEXT:
                key = mix(key * np.uint64(31) + shingles[first + step])
            line = np.zeros(shingles.size + b - a + 1, np.uint64)
            line[start] = key | np.uint64(1)
            of = np.zeros(line.size, np.int64)
            of[where] = owner
            root = compact_windows(line, GRAMS)[1]
            doc = of[root]
            columns = [line[root].view(np.int64), ids[a:b][doc], (root - begin[doc]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "place"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (id, shingle sequence, packed): 32 bits of each hash, which decide by place, not by set."""
    frugal()
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts):
            shingles, number = all_shingles(*word_hashes(texts[a:b]))
            edges = (np.concatenate([[0], np.cumsum(number)]) * 4).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer((shingles >> np.uint64(32)).astype(np.uint32).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], packed], names=["id", "shingles"])


def repeated_spans(source: np.ndarray, text: np.ndarray, places: list[tuple[int, int, int]], span: int = SPAN, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Word spans [start, end) of ``text`` that repeat ``source``, given (diagonal, low, high) candidates
    in positions of ``text`` (position in text minus position in source is the diagonal)."""
    need = int(np.ceil(similarity * 2 * span / (1 + similarity) - 1e-9))
    covered, matched = np.zeros(text.size + 1, np.int64), np.zeros(text.size, bool)
    for diagonal, low, high in places:
        low, high = max(low - SHIFT, 0), min(high + SHIFT, text.size - 1)
        part = text[low : high + 1]
        if part.size < span:
            continue
        equal = np.zeros(part.size, bool)
        for other in range(diagonal - SHIFT, diagonal + SHIFT + 1):  # where a diagonal meets the source
            begin, stop = max(low, other), min(high + 1, source.size + other)
            if begin < stop:
                equal[begin - low : stop - low] |= part[begin - low : stop - low] == source[begin - other : stop - other]
        matched[low : high + 1] |= equal
        total = np.concatenate([[0], np.cumsum(equal)])
        starts = np.flatnonzero(total[span:] - total[:-span] >= need) + low
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + span, -1)
    inside = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(covered[:-1]) > 0, [0]]).astype(np.int8)))
    out = []
    for s, e in zip(inside[::2].tolist(), inside[1::2].tolist(), strict=True):
        own = np.flatnonzero(matched[s:e])  # words at the ends that match nothing are not repeated
        out.append((s + int(own[0]), s + int(own[-1]) + SHINGLE))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frugal()
    for batch in batches:
        sources, repeats, starts, ends = [], [], [], []
        at, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values
        places = list(zip(*(flat.field(c).to_numpy().tolist() for c in ("diagonal", "low", "high"))))
        pairs = zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), at[:-1].tolist(), at[1:].tolist(), strict=True)
        for a, b, x, y, begin, stop in pairs:
            found = repeated_spans(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), places[begin:stop])
            for s, e in found:
                sources.append(a)
                repeats.append(b)
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(sources, pa.int64()), pa.array(repeats, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["source", "id", "start", "end"])


def _padded(packed: bytes) -> np.ndarray:
    """A text's shingles with zeros on both sides, so that the 2 * REACH + 1 from a place on are those around it."""
    return np.concatenate([np.zeros(REACH, np.uint32), np.frombuffer(packed, np.uint32), np.zeros(REACH + 1, np.uint32)])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keys, places, opens, shingles) -> (key, id, place, open, alike): a number for the shingles around each root."""
    frugal()
    for batch in batches:
        for i, keys, places, opens, packed in zip(*(batch.column(c) for c in ("id", "keys", "places", "opens", "shingles")), strict=True):
            line, places = mix(_padded(packed.as_py()).astype(np.uint64) + np.uint64(1)), places.values.to_numpy()
            # a polynomial of the shingles around a root, as a difference of sums divided by its first power
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(line.size, BASE)]))
            back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(line.size, INVERSE)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(line * power[:-1])])
            alike = mix((sums[places + 2 * REACH + 1] - sums[places]) * back[places]).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys.values, pa.array(np.full(places.size, i.as_py())), pa.array(places), opens.values, pa.array(alike, pa.int64())], names=["key", "id", "place", "open", "alike"])


def _locals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, rows, shingles) -> one row for each of a text's rows, with the shingles around its root."""
    frugal()
    for batch in batches:
        for low, rows, packed in zip(*(batch.column(c) for c in ("low", "rows", "shingles")), strict=True):
            rows, around = rows.values, np.lib.stride_tricks.sliding_window_view(_padded(packed.as_py()), 2 * REACH + 1)
            place = rows.field("place").to_numpy()
            for at in range(0, len(rows), 4096):
                part = rows.slice(at, 4096)
                local = around[place[at : at + 4096]]
                edges = np.arange(len(part) + 1, dtype=np.int32) * (4 * local.shape[1])
                binary = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(edges), pa.py_buffer(local.tobytes())])
                names = ["key", "alike", "high", "open", "block", "own"]
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in names), pa.array(np.full(len(part), low.as_py())), binary], names=[*names, "low", "local"])


def _alike(texts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which rows of surroundings repeat ``text`` over some stretch, by the test of ``repeated_spans``."""
    need = int(np.ceil(SIMILARITY * 2 * SPAN / (1 + SIMILARITY) - 1e-9))
    equal = np.zeros(texts.shape, bool)
    for shift in range(-SHIFT, SHIFT + 1):
        low, high = max(-shift, 0), text.size - max(shift, 0)
        equal[:, low:high] |= texts[:, low + shift : high + shift] == text[low:high]
    equal &= text != 0
    total = np.zeros((len(texts), text.size + 1), np.int16)
    np.cumsum(equal, axis=1, dtype=np.int16, out=total[:, 1:])
    return (total[:, SPAN:] - total[:, :-SPAN] >= need).any(axis=1)


def _run(texts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Equal shingles in a row around the root, RUN on each side at most."""
    near = slice(REACH - RUN + 1, REACH + RUN)
    other = np.ones((len(texts), 2 * RUN + 1), bool)
    other[:, 1:-1] = (texts[:, near] != text[near]) | (text[near] == 0)
    return other[:, RUN:].argmax(axis=1) + other[:, RUN::-1].argmax(axis=1) - 1


def _hits(near: np.ndarray, local: np.ndarray, text: np.ndarray) -> Iterator[int]:
    """The rows among ``near`` that ``text`` repeats, in order; most often the first ones do, so a few are compared at a time."""
    begin, size = 0, 4
    while begin < near.size:
        part = near[begin : begin + size]
        yield from part[_alike(local[part], text)].tolist()
        begin, size = begin + size, size * 8


def _in_runs(group: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Rows that share RUN shingles over the root with another row of their group."""
    shared = np.zeros(len(local), bool)
    first = REACH - RUN + CONTEXT[-1] + 1
    line = mix(local[:, first : REACH + RUN].astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(local), line.shape[1] + 1), np.uint64)
    for k in range(line.shape[1]):  # hashes of prefixes; a run's is a difference of two
        sums[:, k + 1] = sums[:, k] * BASE + line[:, k]
    power = np.uint64(pow(int(BASE), RUN, 1 << 64))
    of = mix(group.astype(np.uint64) + np.uint64(1))
    for start in range(REACH - first + 1):
        key = mix(sums[:, start + RUN] - sums[:, start] * power + of)
        _, row, count = np.unique(key, return_inverse=True, return_counts=True)
        shared |= count[row.ravel()] > 1
    return shared


def _can_repeat(group: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Rows with a stretch of surroundings that could repeat another row of their group: enough of its shingles
    stand anywhere else in the group."""
    need = int(np.ceil(SIMILARITY * 2 * SPAN / (1 + SIMILARITY) - 1e-9))
    # counted by a hash: values that fall together can only let a row pass
    bits = max(16, int(local.size).bit_length() + 2)
    slot = (mix(local + (group.astype(np.uint64)[:, None] << np.uint64(32))) >> np.uint64(64 - bits)).astype(np.int64)
    many = np.bincount(slot.ravel(), minlength=1 << bits) > 1
    total = np.zeros((len(local), local.shape[1] + 1), np.int32)
    np.cumsum(many[slot] & (local != 0), axis=1, out=total[:, 1:])
    return (total[:, SPAN:] - total[:, :-SPAN] >= need).any(axis=1)


def _pair_up(low: np.ndarray, high: np.ndarray, own: np.ndarray, wanted: np.ndarray, local: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, source, start, end) of each wanted class of equal surroundings, and of the smallest id of the block's own
    that it repeats."""
    order = np.argsort(low, kind="stable")
    low, high, own, wanted, local = low[order], high[order], own[order], wanted[order], local[order]
    mine = np.flatnonzero(own)
    smaller = np.searchsorted(low[mine], high)
    for y in np.flatnonzero(wanted).tolist():
        others = mine[: smaller[y]]
        near = others[_run(local[others], local[y]) >= RUN]  # a stretch that repeats has such a run, which has a root
        text = np.flatnonzero(local[y])
        for x in _hits(near, local, local[y]):
            source = np.flatnonzero(local[x])
            a, b = int(source[0]), int(text[0])
            found = repeated_spans(local[x][a : source[-1] + 1], local[y][b : text[-1] + 1], [(a - b, 0, int(text[-1]) - b)])
            for s, e in found:
                yield int(order[y]), int(low[x]), b + s - REACH, b + e - REACH
            if found:
                break


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes by blocks of a key, those of a block next to each other -> (key, alike, source, start, end), from the root."""
    frugal()
    held: list[pa.RecordBatch] = []

    def marks(batch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "block")], axis=1)

    def spans(table: pa.Table) -> pa.RecordBatch:
        of = marks(table)
        local = np.frombuffer(b"".join(table["local"].to_pylist()), np.uint32).reshape(len(of), -1)
        group = np.concatenate([[0], np.cumsum((of[1:] != of[:-1]).any(axis=1))])
        low, high, key, alike, wanted, own = (table[c].to_numpy() for c in ("low", "high", "key", "alike", "open", "own"))
        wanted = wanted.astype(bool) & (_can_repeat(group, local) | (low < high))
        some = np.zeros(int(group.max()) + 1, bool)
        some[group[wanted]] = True
        rest = np.flatnonzero(some[group])
        open_ = rest[_in_runs(group[rest], local[rest]) | (low < high)[rest]]
        edge = np.flatnonzero(np.diff(group[open_], prepend=-1, append=-1)).tolist()
        rows = []
        for a, b in zip(edge, edge[1:]):
            at = open_[a:b]
            for y, *found in _pair_up(low[at], high[at], own[at].astype(bool), wanted[at], local[at]):
                rows.append((key[at[y]], alike[at[y]], *found))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "alike", "source", "from", "to"])

    for batch in batches:
        if not batch.num_rows:
            continue
        of = marks(batch)
        last = int(np.flatnonzero((of != of[-1]).any(axis=1)).max(initial=-1)) + 1  # the last block may go on in the next batch
        if last:
            yield spans(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and (marks(held[-1])[-1] != of[0]).any():
            yield spans(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield spans(pa.Table.from_batches(held))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, places, shingles) -> (key, id, place, low, high): keys of each root, and the shingles from the first to the
    last that a key is made of, counted from the root."""
    frugal()
    near, far = BAND
    for batch in batches:
        for i, places, packed in zip(*(batch.column(c) for c in ("id", "places", "shingles")), strict=True):
            text = np.frombuffer(packed.as_py(), np.uint32).astype(np.uint64)
            places = places.values.to_numpy().astype(np.int64)
            gram = text[places]
            for step in CONTEXT:
                gram = mix(gram * np.uint64(31) + text[places + step])
            found = []
            for k in range(HASHES):
                value = mix(text ^ np.uint64(k + 1 << 40))
                least = _sliding(value, far - near + 1, np.minimum) if text.size > far - near else value[:0]
                for side, at in ((0, places - far), (1, places + CONTEXT[-1] + near)):
                    ok = np.flatnonzero((at >= 0) & (at < least.size))
                    at, root = at[ok], places[ok]
                    where = np.zeros(at.size, np.int64)
                    for step in range(far - near, -1, -1):
                        where = np.where(value[at + step] == least[at], at + step, where)
                    key = mix(gram[ok] * np.uint64(31) + least[at] + np.uint64(2 * k + side))
                    low, high = (root * 0, where - root) if side else (where - root, root * 0 + CONTEXT[-1])
                    found.append((key.view(np.int64), root, low, high))
            columns = [np.concatenate(c) for c in zip(*found)]
            key, root, low, high = (pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int16(), pa.int16()), strict=True))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(key), i.as_py())), root, low, high], names=["key", "id", "place", "low", "high"])


def _shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the keys of two or more documents, with the first place of the smallest one (its leader).  The keys are a
    table of their own, so that adaptive execution can split the join on a hot one."""
    lead = F.min(F.struct("id", "place")).alias("lead")
    ends = rows.groupBy("key").agg(lead, F.max("id").alias("last")).where("lead.id < last")
    ends = scratch.keep(ends.select("key", F.col("lead.id").alias("source"), F.col("lead.place").alias("theirs")))
    return rows.join(ends, "key")


def _still_open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows whose root and band do not lie in one verified stretch of the text."""
    spans = _intervals(found.select("id", "start", "end"), "id").groupBy(F.col("id").alias("i")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    first, last = F.col("place") + F.col("low"), F.col("place") + F.col("high") + SHINGLE
    settled = F.exists("spans", lambda s: (first >= s["start"]) & (last <= s["end"]))
    return rows.join(spans, F.col("id") == F.col("i"), "left").where(~F.coalesce(settled, F.lit(False))).drop("i", "spans")


def _verified(joined: DataFrame, sequences: DataFrame) -> DataFrame:
    """Spans (source, id, start, end) of windows against the first place of their key."""
    low, high = F.col("place") - (SPAN - 1), F.col("place") + (SPAN - 1)
    pairs = (
        joined.select("source", "id", (F.col("place") - F.col("theirs")).alias("diagonal"), low.alias("low"), high.alias("high"))
        .groupBy("source", "id", "diagonal")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .groupBy("source", "id")
        .agg(F.sort_array(F.collect_list(F.struct("diagonal", "low", "high"))).alias("places"))
    )
    with_source = pairs.join(sequences.select(F.col("id").alias("source"), F.col("shingles").alias("x")), "source")
    both = with_source.join(sequences.select("id", F.col("shingles").alias("y")), "id")
    return both.select("source", "id", "places", "x", "y").mapInArrow(_verify, "source bigint, id bigint, start int, end int")


def _intervals(spans: DataFrame, *by: str) -> DataFrame:
    """Spans of the same columns ``by`` that overlap or touch become one."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("before", before).withColumn("part", part).groupBy(*by, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def _all_places(windows: DataFrame, sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of open windows against all others of their key.  Windows with the same surroundings form a class, compared
    once; classes of a key lie in blocks, and open ones are sent to each block."""
    shared = windows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    window = F.collect_list(F.struct("key", "place", "open")).alias("w")
    of_text = windows.join(shared, "key", "left_semi").groupBy("id").agg(window).select("id", F.col("w.key").alias("keys"), F.col("w.place").alias("places"), F.col("w.open").alias("opens"))
    members = scratch.keep(of_text.join(sequences, "id").mapInArrow(_surroundings, "key bigint, id bigint, place int, open boolean, alike bigint"))
    classes = members.groupBy("key", "alike").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("place", "id").alias("place"), F.max("open").alias("open"))
    count = classes.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = scratch.keep(classes.join(count, "key").withColumn("block", F.pmod("alike", F.col("blocks")).cast("int")))
    # every class stands in its own block; only open ones also visit the others
    base = rows.select("key", "alike", "low", "high", "place", "open", "block", F.lit(True).alias("own"))
    away = rows.where("open and blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    dealt = base.unionByName(away.select("key", "alike", "low", "high", "place", "open", F.col("other").alias("block"), F.lit(False).alias("own")))
    of_text = dealt.groupBy("low").agg(F.collect_list(F.struct("key", "alike", "high", "place", "open", "block", "own")).alias("rows"))
    of_text = of_text.join(sequences.select(F.col("id").alias("low"), "shingles"), "low")
    local = of_text.mapInArrow(_locals, "key bigint, alike bigint, high bigint, open boolean, block int, own boolean, low bigint, local binary")
    # a fixed number of tasks: the work grows with comparisons, not with bytes
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = local.repartition(tasks, "key", "block").sortWithinPartitions("key", "block")
    found = scratch.keep(sorted_.mapInArrow(_compare, "key bigint, alike bigint, source bigint, from int, to int"))
    place = lambda c: (F.col("place") + F.col(c)).cast("int")
    return scratch.keep(members.where("open").join(found, ["key", "alike"]).where("source < id").select("source", "id", place("from").alias("start"), place("to").alias("end")).distinct())


def _class_sequences(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, shingles, rep, n): one row per id with a passage's length of words; ``rep`` is the smallest id of the same
    words, and only it has the sequence; n is the number of shingles."""
    rows = docs.mapInArrow(_sequences, "id bigint, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))
    rows = scratch.keep(rows.where(F.octet_length("shingles") >= 4 * SPAN).withColumn("digest", F.md5("shingles")))
    same = scratch.keep(rows.groupBy("digest").agg(F.min("id").alias("rep")))
    kept = rows.join(same, "digest").select("id", F.when(F.col("id") == F.col("rep"), F.col("shingles")).alias("shingles"), "rep", (F.octet_length("shingles") / 4).cast("int").alias("n"))
    kept = scratch.keep(kept)
    scratch.drop(rows)
    return kept


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (source, id, start, end): words [start, end) of document ``id`` repeat a passage of ``source``,
    a document with a smaller id.  Copies of a text repeat only the smallest id that has it."""
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")
    windows = docs.mapInArrow(_anchors, "key bigint, id bigint, place int")
    ends = scratch.keep(windows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key"))
    roots = scratch.keep(windows.join(ends, "key").groupBy("id").agg(F.collect_list("place").alias("places")))
    named = roots.select(F.col("id").alias("node"))
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    classes = _class_sequences(docs.join(named, F.col("id") == F.col("node"), "left_semi"), scratch)
    copies = classes.where("id != rep").select(F.col("rep").alias("source"), "id", F.lit(0).alias("start"), (F.col("n") + SHINGLE - 1).alias("end"))
    sequences = classes.where("id = rep").select("id", "shingles")

    # windows against the leader of their key
    keys = scratch.keep(roots.join(sequences, "id").mapInArrow(_keys, "key bigint, id bigint, place int, low smallint, high smallint"))
    scratch.drop(roots)
    dealt = scratch.keep(_shared(keys, scratch))
    scratch.drop(keys)
    found = scratch.keep(_verified(dealt.where("id != source"), sequences))
    # windows that are open then, among all others of their key
    leads = (F.col("id") == F.col("source")) & (F.col("place") == F.col("theirs"))
    still = scratch.keep(_still_open(dealt.where(~leads), found).select("key", "id", "place"))
    others = dealt.join(still.select(F.col("key").alias("k")).distinct(), F.col("key") == F.col("k"), "left_semi").select("key", "id", "place")
    left = still.withColumn("open", F.lit(True)).unionByName(others.withColumn("open", F.lit(False))).groupBy("key", "id", "place").agg(F.max("open").alias("open"))
    out = cut(_intervals(found.unionByName(_all_places(left, sequences, scratch)).unionByName(copies), "source", "id"))
    scratch.clear()
    return out


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_repeat_words inside passages of documents with smaller ids, those ids
    (sources), the word spans, and n_repeated_by (documents that repeat a passage of this one)."""
    found = passages(df, id_col, text_col)
    spans = _intervals(found.select("id", "start", "end"), "id").groupBy(F.col("id").alias("r_id"))
    own = spans.agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_repeat_words"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = found.select("source", "id").distinct()
    sources = pairs.groupBy(F.col("id").alias("p_id")).agg(F.sort_array(F.collect_list("source")).alias("sources"))
    used = pairs.groupBy(F.col("source").alias("s_id")).agg(F.count("*").alias("n_repeated_by"))
    rows = df.select(F.col(id_col).cast("long").alias("id"))
    joined = rows.join(own, F.col("id") == F.col("r_id"), "left").join(sources, F.col("id") == F.col("p_id"), "left").join(used, F.col("id") == F.col("s_id"), "left")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_repeat_words", F.lit(0)).alias("n_repeat_words"),
        F.coalesce("n_repeated_by", F.lit(0)).alias("n_repeated_by"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
        F.coalesce(text, F.lit("")).alias("spans"),
    )
