"""Near-duplicate documents: ProbMinHash over weighted word shingles, banding, exact verification.

Texts with the same words in order form one class.  A class' shingles (five words), weighted by their
counts, send arrivals of Poisson processes to the slots of a signature; each slot keeps its earliest
arrival, and a shingle stops as soon as its next arrival is later than every slot's.  Two signatures
agree in a slot with the probability Jaccard similarity of their weighted shingles.  Texts that repeat a
shingle have a second signature with all weights 1, which agrees with the Jaccard similarity of the sets; for
texts without repeats the two are the same.  Signatures are cut into bands, and a bucket holds either kind.  Members of a bucket are verified against a few leaders of the bucket with the exact Jaccard
similarity of their shingle sets; what stays unconnected within a bucket (its outsiders) is then compared with all
members, a block of outsiders with a block of members a task, so every pair of a bucket is either verified or already
connected, and no task holds more than two blocks.

Chance to miss a pair of set Jaccard s in all bands: (1 - s**ROWS)**BANDS at most, 7e-5 at 0.8.

Defined results: null and empty texts and texts without words are never duplicates; texts of fewer
than five words have one shingle of all of them; ids are expected to be unique (rows that share an id
are one node); of equal texts and groups (ties) the smallest id represents; a very long text is one set of
shingles, whose memory grows with it; rows with a null id keep their row and never represent others; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, frugal
from shelfmark.llm.graph import connected_components
from shelfmark.llm.words import all_shingles, blocks, mix, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Leaders of a bucket, which members are verified against: the smallest id (an original comes before its
#: copies), and others by a hash.
LEADERS = 3
#: Members (and outsiders) of a bucket in a block; the copies sent to blocks fall with its square.
BLOCK = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted(shingles: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with counts, by row, then shingle."""
    order = np.lexsort((shingles, rows))
    shingles, rows = shingles[order], rows[order]
    first = np.ones(rows.size, bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return rows[at], shingles[at], np.diff(np.append(at, rows.size))


def signatures(rows: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signature (n x slots of shingle hashes) of ``n`` rows of weighted shingles."""
    arrival = np.full(n * slots, np.inf)
    winner = np.zeros(n * slots, np.uint64)
    time, step = np.zeros(rows.size), np.zeros(1, np.uint64)
    while rows.size:
        step += _GOLD
        random = mix(shingles + step)
        slot = ((random >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        time = time - np.log(((random & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32) / weights
        cell = rows * slots + slot.astype(np.int64)
        early = np.flatnonzero(time < arrival[cell])
        np.minimum.at(arrival, cell[early], time[early])
        won = early[arrival[cell[early]] == time[early]]
        winner[cell[won]] = shingles[won]
        live = time < arrival.reshape(n, slots).max(axis=1)[rows]
        rows, shingles, weights, time = rows[live], shingles[live], weights[live], time[live]
    return winner.reshape(n, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None] * _GOLD
    for k in range(ROWS):
        key = mix(key * np.uint64(31) + parts[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (id, digest of the words or null, band keys)."""
    frugal()
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts):
            words, counts = word_hashes(texts[a:b])
            ends = np.cumsum(counts)
            data = words.tobytes()
            keys = [blake2b(data[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            shingles, number = all_shingles(words, counts)
            rows, distinct, weight = weighted(shingles, np.repeat(np.arange(b - a), number))
            own = band_keys(signatures(rows, distinct, weight, b - a))
            again = np.unique(rows[weight > 1])  # texts that repeat a shingle
            some = np.isin(rows, again)
            flat = band_keys(signatures(np.searchsorted(again, rows[some]), distinct[some], np.ones(int(some.sum())), again.size))
            both = [*own]
            for at, keys_of_set in zip(again.tolist(), flat, strict=True):
                both[at] = np.unique(np.concatenate([own[at], keys_of_set]))
            edges = np.cumsum([0, *map(len, both)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(both)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(keys, pa.binary()), bands], names=["id", "words", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (id, sorted distinct shingles as packed 64-bit integers)."""
    frugal()
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for a, b in blocks(texts):
            words, counts = word_hashes(texts[a:b])
            shingles, number = all_shingles(words, counts)
            rows, distinct, _ = weighted(shingles, np.repeat(np.arange(b - a), number))
            edges = (np.searchsorted(rows, np.arange(b - a + 1)) * 8).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(distinct.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], packed], names=["node", "shingles"])


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not x.size or not y.size:
        return 0.0
    if x.size > y.size:
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, y.size - 1)] == x).sum())
    return shared / (x.size + y.size - shared)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = pa.array([jaccard(x, y) >= threshold for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _compare_block(threshold: float):
    """A block of a bucket's members with a block of its outsiders -> links that join their components."""

    def run(table: pa.Table) -> pa.Table:
        frugal()
        nodes, parts, asks = table["node"].to_numpy(), table["comp"].to_numpy().copy(), table["asks"].to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        column = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        row = np.repeat(np.arange(len(sets)), size)
        out, mine = np.flatnonzero(asks), np.flatnonzero(~asks)
        shared = np.zeros((out.size, mine.size), np.float64)
        width = 1 << 14
        for low in range(0, int(column.max(initial=-1)) + 1, width):
            here = (column >= low) & (column < low + width)
            chunk = np.zeros((len(sets), width), np.float32)
            chunk[row[here], column[here] - low] = 1
            shared += chunk[out] @ chunk[mine].T
        alike = shared >= threshold * (size[out][:, None] + size[mine][None] - shared)
        left, right = [], []
        for x, y in zip(*(i.tolist() for i in np.nonzero(alike & (parts[out][:, None] != parts[mine][None]))), strict=True):
            a, b = out[x], mine[y]
            if parts[a] != parts[b]:
                parts[parts == max(parts[a], parts[b])] = min(parts[a], parts[b])
                left.append(nodes[a])
                right.append(nodes[b])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id with the same words), n_copies of the class,
    component_id (smallest id reachable by links) and kept (the component's smallest id)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_sign, "id bigint, words binary, bands array<bigint>"))
    classes = cut(signed.where("words is not null").groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    members = classes.where("rep is not null").select(F.col("rep").alias("node"), F.posexplode("bands").alias("band", "key")).drop("band")

    first = lambda k: (F.min_by("node", F.xxhash64("node", F.lit(k))) if k else F.min("node")).alias(f"leader{k}")
    shared = cut(members.groupBy("key").agg(F.count("*").alias("size"), *[first(k) for k in range(LEADERS)]).where("size > 1"))
    inside = cut(members.join(shared, "key"))
    pairs = inside.select("node", F.explode(F.array_distinct(F.array(*[f"leader{k}" for k in range(LEADERS)]))).alias("leader")).where("node != leader")
    pairs = cut(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())

    named = inside.select("node").distinct()
    texts = docs.join(named, F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id"])
    sets = cut(texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(_shingle_sets, "node bigint, shingles binary"))
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    links = cut(with_b.select("a", "b", "sa", "sb").mapInArrow(_verify(threshold), "a bigint, b bigint"))
    components = connected_components(links, "a", "b")

    # buckets of three or more whose members are not all connected
    placed = inside.where("size > 2").select("key", "node", "size", "leader0").join(components, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    placed = cut(placed.drop("component"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("node") == F.col("leader0"), F.col("comp"))).alias("main")).where("low != high")
    inside_ = placed.join(open_keys.select("key", "main"), "key").withColumn("out", F.col("comp") != F.col("main"))
    number = lambda n: F.ceil(n / BLOCK).cast("int")
    n_out = inside_.where("out").groupBy(F.col("key").alias("k")).agg(number(F.count("*")).alias("out_blocks"))
    left = inside_.join(n_out, F.col("key") == F.col("k")).withColumn("blocks", number(F.col("size")))
    own = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # every member lies in one block, every outsider in one block of outsiders as well; each pair of blocks is a task
    members_ = left.select("key", "node", "comp", own("blocks").alias("block"), every("out_blocks").alias("out_block"), F.lit(False).alias("asks"))
    outsiders = left.where("out").select("key", "node", "comp", every("blocks").alias("block"), own("out_blocks").alias("out_block"), F.lit(True).alias("asks"))
    tasks = members_.unionByName(outsiders)
    more = tasks.join(sets, "node").groupBy("key", "block", "out_block").applyInArrow(_compare_block(threshold), "a bigint, b bigint")
    components = connected_components(links.unionByName(more), "a", "b")

    of_class = classes.join(components, F.col("rep") == F.col("node"), "left").select("words", "rep", "n", F.coalesce("component", "rep").alias("component"))
    joined = signed.select("id", "words").join(of_class, "words", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
