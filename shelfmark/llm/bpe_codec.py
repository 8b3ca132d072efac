"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Encoding explodes texts into pre-tokens.  Each block of texts keeps its token positions (as indexes
into the block's own word list) and sends every distinct word once to the bucket of the word's hash;
there each word is encoded once for the whole corpus.  The ids go back to the block, which puts them
together by position.  Words and positions travel packed and compressed, so a shuffle carries a small
multiple of the corpus' distinct words and about eleven bits a token.  A frequent word reaches its
bucket once a block, so no key is hot.  Decoding joins ids with the token-byte table, whose size is that of the
vocabulary.

Texts are read twice, for words and for positions.  Every block carries a digest of its texts in both parts, and
blocks that differ (an input that is not a deterministic scan of files) are an error, never wrong ids.  The words
of a bucket are read as a stream of batches.

Defined results: a null text counts as empty and has no ids; every input row gives one output row, so repeated
rows and ids (ties) keep their own results; a text longer than a block is a block of its own, whose memory grows
with the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import frugal
from shelfmark.llm.pretokens import pretokenize

#: Characters of a block of texts; a worker holds some forty bytes for each.
BLOCK_CHARS = 2 << 20
#: Words whose ids a bucket's task remembers, and bytes from which on a word is merged with a heap.
KNOWN_WORDS, LONG_WORD = 200_000, 200
NEVER = 1 << 62
#: Buckets of words for each shuffle partition of the session.
BUCKETS_PER_PARTITION = 2


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: from single bytes on, the neighbours of lowest rank are merged, the leftmost of equal ones."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, in n log n: a part is known by its first byte."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)
    rank = lambda i: ranks.get(word[i : end[end[i]]], NEVER) if end[i] < n else NEVER
    heap = [(r, i, end[i], end[end[i]]) for i in range(n - 1) if (r := rank(i)) != NEVER]
    heapify(heap)
    while heap:
        _, i, middle, stop = heappop(heap)
        if gone[i] or end[i] != middle or end[middle] != stop:
            continue  # a part of the pair has been merged since
        gone[middle] = 1
        end[i] = stop
        if stop < n:
            before[stop] = i
        for j in (before[i], i):
            if j >= 0 and (r := rank(j)) != NEVER:
                heappush(heap, (r, j, end[j], end[end[j]]))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


@lru_cache(maxsize=2)
def token_table(path: str) -> pa.Array:
    """Bytes of each id; ids without a token are null."""
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def _pack(*parts: bytes) -> bytes:
    body = b"".join(struct.pack("<I", len(p)) + p for p in parts)
    return struct.pack("<I", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[bytes]:
    body = pa.decompress(blob[4:], decompressed_size=struct.unpack_from("<I", blob)[0], codec="zstd", asbytes=True)
    parts, at = [], 0
    while at < len(body):
        (size,) = struct.unpack_from("<I", body, at)
        parts.append(body[at + 4 : at + 4 + size])
        at += 4 + size
    return parts


def _pack_numbers(values: np.ndarray) -> list[bytes]:
    """Four byte planes, which compress better than whole numbers."""
    return [bytes(p) for p in values.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()]


def _unpack_numbers(planes: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[str]]]:
    """(block, ids, texts): rows of a partition in order, cut by characters alone, so that a second scan cuts alike."""
    part, done, size, ids, texts = 0, 0, 0, [], []
    kind = None
    for batch in batches:
        kind, start = batch.column(0).type, 0
        values = batch.column(1).to_pylist()
        for i, text in enumerate(values):
            part = part or batch.column(2)[0].as_py() + 1
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                ids.append(batch.column(0)[start : i + 1])
                yield ((part - 1) << 32) + done, pa.concat_arrays(ids), texts
                start, done, size, ids, texts = i + 1, done + 1, 0, [], []
        ids.append(batch.column(0)[start:])
    if texts:
        yield ((part - 1) << 32) + done, pa.concat_arrays([x.cast(kind) for x in ids]), texts


def _explode(buckets: int, part: str):
    """Texts -> rows (block, digest, bucket, blob, ids).  Part ``words`` gives the distinct words of each block by
    bucket; part ``places`` gives one row a block with its positions, below all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for block, rows, texts in _blocks(batches):
            digest = 0
            for text in texts:
                digest = crc32(text.encode(), crc32(str(len(text)).encode(), digest))
            tokens, counts = pretokenize(texts)
            coded = tokens.dictionary_encode()
            del tokens, texts
            words = coded.dictionary.to_pylist()
            where = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(where, kind="stable")
            if part == "words":
                edges = np.searchsorted(where[order], np.arange(buckets + 1))
                keys = np.flatnonzero(np.diff(edges)).tolist()
                blobs = []
                for k in keys:
                    own = [words[i] for i in order[edges[k] : edges[k + 1]]]
                    blobs.append(_pack(*_pack_numbers(np.fromiter(map(len, own), np.int64, len(own))), b"".join(own)))
                ids = [None] * len(keys)
            else:
                # the ids come back bucket by bucket, where a word stands at its place in this order
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                blobs = [_pack(*_pack_numbers(rank[coded.indices.to_numpy()]), *_pack_numbers(counts))]
                keys, ids = [-1], [rows.to_pylist()]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([digest] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary()), pa.array(ids, pa.list_(rows.type))], names=["block", "digest", "bucket", "blob", "ids"])

    return run


def _encode_words(vocabulary: str):
    """One bucket, batch by batch: each distinct word is encoded once (again only after ``KNOWN_WORDS`` others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        ranks = load_ranks(vocabulary)
        known: dict[bytes, bytes] = {}  # word -> packed ids
        for batch in batches:
            at = batch.schema.get_field_index("blob")
            blobs = []
            for blob in batch.column(at):
                *planes, data = _unpack(blob.as_py())
                packed, start = [], 0
                for end in np.cumsum(_unpack_numbers(planes), dtype=np.int64).tolist():
                    word = data[start:end]
                    start = end
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        ids = known[word] = array("I", merge(word, ranks)).tobytes()
                    packed.append(ids)
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                blobs.append(_pack(*_pack_numbers(sizes), *_pack_numbers(np.frombuffer(b"".join(packed), np.uint32))))
            yield batch.set_column(at, batch.schema.field(at), pa.array(blobs, pa.binary()))

    return run


def _reassemble(table: pa.Table) -> pa.Table:
    """One block: ids of its words by bucket and its positions -> packed ids of each text."""
    frugal()
    table = table.sort_by("bucket")  # positions first
    if table["bucket"][0].as_py() != -1 or pc.count_distinct(table["digest"]).as_py() != 1:
        raise ValueError("the input gave other rows when it was read again: write it to a table first")
    places, *blobs = table["blob"].to_pylist()
    planes = _unpack(places)
    positions, counts = _unpack_numbers(planes[:4]).astype(np.int64), _unpack_numbers(planes[4:]).astype(np.int64)
    parts = [_unpack(b) for b in blobs]
    none = [np.empty(0, np.uint32)]
    sizes = np.concatenate([_unpack_numbers(p[:4]) for p in parts] or none).astype(np.int64)
    flat = np.concatenate([_unpack_numbers(p[4:]) for p in parts] or none)
    begins = np.cumsum(sizes) - sizes
    size = sizes[positions]
    ends = np.cumsum(size)
    ids = flat[np.repeat(begins[positions] - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)].astype("<u4")
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])] * 4
    packed = pa.Array.from_buffers(pa.binary(), counts.size, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids.tobytes())])
    return pa.table({"id": table["ids"].combine_chunks()[0].values, "ids_le": packed})


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row and ``ids_le``: token ids as little-endian unsigned 32-bit integers."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    id_type = kept.schema["id"].dataType.simpleString()
    buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = f"block bigint, digest bigint, bucket bigint, blob binary, ids array<{id_type}>"
    coded = kept.mapInArrow(_explode(buckets, "words"), row).groupBy("bucket").applyInArrow(_encode_words(vocabulary), row)
    # texts are split twice, which costs less than sending the positions through two shuffles
    return coded.unionByName(kept.mapInArrow(_explode(buckets, "places"), row)).groupBy("block").applyInArrow(_reassemble, f"id {id_type}, ids_le binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids_le", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col`` (in place of a column of that name): the bytes of the packed ids, by a join with the
    token-byte table.  Null ids give null; an id outside the vocabulary is an error."""
    df = df.drop(out_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        table = token_table(vocabulary)
        for batch in batches:
            packed = [x or b"" for x in batch.column(at).to_pylist()]
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            joined = pc.take(table, pa.array(ids))
            if joined.null_count:
                raise ValueError("an id is outside the vocabulary")
            offsets = np.frombuffer(joined.buffers()[1], np.int32)[: ids.size + 1] if ids.size else np.zeros(1, np.int32)
            edges = offsets[np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int64)]
            out = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(edges.astype(np.int32)), joined.buffers()[2] or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(batch.column(at).is_valid(), out, None)], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out_col}` binary")


def round_trip_report(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of ids and decoded bytes, as the query returns them."""
    return decode(encode(df, vocabulary, id_col, text_col), vocabulary).select(
        id_col,
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
