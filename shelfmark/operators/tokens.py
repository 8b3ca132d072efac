"""Tokens of a vocabulary file, with the characters that each stands for, so that pieces are cut in the text itself."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Texts -> for each the places (first character, character after the last) of its tokens, as two arrays.
Tokenizer = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary of byte pairs: lines of a token in base64 and its rank.  Some ten thousand lines, read by Spark from any
    store."""
    rows = spark.read.text(path).where("value != ''").collect()
    return {base64.b64decode(token): int(rank) for token, rank in (r[0].split() for r in rows)}


@lru_cache(maxsize=2)
def _encoding(ranks: tuple, pattern: str):
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def byte_pairs(spark: SparkSession, path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a vocabulary file.  Workers get its ranks by broadcast, a few megabytes whatever the corpus."""
    held = spark.sparkContext.broadcast(tuple(load_ranks(spark, path).items()))

    def places(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        encoding = _encoding(held.value, pattern)
        return [char_places(t, [len(b) for b in encoding.decode_tokens_bytes(encoding.encode_ordinary(t))]) for t in texts]

    return places


def char_places(text: str, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (exclusive) of tokens of so many bytes each.  A token that begins or ends inside a character
    has all of it."""
    data = np.frombuffer(text.encode(), np.uint8)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(np.array(sizes, np.int64))
    starts = ends - np.array(sizes, np.int64)
    inside = np.append((data & 0xC0) == 0x80, False)
    return begins[starts] - inside[starts], begins[ends]


def words(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words with the white space after them, as a tokenizer."""
    import re

    found = [[(m.start(), m.end()) for m in re.finditer(r"\S+\s*", t)] for t in texts]
    return [(np.array([a for a, _ in f], np.int64), np.array([b for _, b in f], np.int64)) for f in found]


def token_pieces(df: DataFrame, tokenizer: Tokenizer, size: int, step: int, text_col: str = "text") -> DataFrame:
    """Each row once for each piece of its text, with piece, n_tokens, piece_start, piece_end (characters) and the piece in place
    of the text: ``size`` tokens every ``step``, up to the first piece that reaches the end.  Null and empty texts have none."""

    def run(batches):
        for pdf in batches:
            rows: list[tuple[int, int, int, int, int, str]] = []
            for i, (text, (starts, ends)) in enumerate(zip(pdf[text_col], tokenizer([t or "" for t in pdf[text_col]]), strict=True)):
                for piece, a in enumerate(range(0, max(len(starts) - size, 0) + step, step) if len(starts) else ()):
                    if piece and a - step + size >= len(starts):
                        break  # the piece before reached the end
                    last = min(a + size, len(starts)) - 1
                    rows.append((i, piece, last + 1 - a, int(starts[a]), int(ends[last]), text[starts[a] : ends[last]]))
            at = [r[0] for r in rows]
            out = pdf.iloc[at].reset_index(drop=True)
            more = pd.DataFrame(rows, columns=["row", "piece", "n_tokens", "piece_start", "piece_end", text_col])
            yield out.drop(columns=text_col).assign(**{c: more[c] for c in more.columns[1:]})[[*pdf.columns, "piece", "n_tokens", "piece_start", "piece_end"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, piece int, n_tokens int, piece_start bigint, piece_end bigint")
