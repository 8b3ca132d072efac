"""Vectorised pre-tokenisation by the public byte-level BPE pattern.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches are runs of one code-point class with three corrections (a space joins the next run, the
last white space before a run stands alone, and contractions end early), so boundaries come from whole
array operations instead of a regex engine.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def token_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start of every pre-token among the code points of texts that begin at ``doc_starts``."""
    n = points.size
    if n == 0:
        return np.empty(0, np.int64)
    kind = code_point_classes()[points]
    opens = np.zeros(n + 1, bool)  # of a document
    opens[doc_starts] = True
    opens[n] = True
    starts = np.empty(n + 1, bool)
    starts[0] = starts[n] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
    starts |= opens
    # the last white space before another run of the same text
    last = np.flatnonzero((kind == SPACE) & starts[1:] & ~opens[1:])
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    # contractions: an apostrophe that opens a token, then letters
    quote = np.flatnonzero((points == 39) & starts[:n] & ~opens[1:])
    one = quote[np.isin(points[quote + 1], [ord(c) for c in "stmd"])]
    two = quote[(quote + 2 < n)]
    two = two[~opens[two + 2]]
    a, b = points[two + 1], points[two + 2]
    two = two[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    starts[one + 1] = False
    starts[one + 2] = True
    starts[two + 1] = False
    starts[two + 3] = True
    return np.flatnonzero(starts[:n])


def pretokenize(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of all texts as one binary array, and the number in each text."""
    data = "".join(texts)
    points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    doc_starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    starts = token_starts(points, doc_starts[lengths > 0])
    width = np.ones(points.size, np.uint8)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        width += points > limit
    ends = np.cumsum(width, dtype=np.int32)
    offsets = np.empty(starts.size + 1, np.int32)
    offsets[:-1] = ends[starts] - width[starts]
    offsets[-1] = ends[-1] if ends.size else 0
    tokens = pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(data.encode())])
    counts = np.diff(np.searchsorted(starts, np.concatenate([doc_starts, [points.size]])))
    return tokens, counts
