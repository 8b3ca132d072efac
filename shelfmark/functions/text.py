"""Column functions over text: tokens, lines, accents, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_TOKEN = r"[\p{L}\p{N}]+"
QUERY_TERM = r"[\p{L}\p{N}_]+"
#: Every character that ends a line.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def _accents() -> tuple[str, str]:
    """Latin letters with a plain letter as their decomposition's base, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if b != a and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Combining marks, which belong to the letter before them.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(text: Column) -> Column:
    """Lower case without diacritics, whether they are part of a letter or follow it."""
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(INDEX_TOKEN), F.lit(0))


def query_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(QUERY_TERM), F.lit(0))


def query_phrases(text: Column) -> Column:
    """The terms of a query as the index has them: each is the list of its folded tokens.  A term with an underscore is
    several tokens, one after the other; a term without any token is left out."""
    return F.filter(F.transform(query_terms(text), index_tokens), lambda p: F.size(p) > 0)


def strip(text: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_with_ends(text: Column) -> Column:
    """Lines including their terminators; concatenation gives the text back."""
    return F.regexp_extract_all(text, F.lit(f"[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+"), F.lit(0))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "_")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))
