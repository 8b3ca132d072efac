"""Benchmark decontamination by winnowed word k-gram fingerprints, in DataFrame functions only.

A benchmark item yields windows of ``WINDOW`` consecutive words (one shorter window if it has fewer).
Of every stretch of ``WINDOW`` words both sides keep the smallest of its k-gram hashes (the rightmost of equal
ones), so each shared stretch shares a fingerprint.  Fingerprints are joined, each hit is laid on its diagonal
(document position minus item position) and extended word by word; runs of equal words as long as a window are
hits.  Items shorter than a window are fingerprinted by all their words at once, for each such length.
Words of a document are cut once, in one projection that yields their number and the fingerprints; only
documents with a joined fingerprint are read again, one row each with all their items and diagonals.

Defined results: null and empty texts have no words and no hits; items without words are ignored;
each document row gives one output row (rows repeated with the same id and text have equal results,
rows that share only the id are kept apart by a hash of the text); of equal hashes in a stretch (ties) both sides
take the rightmost; a very long text is one row, whose work and memory grow in proportion (a text of one repeated
word matches on as many diagonals as it has words); empty tables give zeros or an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

WINDOW = 10
GRAM = 6
#: Benchmark fingerprints and item words are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
#: A text has at most so many words: each takes two bytes of the 2 GB that a value can have.
PLACES = (1 << 30) - 1
#: Fixed value: runs of characters between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(text: Column) -> Column:
    """Runs of word characters; splitting costs a twentieth of matching them one by one."""
    return F.array_remove(F.split(text, BETWEEN), "")


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z in lower case; null has none."""
    return _cut(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def folded_words(text: Column) -> Column:
    """Words with all letters in lower case, for fingerprints only: they lie where those of ``words_of`` do, are equal
    where those are, and cost less.  The sign that depends on what follows it (final sigma) is made one."""
    return _cut(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (lambda bodies would compute it for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` word hashes, by its first position; empty if there are fewer."""
    grams = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - size + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, size)], F.lit(size)))
    return F.when(F.size(hashes) >= size, grams).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, span: int) -> Column:
    """(pos, hash) of the smallest hash of each stretch of ``span`` hashes, the rightmost of equal ones.  Both
    sides of a shared stretch pick the same place of it."""

    def picked(h: Column) -> Column:
        # the low bits of a hash give way to the place, counted down, so that the smallest is the rightmost of equal ones
        ranked = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 - PLACES)).bitwiseOR(F.lit(PLACES) - i))
        least = lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - span + 1, F.lit(0))), lambda x, i: F.least(x, *[F.get(v, i + k) for k in range(1, span)]))
        places = F.transform(F.array_distinct(let(ranked, least)), lambda x: (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("int"))
        return F.transform(places, lambda p: F.struct(p.alias("pos"), F.get(h, p).alias("hash")))

    return let(hashes, picked)


def fingerprints(words: Column, short: list[int]) -> Column:
    """(pos, hash) of winnowed grams, and of all grams of the lengths of short items, of a text's words."""
    of = lambda h: F.concat(winnow(gram_hashes(h, GRAM), WINDOW - GRAM + 1), *[F.transform(gram_hashes(h, n), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("hash"))) for n in short])
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only when the counted size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _item_prints(items: DataFrame, short: list[int]) -> DataFrame:
    """(item, item_pos, item_hash): winnowed grams of long items, the whole of short ones."""
    sized = lambda n: F.size("folded") >= WINDOW if n is None else F.size("folded") == n
    per = [items.where(sized(n)).select("item", F.explode(F.filter(fingerprints(F.col("folded"), [n] if n else []), (lambda p: F.lit(True)) if n is None else (lambda p: p["pos"] == 0))).alias("p")) for n in [None, *short]]
    out = per[0]
    for more in per[1:]:
        out = out.unionByName(more)
    return out.select("item", F.col("p.pos").alias("item_pos"), F.col("p.hash").alias("item_hash")).distinct()


def matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(one row per document: id, text_hash, n_words; one row per different document with hits: o_id, o_hash, n_hit, items)."""
    known = cut(items.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("item_words"), folded_words(F.col(item_text)).alias("folded")).where(F.size("item_words") > 0).distinct())
    shape = known.agg(F.collect_set(F.when(F.size("folded") < WINDOW, F.size("folded"))).alias("short"), F.sum(F.size("folded")).alias("words")).first()
    short, n_words = sorted(shape["short"]), shape["words"] or 0

    # words are cut once: a first element of its own carries their number, the others are fingerprints
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = lambda w: F.struct(F.size(w).alias("pos"), F.lit(None).cast("bigint").alias("hash"))
    prints = let(folded_words(F.col("text")), lambda w: F.concat(F.array(counted(w)), fingerprints(w, short)))
    exploded = texts.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(prints).alias("at", "p"))
    exploded = exploded.select("id", "text_hash", "at", "p.pos", F.coalesce("p.hash", F.xxhash64("id", "text_hash")).alias("hash"))
    joined = exploded.join(_small(_item_prints(known, short), n_words), (F.col("hash") == F.col("item_hash")) & (F.col("at") > 0), "left")
    rows = cut(joined.where("at = 0 or item is not null").select("id", "text_hash", (F.col("at") == 0).alias("is_doc"), "pos", "item", (F.col("pos") - F.col("item_pos")).alias("shift")))

    # one row per document: its items, each with the diagonals to try
    shifts = rows.where("not is_doc").groupBy("id", "text_hash", "item").agg(F.collect_set("shift").alias("shifts"))
    laid = shifts.join(_small(known.select("item", "item_words"), n_words), "item").groupBy("id", "text_hash").agg(F.collect_list(F.struct("item", "item_words", "shifts")).alias("tries"))
    laid = cut(laid.select(F.col("id").alias("o_id"), F.col("text_hash").alias("o_hash"), "tries"))
    same = F.col("id").eqNullSafe(F.col("o_id")) & (F.xxhash64("text") == F.col("o_hash"))
    wanted = _small(laid.select("o_id", "o_hash"), laid.count())
    held = texts.join(wanted, same, "left_semi").dropDuplicates(["id", "text"]).select("id", "text", words_of(F.col("text")).alias("words"))
    each = F.transform("tries", lambda t: F.struct(t["item"].cast("string").alias("item"), _extended(t["item_words"], F.col("words"), t["shifts"]).alias("hits")))
    tried = held.join(laid, same).select("o_id", "o_hash", F.filter(each, lambda t: F.size(t["hits"]) > 0).alias("found"))
    found = tried.where(F.size("found") > 0).select("o_id", "o_hash", F.size(F.array_distinct(F.flatten(F.col("found")["hits"]))).alias("n_hit"), F.array_sort(F.array_distinct(F.col("found")["item"])).alias("items"))
    return rows.where("is_doc").select("id", "text_hash", F.col("pos").cast("long").alias("n_words")), found


def _extended(item: Column, words: Column, shifts: Column) -> Column:
    """Positions of the words on the diagonals that lie in runs of equal words as long as a window."""
    need = F.least(F.size(item), F.lit(WINDOW))

    def along(shift: Column) -> Column:
        first = F.greatest(F.lit(0), -shift)
        length = F.greatest(F.least(F.size(item), F.size(words) - shift) - first, F.lit(0))
        equal = F.zip_with(F.slice(item, first + 1, length), F.slice(words, first + shift + 1, length), lambda a, b: F.when(a == b, "1").otherwise("0"))
        starts = lambda marks: F.when(length >= need, F.filter(F.sequence(F.lit(0), length - need), lambda i: F.substr(marks, i + 1, need) == F.repeat(F.lit("1"), need)))
        runs = let(F.array_join(equal, ""), lambda marks: F.flatten(F.transform(starts(marks), lambda i: F.sequence(first + shift + i, first + shift + i + need - 1))))
        return F.coalesce(runs, F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(shifts, along)))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: id, n_words, n_hit, the sorted ids of items found (as text), contaminated."""
    counted, found = matches(docs, items, id_col, text_col, item_col, item_text)
    joined = counted.join(found, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item."""
    _, found = matches(docs, items, id_col, text_col, item_col, item_text)
    found = found.select(F.col("o_id").alias("__hit_id"), F.col("o_hash").alias("__hit_hash"))
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hit_hash")), "left_anti")


def contamination_report(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """:func:`contamination` with the item list as count and digest, as the query returns it."""
    found = contamination(docs, items, **columns)
    return found.select(
        found.columns[0],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


#: DuckDB SQL for the query over the registered tables.
ORACLE_SQL = r"""
with it as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null),
iw as (
  select distinct item_id, least(10, len(w)) m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from it where len(w) > 0)),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
dw as (
  select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d cross join (select distinct m from iw))),
h as (select doc_id, item_id, i, dw.m from dw join iw on dw.m = iw.m and dw.g = iw.g),
p as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(range(i, i + m)) x from h) group by doc_id),
s as (select doc_id, count(*) n_items, string_agg(k, ',' order by k) l from (select distinct doc_id, cast(item_id as varchar) k from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(p.n_hit, 0) n_hit, coalesce(s.n_items, 0) n_items,
       sha256(coalesce(s.l, '')) items_sha256, coalesce(p.n_hit, 0) > 0 contaminated
from d left join p on p.doc_id = d.doc_id left join s on s.doc_id = d.doc_id
"""
