"""What each quality filter removes, in every order in which the filters may be applied.

Words are rows: each text is exploded, words are counted by (document, word) and then by document for totals and distinct
words, which decide two of the filters.  The other flags come from one pass over the texts, and from the smallest id of each
digest of a text; an outer join puts them together.  A document then is one of 32 sets of filters that it fails.  One
aggregation by part counts documents, good and toxic ones by set, and all orders follow from these 96 counts.

Texts are shuffled once, by their key, so that all words of a text stay in one task and neither aggregation of words
moves rows again.  The join on digests of texts is on small rows, and adaptive execution splits it where a text has many copies.

Defined results: a null text is an empty one; empty texts have no words, which fails A alone, and all but the one with the
smallest id fail E; a null lang is the part of the empty string; rows that share an id are each a document, and of those equal
texts that share the smallest id none fails E; rows with a null id fail E with no text, have no labels, and stand for no other;
labels that repeat count if any row says 1; texts are read whole, a very long one is a row like any other; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SPACE = r"[ \t-\r]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = "[#$%&*|]"


def word_totals(texts: DataFrame) -> DataFrame:
    """(key columns, words, distinct_words) of each (id, hash, text).  Each text has one null word more, whose count
    is the number of rows that share the key, by which totals are divided."""
    keys = ["id", "hash"]
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    one = texts.repartition(*keys).select(*keys, F.explode(F.concat(F.array(F.lit(None).cast("string")), words)).alias("word"))
    by_word = one.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    totals = by_word.groupBy(*keys).agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n")).otherwise(0)).alias("all"), F.count("word").alias("distinct_words"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("rows"))
    return totals.select(*keys, F.expr("all div rows").alias("words"), "distinct_words")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails) of each document; ``fails`` has bit 0 for filter A, and so on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    size = F.char_length("text")
    capitals = size - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = texts.select("id", "hash", "part", (100 * capitals > MOST_CAPITALS * size).alias("c"), F.col("text").rlike(SIGNS).alias("d"), F.unhex(F.sha2("text", 256)).alias("digest"))
    flags = cut(flags)  # a few bytes a document, read twice: texts are read once for them
    first = flags.groupBy("digest").agg(F.min("id").alias("first_id"))
    flags = flags.join(first, "digest", "left").withColumn("e", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))).drop("digest", "first_id")
    totals = word_totals(texts.select("id", "hash", "text")).select(F.col("id").alias("w_id"), F.col("hash").alias("w_hash"), "words", "distinct_words")
    rows = flags.join(totals, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("hash") == F.col("w_hash")), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d"), F.col("e")]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << i).otherwise(0)
    return rows.select("id", "part", bits.alias("fails"))


def _bit(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), letter)


def _over(counts: str, wanted) -> Column:
    """The sum of the counts of those sets of failed filters that ``wanted`` is true of."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(wanted(m), F.get(F.col(counts), m)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    of_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = failures(docs, id_col, text_col, part_col).join(of_id, "id", "left")
    counted = lambda more, name: [F.count(F.when((F.col("fails") == m) & more, 1)).alias(f"{name}{m}") for m in range(SETS)]
    columns = {"n": counted(F.lit(True), "n"), "good": counted(F.coalesce("good", F.lit(False)), "good"), "toxic": counted(F.coalesce("toxic", F.lit(False)), "toxic")}
    sets = rows.groupBy("part").agg(*[c for group in columns.values() for c in group])
    sets = sets.select("part", *[F.array(*[f"{name}{m}" for m in range(SETS)]).alias(name) for name in columns])

    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = sets.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(F.filter(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), lambda x: x != ""), F.lit(0), lambda s, x: s.bitwiseOR(_bit(x)))
    steps = steps.withColumn("own", _bit(letter)).withColumn("before", before)
    mine = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    # a document that fails s filters is removed by each of them in an s-th of all orders
    share = F.aggregate(F.sequence(F.lit(1), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(mine(m), F.get(F.col("n"), m) * (F.lit(len(orders)) / F.bit_count(m)).cast("long")).otherwise(0))
    return steps.select(
        "part",
        "filter_order",
        "step",
        _over("n", lambda m: ~gone(m) & ~mine(m)).alias("kept"),
        _over("n", lambda m: ~gone(m) & mine(m)).alias("removed"),
        _over("n", lambda m: gone(m) & mine(m)).alias("redundant"),
        F.get(F.col("n"), F.col("own")).alias("unique_fails"),
        _over("good", lambda m: ~gone(m) & mine(m)).alias("good_lost"),
        _over("toxic", lambda m: ~gone(m) & mine(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


#: Each order is replayed over the documents themselves: the first filter of the order that a document fails removes it.
ORACLE_SQL = r"""
with t as (select row_number() over () r, doc_id, coalesce(lang, '') part, coalesce(text, '') text from documents),
w as (select r, doc_id, part, text, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') ws from t),
f as (select r, part, doc_id, len(ws) < 100 a, 100 * len(list_distinct(ws)) < 80 * len(ws) b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) c,
  regexp_matches(text, '[#$%&*|]') d, coalesce(doc_id > min(doc_id) over (partition by text), false) e from w),
l as (select doc_id, max(quality) = 1 good, max(toxic) = 1 toxic from labels group by doc_id),
k as (select f.*, coalesce(good, false) good, coalesce(toxic, false) toxic,
  case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end fails from f left join l using (doc_id)),
g as (select part, fails, count(*) n, count(case when good then 1 end) good, count(case when toxic then 1 end) toxic from k group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, filter_order[step] letter from o, (select unnest(range(1, 6)) step)),
h as (select g.part, g.fails, o.filter_order, g.n, g.good, g.toxic, coalesce(list_min(list_transform(list_filter(string_split(g.fails, ''), lambda z: z <> ''), lambda z: instr(o.filter_order, z))), 6) gone from g cross join o),
q as (select h.part, s.filter_order, s.step, s.letter, sum(case when gone > step then n else 0 end) kept, sum(case when gone = step then n else 0 end) removed,
  sum(case when gone < step and contains(fails, letter) then n else 0 end) redundant, sum(case when fails = letter then n else 0 end) unique_fails,
  sum(case when gone = step then good else 0 end) good_lost, sum(case when gone = step then toxic else 0 end) toxic_lost
  from h join s using (filter_order) group by all)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) shapley from q
"""
