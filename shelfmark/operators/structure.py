"""Structure induction: heading shapes, mined profiles, segments, the acceptance gate, regional repair.

A document's profile is a list of levels, coarse to fine.  A level is a keyword and the class of number
that follows it (``<NUM>`` or ``<ROM>``), or a pattern of its own, as profile files may have.  Documents come as (doc, txt);
every result is per document.
"""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import lines_with_ends, safe_name, strip
from shelfmark.session import cut as materialise

MIN_COUNT, REGION_MIN_COUNT, MOST_LEVELS, REGION_DEPTH = 5, 3, 4, 3
CEILING, COVERAGE, LEAST_SEGMENTS, CHARS_PER_SEGMENT = 60_000, 0.95, 3, 200
LINE_LIMIT = 300
CRUMB = " › "
#: Function words that precede numbers in running text.
STOP_WORDS = ["з", "до", "від", "після", "перед", "протягом", "на", "у", "в", "за", "по", "під", "над", "при", "для", "понад", "близько", "не", "і", "та", "або", "що", "як", "коли", "якщо", "це", "усі", "всі", "цей", "цього", "станом"]
NUM, ROM = "<NUM>", "<ROM>"
NUM_TAIL, ROM_TAIL = r"^\s+(\d+(?:[.\-]\d+)*)", r"^\s+([IVXLCDM]+)"
#: Seconds that a pattern may take on a line.
MATCH_SECONDS = 0.2
PROFILE = "fingerprint string, variant string, levels array<struct<lv:int,name:string,keyword:string,cls:string,pattern:string>>"
LEVEL = ["doc", "lv", "low", "keyword", "cls", "pattern"]
#: The one profile known from the start.
SHIPPED = [("стаття|<NUM>", "shipped", [("розділ", "Розділ", ROM), ("стаття", "Стаття", NUM)])]


def lines(docs: DataFrame) -> DataFrame:
    """(doc, ln, line, off): stripped lines with the character offset of their start."""
    raw = docs.select("doc", F.posexplode(lines_with_ends(F.col("txt"))).alias("ln", "raw"))
    before = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return raw.select("doc", "ln", strip(F.col("raw")).alias("line"), F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).alias("off"))


def heading_lines(docs: DataFrame) -> DataFrame:
    """(doc, ln, keyword, low, cls) of lines shaped like a heading.  Lines need no offset here, so nothing
    is shuffled."""
    raw = docs.select("doc", F.posexplode(lines_with_ends(F.col("txt"))).alias("ln", "raw")).select("doc", "ln", strip(F.col("raw")).alias("line"))
    tokens = F.split("line", r"\s+")
    shaped = raw.where((F.length("line") > 0) & (F.length("line") <= LINE_LIMIT) & (F.size(tokens) >= 2))
    keyword = F.regexp_replace(tokens[0], r"\.+$", "")
    second = F.regexp_replace(tokens[1], r"[.:)]+$", "")
    cls = F.when(second.rlike(r"^\d+(?:[.\-]\d+)*$"), NUM).when(second.rlike(r"^[IVXLCDM]+$"), ROM)
    found = shaped.select("doc", "ln", keyword.alias("keyword"), F.lower(keyword).alias("low"), cls.alias("cls"))
    word = F.col("keyword").rlike(r"^\p{L}[\p{L}\p{N}_'-]*$") & F.col("keyword").rlike(r"^\p{Lu}")
    return found.where(F.col("cls").isNotNull() & word & ~F.col("low").isin(STOP_WORDS))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, low, cls, n, keyword, first_ln): how often each heading shape occurs, its first spelling."""
    return heading_lines(docs).groupBy("doc", "low", "cls").agg(F.count("*").alias("n"), F.min_by("keyword", "ln").alias("keyword"), F.min("ln").alias("first_ln"))


def fingerprints(docs: DataFrame, found: DataFrame, top: int = 1) -> DataFrame:
    """(doc, fingerprint): the most frequent signatures, or ``none``."""
    order = Window.partitionBy("doc").orderBy(F.desc("n"), "first_ln")
    ranked = found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top)
    shape = F.struct("rk", F.concat_ws("|", "low", "cls").alias("s"))
    keys = ranked.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(shape))["s"], ";").alias("fingerprint"))
    return docs.select("doc").join(keys, "doc", "left").select("doc", F.coalesce("fingerprint", F.lit("none")).alias("fingerprint"))


def mine(found: DataFrame, min_count: int = MIN_COUNT, most: int = MOST_LEVELS) -> DataFrame:
    """(doc, lv, low, keyword, cls, n): the most frequent signatures, rarest first."""
    frequent = Window.partitionBy("doc").orderBy(F.desc("n"), "first_ln")
    coarse = Window.partitionBy("doc").orderBy("n", "first_ln")
    chosen = found.where(F.col("n") >= min_count).withColumn("rk", F.row_number().over(frequent)).where(F.col("rk") <= most)
    return chosen.withColumn("lv", F.row_number().over(coarse) - 1).select("doc", "lv", "low", "keyword", "cls", "n")


def with_pattern(levels: DataFrame) -> DataFrame:
    """Levels in the columns ``LEVEL``; mined ones have no pattern."""
    return (levels if "pattern" in levels.columns else levels.withColumn("pattern", F.lit(None).cast("string"))).select(LEVEL)


def profiles(levels: DataFrame) -> DataFrame:
    """(doc, levels): one array of (lv, name, keyword, cls, pattern) a document."""
    return with_pattern(levels).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("lv", F.col("low").alias("name"), "keyword", "cls", "pattern"))).alias("levels"))


def headings(docs: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, off, lv, name, label) of every line that a level of its document's profile matches; the
    coarsest level wins.  Keywords need no regex compiled for a row; levels with a pattern are tried by a worker."""
    own = "pattern" in levels.columns
    levels = with_pattern(levels)
    placed = lines(docs)
    plain = _keyword_headings(placed, levels.where("pattern is null"))
    if not own:
        return plain
    found = plain.unionByName(_pattern_headings(placed, levels.where("pattern is not null")))
    first = found.groupBy("doc", "off").agg(F.min(F.struct("lv", "name", "label")).alias("h"))
    return first.select("doc", "off", "h.lv", "h.name", "h.label")


def _pattern_headings(placed: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, off, lv, name, label) of every line that a pattern matches from its start; the label is the name and the first
    group.  A pattern that is no pattern, or takes longer than ``MATCH_SECONDS`` on a line, does not match it."""
    rows = placed.where("line != ''").join(profiles(levels), "doc").withColumn("lines_levels", F.to_json("levels")).drop("levels", "ln")

    def match(pattern: str, line: str):
        try:
            return regex.match(pattern, line, timeout=MATCH_SECONDS)
        except (regex.error, TimeoutError):
            return None

    def run(batches):
        for pdf in batches:
            out = []
            for doc, line, off, levels_json in zip(pdf["doc"], pdf["line"], pdf["off"], pdf["lines_levels"], strict=True):
                for level in json.loads(levels_json):
                    hit = match(level["pattern"], line)
                    if hit:
                        group = hit.group(1) if hit.re.groups else None
                        out.append((doc, off, level["lv"], level["name"], f"{level['name']} {group}" if group else level["name"]))
                        break  # the coarsest
            yield pd.DataFrame(out, columns=["doc", "off", "lv", "name", "label"])

    kind = placed.schema["doc"].dataType.simpleString()
    return rows.select("doc", "line", "off", "lines_levels").mapInPandas(run, f"doc {kind}, off bigint, lv int, name string, label string")


def _keyword_headings(placed: DataFrame, levels: DataFrame) -> DataFrame:
    rows = placed.join(profiles(levels), "doc")
    line = F.col("line")

    def number(level: Column) -> Column:
        tail = F.substr(line, F.length(level["keyword"]) + 1)
        group = F.when(level["cls"] == NUM, F.regexp_extract(tail, NUM_TAIL, 1)).otherwise(F.regexp_extract(tail, ROM_TAIL, 1))
        return F.when(F.startswith(line, level["keyword"]), group).otherwise("")

    tried = F.transform("levels", lambda level: F.struct(level["lv"].alias("lv"), level["name"].alias("name"), number(level).alias("num")))
    hit = F.get(F.filter(tried, lambda t: t["num"] != ""), F.lit(0))
    return rows.select("doc", "off", hit.alias("h")).where("h is not null").select("doc", "off", "h.lv", "h.name", F.concat_ws(" ", "h.name", "h.num").alias("label"))


def segments(docs: DataFrame, found: DataFrame, most: int = MOST_LEVELS) -> DataFrame:
    """(doc, start_off, end_off, breadcrumb, level_name): from each heading to the next; a breadcrumb
    holds the last label of each level that no coarser heading has ended.  Profiles have ``most`` levels at most."""
    window = Window.partitionBy("doc").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    placed = found
    for k in range(most):
        here = F.col("lv") == k
        placed = placed.withColumn(f"p{k}", F.max(F.when(here, F.col("off"))).over(window)).withColumn(f"label{k}", F.last(F.when(here, F.col("label")), ignorenulls=True).over(window))
    crumbs, coarser = [], F.lit(-1)
    for k in range(most):
        crumbs.append(F.when(F.col(f"p{k}") > coarser, F.col(f"label{k}")))
        coarser = F.greatest(coarser, F.coalesce(f"p{k}", F.lit(-1)))
    ends = F.lead("off").over(Window.partitionBy("doc").orderBy("off"))
    sized = placed.withColumn("next_off", ends).join(docs.select("doc", F.length("txt").alias("len")), "doc")
    return sized.select("doc", F.col("off").alias("start_off"), F.coalesce("next_off", "len").cast("bigint").alias("end_off"), F.concat_ws(CRUMB, *crumbs).alias("breadcrumb"), F.col("name").alias("level_name"))


def gate(docs: DataFrame, cut: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """One row per document: the metrics of its segments and whether they are accepted.  Oversized
    segments are counted even where there are too few segments to pass."""
    size = F.col("end_off") - F.col("start_off")
    sizes = F.sort_array(F.collect_list(size))
    per = cut.groupBy("doc").agg(
        F.count("*").alias("n"),
        F.get(sizes, F.floor(F.count("*") / 2).cast("int")).alias("median_chars"),
        F.max(size).alias("max_chars"),
        F.count(F.when(size > ceiling, 1)).alias("oversized"),
        F.min("start_off").alias("first_off"),
    )
    rows = docs.select("doc", F.length("txt").alias("len")).join(per, "doc", "left")
    coverage = F.round((F.col("len") - F.coalesce("first_off", "len")) / F.greatest(F.lit(1), "len"), 6)
    n = F.coalesce("n", F.lit(0))
    whole = n <= F.greatest(F.lit(4), F.floor(F.col("len") / CHARS_PER_SEGMENT))
    sound = (n >= LEAST_SEGMENTS) & (F.col("coverage") >= COVERAGE) & whole
    over = F.coalesce("oversized", F.lit(0))
    return (
        rows.withColumn("coverage", coverage)
        .withColumn("passed", sound & (over == 0))
        .withColumn("sound_but_oversized", sound & (over > 0))
        .select("doc", n.alias("n"), F.coalesce("median_chars", F.lit(0)).alias("median_chars"), F.coalesce("max_chars", F.lit(0)).alias("max_chars"), over.alias("oversized"), "coverage", "passed", "sound_but_oversized")
    )


def induced(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Segments of every document under its own mined profile."""
    return segments(docs, headings(docs, mine(signatures(docs), min_count)))


def repaired(docs: DataFrame, cut: DataFrame, ceiling: int = CEILING, depth: int = REGION_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(segments, discovered): ``cut`` with each oversized segment replaced by the segments mined inside it, to a fixed
    depth, and the levels (doc, start_off, depth, lv, low, keyword, cls) that cut a region.  Text before the first inner
    heading stays as a segment under the outer breadcrumb."""
    size = F.col("end_off") - F.col("start_off")
    cut = materialise(cut)
    done, discovered = cut.where(size <= ceiling), None
    open_ = cut.where(size > ceiling)
    for level in range(depth):
        if level and open_.isEmpty():
            break
        keyed = open_.withColumn("key", F.struct("doc", "start_off"))
        spans = materialise(keyed.join(docs, "doc").select(F.col("key").alias("doc"), F.substr("txt", F.col("start_off") + 1, size).alias("txt")))
        mined = materialise(mine(signatures(spans), REGION_MIN_COUNT))
        inner = materialise(segments(spans, headings(spans, mined)))
        count = inner.groupBy("doc").agg(F.count("*").alias("parts"), F.min("start_off").alias("lead")).where("parts > 1").withColumnRenamed("doc", "key")
        levels = mined.withColumnRenamed("doc", "key").join(count.select("key"), "key", "left_semi").select("key.doc", "key.start_off", F.lit(level).alias("depth"), "lv", "low", "keyword", "cls")
        discovered = levels if discovered is None else discovered.unionByName(levels)
        outer = keyed.join(count, "key", "left")
        crumb = F.concat_ws(CRUMB, F.nullif(F.col("breadcrumb"), F.lit("")), F.col("i_crumb"))
        parts = inner.select(F.col("doc").alias("key"), F.col("start_off").alias("i_start"), F.col("end_off").alias("i_end"), F.col("breadcrumb").alias("i_crumb"), F.col("level_name").alias("i_level"))
        split = outer.where("parts is not null")
        found = split.join(parts, "key").select("doc", (F.col("start_off") + F.col("i_start")).alias("start_off"), (F.col("start_off") + F.col("i_end")).alias("end_off"), crumb.alias("breadcrumb"), F.col("i_level").alias("level_name"))
        lead = split.where("lead > 0").select("doc", "start_off", (F.col("start_off") + F.col("lead")).alias("end_off"), "breadcrumb", "level_name")
        done = done.unionByName(outer.where("parts is null").select(*done.columns)).unionByName(lead).unionByName(found.where(size <= ceiling))
        open_ = materialise(found.where(size > ceiling))
    return done.unionByName(open_), discovered


def regional(docs: DataFrame, cut: DataFrame, ceiling: int = CEILING, depth: int = REGION_DEPTH) -> DataFrame:
    """The segments of :func:`repaired`."""
    return repaired(docs, cut, ceiling, depth)[0]


def refined(docs: DataFrame, base: DataFrame, discovered: DataFrame) -> DataFrame:
    """The levels of ``base`` and those discovered in regions, one for each name, ordered by how
    often the name occurs in the whole text in any class, the rarest first.  Of levels with one name the last region's
    counts; names that occur equally often keep the order of the base, then of their discovery."""
    form = F.struct("keyword", "cls", "pattern").alias("form")
    rows = with_pattern(base).select("doc", "low", form, F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(-1).alias("depth"), F.col("lv").alias("lv")).alias("place"))
    new = discovered.withColumn("pattern", F.lit(None).cast("string"))
    rows = rows.unionByName(new.select("doc", "low", form, F.struct(F.col("start_off").cast("bigint").alias("at"), "depth", "lv").alias("place")))
    named = rows.groupBy("doc", "low").agg(F.max_by("form", "place").alias("form"), F.min("place").alias("place"))
    often = signatures(docs).groupBy("doc", "low").agg(F.sum("n").alias("n"))
    coarse = Window.partitionBy("doc").orderBy(F.coalesce("n", F.lit(0)), "place")
    return named.join(often, ["doc", "low"], "left").withColumn("lv", F.row_number().over(coarse) - 1).select("doc", "lv", "low", "form.*")


def rescore(cut: DataFrame, ceiling: int = CEILING) -> DataFrame:
    size = F.col("end_off") - F.col("start_off")
    return cut.groupBy("doc").agg(F.count("*").alias("segments"), F.max(size).alias("max_chars"), F.count(F.when(size > ceiling, 1)).alias("oversized"))


def level_order(found: DataFrame) -> DataFrame:
    """(doc, low, freq, lv): names ordered by how often they occur in any class, rarest first."""
    total = found.groupBy("doc", "low").agg(F.sum("n").alias("freq"), F.min("first_ln").alias("first_ln"))
    return total.withColumn("lv", F.row_number().over(Window.partitionBy("doc").orderBy("freq", "first_ln")) - 1).select("doc", "low", "freq", "lv")


def shipped_profiles(spark: SparkSession) -> DataFrame:
    """(fingerprint, variant, levels) of the profiles known from the start."""
    rows = [(fp, f"{fp}::" + "+".join(x[0] for x in lv), [(i, *x, None) for i, x in enumerate(lv)]) for fp, _, lv in SHIPPED]
    return spark.createDataFrame(rows, PROFILE)


def profile_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(fingerprint, variant, levels) of profile files, JSON or YAML of ``fingerprint`` and ``levels`` (``name`` and ``pattern``
    each, coarse to fine).  Of files with one variant, the one in the later folder counts, then the later name.  Files
    that cannot be read as that, or without a fingerprint, are left out."""

    def parse(text: str) -> list[tuple]:
        try:
            found = json.loads(text)
        except ValueError:
            try:
                import yaml

                found = yaml.safe_load(text)
            except Exception:  # whatever a parser finds wrong with a file
                return []
        try:
            levels = [(i, str(x["name"]), None, None, str(x["pattern"])) for i, x in enumerate(found["levels"])]
            mark = found.get("fingerprint")
        except (TypeError, KeyError, AttributeError):
            return []
        return [(str(mark), f"{mark}::" + "+".join(x[1] for x in levels), levels)] if mark and levels else []

    def run(batches):
        for pdf in batches:
            out = [(priority, path, *p) for priority, path, text in zip(pdf["priority"], pdf["path"], pdf["value"], strict=True) for p in parse(text)]
            yield pd.DataFrame(out, columns=["priority", "path", "fingerprint", "variant", "levels"])

    rows = spark.createDataFrame([], f"priority int, path string, {PROFILE}")
    for priority, folder in enumerate(folders):
        texts = spark.read.option("pathGlobFilter", "*.{json,yaml,yml}").text(folder, wholetext=True)
        rows = rows.unionByName(texts.select(F.lit(priority).alias("priority"), F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, rows.schema))
    best = rows.groupBy("fingerprint", "variant").agg(F.max_by("levels", F.struct("priority", "path")).alias("levels"))
    return best.select("fingerprint", "variant", "levels")


def variants(keys: DataFrame, levels: DataFrame) -> DataFrame:
    """(fingerprint, variant, file_name, levels) of mined profiles, one for each variant key."""
    rows = keys.join(profiles(levels), "doc")
    variant = F.concat(F.col("fingerprint"), F.lit("::"), F.array_join(F.col("levels")["name"], "+"))
    return rows.select("fingerprint", variant.alias("variant"), safe_name(variant).alias("file_name"), "levels", "doc").groupBy("fingerprint", "variant", "file_name").agg(F.min_by("levels", "doc").alias("levels"))


def merge_profiles(*by_priority: DataFrame) -> DataFrame:
    """Union by variant key; later tables win.  Profiles without a fingerprint are skipped."""
    union = None
    for k, table in enumerate(by_priority):
        part = table.where("fingerprint != ''").select("fingerprint", "variant", F.size("levels").alias("n_levels"), F.lit(k).alias("priority"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("fingerprint", "variant").agg(F.max_by("n_levels", "priority").alias("n_levels"), F.max("priority").alias("priority"))


def candidates(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc, variant, n_levels, richest, simplest): cached profiles of each document's fingerprint."""
    rows = keys.join(cache, "fingerprint")
    rank = lambda *order: F.row_number().over(Window.partitionBy("doc").orderBy(*order, "variant"))
    return rows.select("doc", "variant", "n_levels", rank(F.desc("n_levels")).alias("richest"), rank(F.asc("n_levels")).alias("simplest"))


def rungs(docs: DataFrame, mined: DataFrame, cached: DataFrame) -> DataFrame:
    """(doc, rung): the first rung of the ladder that accepts the document.  ``cached`` and ``mined`` are
    gate rows of the best cached and of the mined profile; the cache is a snapshot of before the batch."""
    flag = lambda t, p: t.groupBy("doc").agg(F.bool_or("passed").alias(f"{p}_ok"), F.bool_or("sound_but_oversized").alias(f"{p}_big"))
    rows = docs.select("doc").join(flag(cached, "c"), "doc", "left").join(flag(mined, "m"), "doc", "left")
    rung = (
        F.when(F.col("c_ok"), "2-cache").when(F.col("c_big"), "2-cache-regional").when(F.col("m_ok"), "3-linemine").when(F.col("m_big"), "3-linemine-regional").otherwise("6-token")
    )
    return rows.select("doc", rung.alias("rung"))


def by_cache(docs: DataFrame, cache: DataFrame, ceiling: int = CEILING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, gate rows, levels) of each document under the best cached profile of its fingerprint: the simplest that
    passes, or else the richest that is sound but oversized.  Documents without either have no rows.  ``cache`` holds
    (fingerprint, variant, levels) from before the batch."""
    keys = fingerprints(docs, signatures(docs))
    tried = candidates(keys, cache.select("fingerprint", "variant", F.size("levels").alias("n_levels")))
    tried = tried.join(keys, "doc").join(cache.select("fingerprint", "variant", "levels"), ["fingerprint", "variant"])
    key = F.struct("doc", "variant")
    tried = materialise(tried.withColumn("key", key))
    most = tried.agg(F.max(F.size("levels"))).first()[0] or MOST_LEVELS
    texts = tried.join(docs, "doc").select(F.col("key").alias("doc"), "txt")
    level = tried.select(F.col("key").alias("doc"), F.explode("levels").alias("l"))
    levels = level.select("doc", "l.lv", F.col("l.name").alias("low"), "l.keyword", "l.cls", "l.pattern")
    found = materialise(segments(texts, headings(texts, levels), max(most, MOST_LEVELS)))
    graded = gate(texts, found, ceiling).withColumnRenamed("doc", "key").join(tried.select("key", "simplest", "richest"), "key")
    rank = F.when(F.col("passed"), F.struct(F.lit(0).alias("rung"), F.col("simplest").alias("rank"))).when(F.col("sound_but_oversized"), F.struct(F.lit(1).alias("rung"), F.col("richest").alias("rank")))
    best = graded.where("passed or sound_but_oversized").groupBy(F.col("key.doc").alias("of")).agg(F.min_by("key", rank).alias("key"))
    best = materialise(best)
    chosen = lambda rows: rows.join(best.select(F.col("key").alias("doc")), "doc", "left_semi").withColumn("doc", F.col("doc.doc"))
    grades = graded.join(best.select("key"), "key", "left_semi")
    return chosen(found), grades.withColumn("doc", F.col("key.doc")).drop("key", "simplest", "richest"), chosen(levels)


def ladder(docs: DataFrame, cache: DataFrame, ceiling: int = CEILING) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(segments, rungs, levels) of every document: by a cached profile, by its own mined one, or (without segments) by
    tokens.  Sound but oversized segments are cut by region, and the profile is refined by the levels found there.  ``levels``
    are the profiles worth keeping: the mined ones that were accepted, and the refined ones."""
    cached, cached_gate, cached_levels = by_cache(docs, cache, ceiling)
    mined = materialise(mine(signatures(docs)))
    own = materialise(segments(docs, headings(docs, mined)))
    own_gate = materialise(gate(docs, own, ceiling))
    rung = materialise(rungs(docs, own_gate, cached_gate))
    on = lambda rows, *names: rows.join(rung.where(F.col("rung").isin(*names)).select("doc"), "doc", "left_semi")
    whole = on(cached, "2-cache").unionByName(on(own, "3-linemine"))
    large = on(cached, "2-cache-regional").unionByName(on(own, "3-linemine-regional"))
    cut, discovered = repaired(docs, large, ceiling)
    base = on(cached_levels, "2-cache-regional").select(LEVEL).unionByName(with_pattern(on(mined, "3-linemine-regional")))
    again = refined(on(docs, "2-cache-regional", "3-linemine-regional"), base, discovered)
    return whole.unionByName(cut), rung, [with_pattern(on(mined, "3-linemine", "3-linemine-regional")), again]
