"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with ``>`` are quotes; the number of marks is the level.  Runs of lines of one level are
passages.  Passages and their lines are normalised (lower case, white space squeezed) and hashed, and joined
within the conversation to the unquoted lines and texts of earlier messages; each is held to come from the latest
one that has it.  The lowest quote level that finds an original decides the message replied to: the one with most
quoted units, the latest if even.  A common line so makes one link a quote, not one for each message that has it.
Messages are keyed by conversation and a hash of their turn, role and text.  Conversations list each message after the one it replies to, replies by turn, without quotes and attribution lines.

Defined results: null texts are empty messages; messages that quote nothing known start a branch of their own,
in order of turn; rows repeated in all of id, turn, role and text count once, other rows that share a turn (ties)
stay apart, in order of their hash; rows with a null id form one conversation, null turns come first and link to
nothing; very long messages are cut into lines like others; an empty table gives an empty result; other columns are
not read, whatever their names.  A conversation is one row of the result, so it must fit in a row, and so must the
paths of a chain of replies, which grow with the square of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

QUOTE = r"^(?:[ \t]*>)+[ \t]?"
#: A line that only introduces a quotation.
ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$"


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with ``body``, units): a unit is a passage or line with its level (0: the author's own)."""
    lines = messages.select("conv", "turn", "mid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", QUOTE, 0)
    lines = lines.select("conv", "turn", "mid", "pos", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", QUOTE, "").alias("line"))
    lines = lines.where(~((F.col("level") == 0) & F.col("line").rlike(ATTRIBUTION)))
    by_message = Window.partitionBy("conv", "mid").orderBy("pos")
    turned = F.when(F.col("level") == F.lag("level").over(by_message), 0).otherwise(1)
    passages = (
        lines.withColumn("turned", turned)
        .withColumn("run", F.sum("turned").over(by_message))
        .groupBy("conv", "turn", "mid", "run", "level")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    )
    own = F.array_join(F.flatten(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.col("lines")))))["line"], "\n")
    bodies = passages.groupBy(F.col("conv").alias("b_conv"), F.col("mid").alias("b_mid")).agg(F.trim(own).alias("body"), F.max(F.col("level") > 0).alias("quotes"))
    whole = F.array_join(F.col("lines")["line"], " ")
    units = passages.select("conv", "turn", "mid", "level", F.explode(F.array_distinct(F.transform(F.array_append(F.col("lines")["line"], whole), _normal))).alias("unit")).where("unit != ''")
    return bodies, units.select("conv", "turn", "mid", "level", F.xxhash64("unit").alias("unit"))


def reply_links(units: DataFrame) -> DataFrame:
    """(l_conv, l_mid, parent, parent_turn) of every message that quotes an earlier one."""
    dated = units.where("turn is not null").select("conv", "unit", "turn", "mid", F.col("level").alias("level")).distinct()
    asked = dated.where("level > 0").select(F.col("conv").alias("a_conv"), F.col("unit").alias("a_unit")).distinct()
    known = dated.join(asked, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("unit") == F.col("a_unit")), "left_semi")
    before = Window.partitionBy("conv", "unit").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("level") == 0, F.struct("turn", "mid"))).over(before)
    quoted = known.withColumn("from", latest).where("level > 0 and from is not null")
    votes = quoted.groupBy("conv", "mid", "level", "from").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv", "mid").agg(F.max(F.struct(-F.col("level"), "n", "from")).alias("best"))
    return best.select(F.col("conv").alias("l_conv"), F.col("mid").alias("l_mid"), F.col("best.from.mid").alias("parent"), F.col("best.from.turn").alias("parent_turn"))


def threads(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, parent_turn, ``path`` (turns and keys from the
    start of its branch, which sorts messages in reply order) and ``body`` without quotes."""
    columns = [F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text")]
    messages = df.select(*columns).distinct().withColumn("mid", F.xxhash64("turn", "role", "text"))
    bodies, units = parse(messages)
    units = cut(units)
    links = cut(reply_links(units))
    # paths by doubling: every round joins what is known of the message at the head of each path
    step = F.struct("turn", "mid")
    replies = F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("mid") == F.col("l_mid"))
    linked = messages.select("conv", "turn", "mid").join(links, replies, "left").select("conv", "mid", F.array(step).alias("path"), F.col("parent").alias("head"), "parent_turn")
    paths = cut(linked)
    while not paths.where("head is not null").isEmpty():
        ahead = paths.select(F.col("conv").alias("h_conv"), F.col("mid").alias("h_mid"), F.col("path").alias("h_path"), F.col("head").alias("h_head"))
        waiting = paths.where("head is not null").join(ahead, F.col("conv").eqNullSafe(F.col("h_conv")) & (F.col("head") == F.col("h_mid")))
        moved = waiting.select("conv", "mid", F.concat("h_path", "path").alias("path"), F.col("h_head").alias("head"), "parent_turn")
        paths = cut(paths.where("head is null").unionByName(moved))
    of = lambda conv, mid: F.col("conv").eqNullSafe(F.col(conv)) & (F.col("mid") == F.col(mid))
    placed = messages.select("conv", "turn", "role", "mid").join(bodies, of("b_conv", "b_mid"), "left")
    placed = placed.join(paths.select(F.col("conv").alias("p_conv"), F.col("mid").alias("p_mid"), "path", "parent_turn"), of("p_conv", "p_mid"))
    return placed.select(F.col("conv").alias(id_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "parent_turn", "path", F.coalesce("quotes", F.lit(False)).alias("quotes"), F.coalesce("body", F.lit("")).alias("body"))


def conversations(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: its messages in reply order as one chat text, with counts."""
    rows = threads(df, id_col)
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "role", "body"))), lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("")), F.lit("|>\n"), m["body"])), "\n")
    return rows.groupBy(id_col).agg(
        F.count("*").alias("n_messages"), F.count(F.when(F.col("quotes"), 1)).alias("n_quoting"), F.count("parent_turn").alias("n_linked"), chat.alias("chat")
    )


#: DuckDB SQL for the query over the registered table.
ORACLE_SQL = r"""
with recursive m as (select row_number() over () mid, * from (select distinct conv_id, turn, role, text from conversations)),
l0 as (select mid, conv_id, turn, unnest(range(1, len(s) + 1)) pos, unnest(s) line from (select mid, conv_id, turn, string_split(coalesce(text, ''), chr(10)) s from m)),
l as (
  select mid, conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) lev, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') line
  from l0 where not (line not like '%>%' and regexp_matches(line, '(?i)^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$'))),
g as (select *, sum(t) over (partition by mid order by pos) run from (select *, case when lev = lag(lev) over (partition by mid order by pos) then 0 else 1 end t from l)),
u0 as (select mid, conv_id, turn, lev, line unit from g union all select mid, conv_id, turn, lev, string_agg(line, ' ' order by pos) from g group by mid, conv_id, turn, lev, run),
u as (select distinct mid, conv_id, turn, lev, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) unit from u0),
w as (
  select q.mid, q.lev, q.unit, max(struct_pack(t := o.turn, k := o.mid)) o from u q join u o
  on q.conv_id is not distinct from o.conv_id and q.unit = o.unit and o.lev = 0 and q.lev > 0 and o.turn < q.turn and q.unit <> '' group by all),
v as (select mid, lev, o.k parent, o.t parent_turn, count(*) n from w group by all),
b as (select mid, parent, parent_turn from v qualify row_number() over (partition by mid order by lev, n desc, parent_turn desc, parent desc) = 1),
p as (
  select m.mid, [struct_pack(t := m.turn, k := m.mid)] path from m where m.mid not in (select mid from b)
  union all select b.mid, list_append(p.path, struct_pack(t := m.turn, k := m.mid)) from p join b on b.parent = p.mid join m on m.mid = b.mid),
body as (select mid, trim(coalesce(string_agg(case when lev = 0 then line end, chr(10) order by pos), '')) body, bool_or(lev > 0) quotes from g group by mid)
select m.conv_id, count(*) n_messages, count(case when quotes then 1 end) n_quoting, count(b.parent) n_linked,
       string_agg('<|' || coalesce(m.role, '') || '|>' || chr(10) || coalesce(body, ''), chr(10) order by p.path) chat
from m left join body on body.mid = m.mid left join b on b.mid = m.mid join p on p.mid = m.mid group by m.conv_id
"""
