"""Quotation linking: reply-ordered conversations without quotes.

Quote levels are the leading ``>`` marks of a line. Lines of one level that follow each other
are a passage. Passages, and their lines, are normalised and hashed and joined to the messages
of the same conversation whose own text, or a line of it, has that hash; the earliest such
message is the original. A message answers the latest original among its first-level
passages. Threads follow these answers; messages are laid out by thread and turn, so a reply
comes after what it answers, and a conversation of any length is split over files.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.llm.common import stored, table
from seqspark.operators.ordering import parallelism

QUOTE = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"
MARKS = r"^(?:[ \t]*>)+"
#: A line that introduces a quotation, just before it.
INTRO = r"(?m)^[^\n>]*(?:wrote|writes|schrieb|a écrit|escribió)[ ]?:[ \t]*\n(?=[ \t]*>)"


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def unquoted(text: Column) -> Column:
    """The message's own words: no quoted lines, no line that introduces them."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, INTRO, ""), QUOTE, ""), F.lit(" \t\r\n"))


def passages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage, line_no, text)`` per quoted line; messages are told
    apart by conversation, turn and text, and numbered passages by level."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", F.xxhash64("text").alias("_m"), "text").distinct()
    rows = quoting.select("conv_id", "turn", "_m", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    rows = rows.withColumn("level", F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).filter("level > 0")
    # One message is one window: its lines are one text.
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn", "_m", "level").orderBy("line_no"))
    return rows.select(
        "conv_id", "turn", "_m", "level", (F.col("line_no") - nth).alias("passage"), "line_no",
        normalised(F.regexp_replace("line", MARKS, "")).alias("text"),
    )


def quotations(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage, quoted, original)`` per quoted passage.

    ``original`` is the turn of the message it comes from: the earliest one whose whole own
    text is the passage, else the one that most of the passage's lines come from (the latest
    of equals), else null. Only earlier turns count.
    """
    messages = messages.select("conv_id", "turn", "text").dropna()
    lines = stored(passages(messages), "quotes")
    key = ["conv_id", "turn", "_m", "level", "passage"]
    whole = lines.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "text")))["text"], " ").alias("quoted"))
    whole = whole.withColumn("quoted", F.trim(F.regexp_replace("quoted", " +", " ")))
    units = whole.select(*key, F.col("quoted").alias("unit"), F.lit(True).alias("whole"))
    units = units.union(lines.select(*key, "text", F.lit(False))).filter("unit <> ''").withColumn("hash", F.xxhash64("unit"))
    # Originals: the own text of messages of conversations that have quotes, and its lines.
    own = messages.join(lines.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", unquoted(F.col("text")).alias("own"))
    texts = own.select("conv_id", "turn", F.explode(F.array_union(F.array("own"), F.split("own", "\n"))).alias("unit"))
    first = texts.select("conv_id", "turn", F.xxhash64(normalised(F.col("unit"))).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    met = units.join(first, ["conv_id", "hash"]).filter("original < turn")
    votes = met.groupBy(*key, "original").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    best = votes.groupBy(*key).agg(F.max_by("original", F.struct("whole", "n", "original")).alias("original"))
    return whole.join(best, key, "left").select("conv_id", "turn", "level", "passage", "quoted", "original")


def threads(answers: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread)``: the first message reached from each answering message.

    Links double their length in each round, so rounds are logarithmic in the longest chain.
    """
    links = stored(answers.select("conv_id", "turn", F.col("reply_to").alias("thread")), "threads")
    while True:
        up = links.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"))
        longer = links.join(up, ["conv_id", "thread"], "left")
        longer = stored(longer.select("conv_id", "turn", F.coalesce("_up", "thread").alias("thread"), F.col("_up").isNotNull().alias("_moved")), "threads")
        moved = longer.filter("_moved").limit(1).count()
        links = longer.drop("_moved")
        if not moved:
            return links


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, laid out by conversation, thread and turn.

    Returns ``conv_id``, ``turn``, ``role``, ``reply_to`` (turn answered, null without a
    linked quotation), ``thread`` (turn its chain of answers begins with), ``quotes`` and
    ``linked`` (passages, and those with an original), ``content`` (own text) and ``chat``
    (content with its role's mark; a null role is ``user``). A null text is empty; a message
    without conversation or turn keeps its row and links to nothing. Repeated rows stay;
    messages that share conversation and turn share their links. Passages and originals
    longer than a line may match line by line.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    found = stored(quotations(rows), "quotations")
    per = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("quotes"), F.count("original").alias("linked"), F.max(F.when(F.col("level") == 1, F.col("original"))).alias("reply_to")
    )
    per = stored(per, "answers")
    roots = threads(per.filter("reply_to is not null"))
    out = rows.join(per, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    content = unquoted(F.coalesce("text", F.lit("")))
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"))
    out = out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("linked", F.lit(0)).alias("linked"), content.alias("content"),
    ).withColumn("chat", F.concat(mark, "content"))
    order = ["conv_id", "thread", "turn"]
    return out.repartitionByRange(parallelism(out), *order).sortWithinPartitions(*order)


def op10_quotation_linking(spark, sf_dir) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^[^\n>]*(?:wrote|writes|schrieb|a écrit|escribió)[ ]?:[ \t]*\n([ \t]*>)', '\1', 'g'),
      '(?m)^[ \t]*>[^\n]*(?:\n|\z)', '', 'g'), E' \t\r\n') AS own
  FROM conversations),
l AS (SELECT conv_id, turn, hash(text) AS m, unnest(string_split(text, E'\n')) AS line, unnest(range(len(string_split(text, E'\n')))) AS line_no
  FROM (SELECT DISTINCT conv_id, turn, text FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
q AS (SELECT conv_id, turn, m, line_no, len(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS text FROM l),
p AS (SELECT *, line_no - row_number() OVER (PARTITION BY conv_id, turn, m, level ORDER BY line_no) AS passage FROM q WHERE level > 0),
w AS (SELECT conv_id, turn, m, level, passage, trim(regexp_replace(string_agg(text, ' ' ORDER BY line_no), ' +', ' ', 'g')) AS quoted FROM p GROUP BY ALL),
u AS (SELECT conv_id, turn, m, level, passage, quoted AS unit, true AS whole FROM w UNION ALL SELECT conv_id, turn, m, level, passage, text, false FROM p),
o AS (SELECT conv_id, min(turn) AS original, unit FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(unnest(list_distinct(list_concat([own], string_split(own, E'\n'))))), '[^\p{L}\p{N}]+', ' ', 'g')) AS unit FROM m) GROUP BY conv_id, unit),
v AS (SELECT u.conv_id, u.turn, m, level, passage, original, max(whole) AS whole, count(*) AS n
  FROM u JOIN o ON u.conv_id = o.conv_id AND u.unit = o.unit AND original < u.turn WHERE u.unit <> '' GROUP BY ALL),
b AS (SELECT conv_id, turn, m, level, passage, arg_max(original, (whole, n, original)) AS original FROM v GROUP BY ALL),
a AS (SELECT w.conv_id, w.turn, count(*) AS quotes, count(original) AS linked, max(original) FILTER (level = 1) AS reply_to
  FROM w LEFT JOIN b USING (conv_id, turn, m, level, passage) GROUP BY ALL),
r AS (SELECT conv_id, turn, reply_to AS thread FROM a WHERE reply_to IS NOT NULL
  UNION ALL SELECT r.conv_id, r.turn, a.reply_to FROM r JOIN a ON r.conv_id = a.conv_id AND r.thread = a.turn WHERE a.reply_to IS NOT NULL),
t AS (SELECT conv_id, turn, min(thread) AS thread FROM r GROUP BY ALL)
SELECT m.conv_id, m.turn, role, reply_to, coalesce(thread, m.turn) AS thread, coalesce(quotes, 0) AS quotes, coalesce(linked, 0) AS linked,
  own AS content, '<|' || coalesce(role, 'user') || E'|>\n' || own AS chat
FROM m LEFT JOIN a ON m.conv_id = a.conv_id AND m.turn = a.turn LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn
"""
