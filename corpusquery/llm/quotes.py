"""Quotation linking of threaded messages, with DataFrame functions only.

A line's quote level is the number of ``>`` in front of it. Lines without one are a message's own, its body. Passages are
normalised lines: without the marks, in lower case, white space made one space. A quoted passage is linked to its
original, the earliest message of the conversation that has the passage in its body and stands before the quoting one.
Passages are joined by two 64-bit hashes and compared as texts.

A message replies to the message that most of its passages of level 1 come from (of several, the latest). Messages without
such a link begin a thread. A conversation is ordered by thread (its first turn), then by turn: every reply follows what
it answers.

Originals are aggregated before they are joined, so a very common line is one row on that side; positions are summed by
blocks of turns, then by ranges of threads, so a conversation of very many messages isn't gathered in a task. A null text is
empty, with an empty body; a very long one is one row. Rows without conversation or turn are left out. Rows of the same
conversation and turn share their links and have neighbouring positions in the order of role and body. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, read

#: Turns, and first turns of threads, that are counted together for the positions.
BLOCK_TURNS, RANGE_TURNS = 256, 4096
#: One character class behind the first mark: a repeated group would be walked by recursion, too deep for a line of many marks.
_MARKS = r"^[ \t]*>[> \t]*"


def parsed(text: Column) -> Column:
    """Array of (level, line): the text's lines with their quote levels, without the marks."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">")))
        return F.struct(level.alias("level"), F.substr(line, F.length(marks) + 1).alias("line"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r]+", " ")))


def _passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage and its hashes, of all lines that aren't blank."""
    each = messages.select("conv_id", "turn", F.explode("lines").alias("l")).select("conv_id", "turn", "l.level", normalised(F.col("l.line")).alias("passage"))
    return each.filter("passage <> ''").withColumns({"h1": F.xxhash64(F.lit(0), "passage"), "h2": F.xxhash64(F.lit(1), "passage")})


def links(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, lines) -> conv_id, turn, level, origin (a turn), n: passages of that level that come from there."""
    passages = _passages(messages)
    quoted = passages.filter("level > 0")
    keys = ["conv_id", "h1", "h2", "passage"]
    first = passages.filter("level = 0").groupBy(*keys).agg(F.min("turn").alias("origin"))
    return quoted.join(first, keys).filter("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))


def _threads(replies: DataFrame) -> DataFrame:
    """replies(conv_id, turn, reply_to) -> conv_id, turn, root, depth, by doubling: each round follows as far as all rounds before."""
    now = replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        now = materialise(now, "threads")
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        if now.join(up, ["conv_id", "root"], "left_semi").isEmpty():
            return now
        now = now.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def threaded(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> conv_id, turn, role, body (the own lines), n_quoted and n_linked (passages that are quoted, and that have an original),
    reply_to (a turn, or null), root (the thread's first turn), depth (replies from there) and position (from 0, in the conversation's order)."""
    rows = messages.select("conv_id", "turn", "role", parsed(F.col("text")).alias("lines")).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"])
    quotes = F.filter("lines", lambda x: (x["level"] > 0) & (normalised(x["line"]) != ""))
    found = materialise(links(rows), "links")
    counts = found.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.struct("n", "origin")))["origin"].alias("reply_to"))
    counts = materialise(counts, "replies")
    roots = _threads(counts.filter("reply_to IS NOT NULL"))
    told = counts.join(roots, ["conv_id", "turn"], "left")
    out = rows.select("conv_id", "turn", "role", F.trim(F.array_join(own, "\n"), F.lit(" \n\t\r")).alias("body"), F.size(quotes).cast("long").alias("n_quoted"))
    out = out.join(told, ["conv_id", "turn"], "left").withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    out = out.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    by_block = out.groupBy("conv_id", "root", "block").agg(F.count("*").alias("n"))
    by_block = by_block.withColumn("range", F.floor(F.col("root") / RANGE_TURNS))
    ranges = by_block.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("conv_id", "range", (F.sum("n").over(W.partitionBy("conv_id").orderBy("range")) - F.col("n")).alias("start"))
    within = F.sum("n").over(W.partitionBy("conv_id", "range").orderBy("root", "block")) - F.col("n")
    before = by_block.withColumn("within", within).join(ranges, ["conv_id", "range"]).select("conv_id", "root", "block", (F.col("start") + F.col("within")).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "root", "block").orderBy("turn", "role", "body"))
    out = out.withColumn("inside", inside).join(before, ["conv_id", "root", "block"])
    return out.select("conv_id", "turn", "role", "body", "n_quoted", "n_linked", "reply_to", "root", "depth", (F.col("before") + F.col("inside") - 1).alias("position"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threaded(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT id, conv_id, turn, i, len(marks) - len(replace(marks, '>', '')) AS level, substr(line, len(marks) + 1) AS line
  FROM (SELECT id, conv_id, turn, i, line, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+') AS marks FROM (SELECT id, conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM m))),
p AS (SELECT *, lower(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'))) AS passage FROM l),
f AS (SELECT conv_id, passage, min(turn) AS origin FROM p WHERE level = 0 AND passage <> '' GROUP BY 1, 2),
k AS (SELECT p.conv_id, p.turn, p.level, f.origin, count(*) AS n FROM p JOIN f ON f.conv_id = p.conv_id AND f.passage = p.passage WHERE p.level > 0 AND f.origin < p.turn GROUP BY 1, 2, 3, 4),
r AS (SELECT conv_id, turn, sum(n)::BIGINT AS n_linked, max(CASE WHEN level = 1 THEN {'n': n, 'origin': origin} END).origin AS reply_to FROM k GROUP BY 1, 2),
t AS (SELECT DISTINCT conv_id, turn AS start, turn AS here, 0 AS depth FROM m UNION ALL SELECT t.conv_id, t.start, r.reply_to, t.depth + 1 FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.here WHERE r.reply_to IS NOT NULL),
o AS (SELECT conv_id, start, min(here) AS root, max(depth) AS depth FROM t GROUP BY 1, 2),
b AS (SELECT id, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), ' ' || chr(10) || chr(9) || chr(13)) AS body, count(*) FILTER (WHERE level > 0 AND passage <> '') AS n_quoted FROM p GROUP BY 1)
SELECT m.conv_id, m.turn, m.role, b.body, b.n_quoted, coalesce(r.n_linked, 0)::BIGINT AS n_linked, r.reply_to, o.root, o.depth::BIGINT AS depth,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY o.root, m.turn // 256, m.turn, m.role, b.body) - 1 AS position
FROM m JOIN b USING (id) JOIN o ON o.conv_id = m.conv_id AND o.start = m.turn LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""
