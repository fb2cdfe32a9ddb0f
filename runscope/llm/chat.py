"""Quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of > marks at its beginning (white space between
them allowed). Consecutive lines of one level are a passage. Passages are normalised
(A-Z in lower case, white space runs as one space) and hashed, whole and line by line.
A quoted passage or line refers to the latest earlier message of its conversation
that has it unquoted; a message replies to the latest message that its least nested
linked quotes refer to. The quotes go; each message carries its parent and the root of
its reply chain, so that (conv_id, root_turn, turn) is the reply order.

Only DataFrame functions. Passages are built inside a row. The link join is on
(conversation, hash) and takes only messages that quote on one side; on the other, a
frequent passage is first reduced to one row a message. No conversation is gathered.

Null texts are empty messages. Rows with a null conv_id or turn come back without a
parent. Repeated rows come back each. Messages without quotes have no parent and are
their own root. Very long messages are one row, and their work grows with their length. An empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

MARK = r"^[ \t]*((?:>[ \t]?)+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(x, _UPPER, _LOWER), r"[ \t-\r]+", " "), "^ | $", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _passages(text: Column) -> Column:
    """array<struct<level, content>> of the consecutive lines of one level; each line is looked at and copied once."""
    line = F.transform(F.split(text, "\n"), lambda l: F.struct(F.length(F.regexp_replace(F.regexp_extract(l, MARK, 1), "[^>]", "")).alias("level"), F.regexp_replace(l, MARK, "").alias("content")))

    def starts(lines: Column) -> Column:
        """The places, from 1, of lines whose level isn't that of the line before, and the place after the last line."""
        levels = F.transform(lines, lambda x: x["level"])
        before = F.concat(F.array(F.lit(-1)), levels)  # one longer; its last has no line
        new = F.zip_with(levels, before, lambda x, y: ~x.eqNullSafe(y))
        return F.filter(F.transform(new, lambda n, i: F.when(n, i + 1)), lambda i: i.isNotNull())

    def cut(lines: Column, at: Column) -> Column:
        content = lambda i, j: F.array_join(F.transform(F.slice(lines, i, j - i), lambda x: x["content"]), "\n")
        spans = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda i, j: F.struct(i.alias("i"), j.alias("j")))
        return F.transform(spans, lambda p: F.struct(F.element_at(lines, p["i"])["level"].alias("level"), content(p["i"], p["j"]).alias("content")))

    return _let(line, lambda lines: _let(starts(lines), lambda at: cut(lines, at)))


def _units(passage: Column) -> Column:
    """The passage and its lines, normalised; no empty ones."""
    return _let(passage, lambda p: F.array_distinct(F.filter(F.concat(F.array(_normal(p)), F.transform(F.split(p, "\n"), _normal)), lambda u: u != "")))


def reply_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes (quoted passages), parent_turn, root_turn."""
    m = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    m = m.withColumn("p", F.when(quoting, _passages(F.col("text"))).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("content")))))
    own = lambda: F.array_join(F.transform(F.filter("p", lambda y: y["level"] == 0), lambda y: y["content"]), "\n")
    quotes = m.where(quoting & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(F.filter("p", lambda y: y["level"] > 0)).alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(_units(F.col("q.content"))).alias("u")).select("conv_id", "turn", "level", F.xxhash64("u").alias("h"), F.length("u").alias("n")).distinct()
    quotes = written(quotes, "quotes")
    from_turn = m.select("conv_id", F.col("turn").alias("source"), F.explode(_units(own())).alias("u")).select("conv_id", "source", F.xxhash64("u").alias("h"), F.length("u").alias("n"))
    wanted = from_turn.join(quotes.select("conv_id", "h", "n").distinct(), ["conv_id", "h", "n"], "left_semi").distinct()
    # as of each quote, the latest message that said it before: one sort of both, no pair of a quote and every source
    asked = quotes.select("conv_id", "h", "n", F.col("turn").alias("t"), F.lit(0).alias("o"), "level", F.lit(None).cast("long").alias("source"))
    said = wanted.select("conv_id", "h", "n", F.col("source").alias("t"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("level"), "source")
    before = Window.partitionBy("conv_id", "h", "n").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    link = asked.unionByName(said).withColumn("source", F.last("source", True).over(before)).where("o = 0 and source is not null")
    link = link.select("conv_id", F.col("t").alias("turn"), "level", "source")
    parent = link.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), F.col("source"))).alias("parent_turn"))
    chain = written(parent.withColumn("root_turn", F.col("parent_turn")), "replies")
    while True:  # doubles the known part of every reply chain; only messages with a parent are in it
        up = chain.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("further"))
        step = written(chain.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", "parent_turn", F.coalesce("further", "root_turn").alias("root_turn"), F.col("further").isNotNull().alias("moved")), "replies")
        chain = step.drop("moved")
        if not step.where("moved").take(1):
            break
    n_quotes = F.size(F.filter("p", lambda y: y["level"] > 0)).cast("long")
    return m.join(chain, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", own().alias("text"), n_quotes.alias("n_quotes"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"))


_MARK = r"^[ \t]*((?:>[ \t]?)+)"
_N = rf"regexp_replace(regexp_replace(translate(%s, '{_UPPER}', '{_LOWER}'), '[ \t-\r]+', ' ', 'g'), '^ | $', '', 'g')"
SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT id, k, length(regexp_replace(regexp_extract(l, '{_MARK}', 1), '[^>]', '', 'g')) AS level, regexp_replace(l, '{_MARK}', '') AS content
      FROM (SELECT id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM m)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY id, level ORDER BY k) AS grp FROM l),
p AS (SELECT id, level, min(k) AS k, string_agg(content, chr(10) ORDER BY k) AS content FROM g GROUP BY id, level, grp),
o AS (SELECT id, string_agg(content, chr(10) ORDER BY k) AS own FROM p WHERE level = 0 GROUP BY id),
u AS (SELECT id, level, {_N % "x"} AS u FROM (SELECT id, level, content AS x FROM p WHERE level > 0 UNION ALL SELECT id, level, unnest(string_split(content, chr(10))) FROM p WHERE level > 0)),
s AS (SELECT id, {_N % "x"} AS u FROM (SELECT id, own AS x FROM o UNION ALL SELECT id, unnest(string_split(own, chr(10))) FROM o)),
link AS (SELECT a.id, u.level, u.u, max(b.turn) AS source FROM u JOIN m a ON a.id = u.id JOIN s ON s.u = u.u JOIN m b ON b.id = s.id
         WHERE u.u <> '' AND a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY a.id, u.level, u.u),
par AS (SELECT DISTINCT m.conv_id, m.turn, x.parent FROM (SELECT id, arg_max(source, -level * 1000000000 + source) AS parent FROM link GROUP BY id) x JOIN m ON m.id = x.id),
up AS (SELECT conv_id, turn, parent AS root FROM par UNION SELECT up.conv_id, up.turn, par.parent FROM up JOIN par ON par.conv_id = up.conv_id AND par.turn = up.root),
root AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, coalesce(o.own, '') AS text, (SELECT count(*) FROM p WHERE p.id = m.id AND p.level > 0) AS n_quotes, par.parent AS parent_turn, coalesce(root.root, m.turn) AS root_turn
FROM m LEFT JOIN o ON o.id = m.id LEFT JOIN par ON par.conv_id = m.conv_id AND par.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
