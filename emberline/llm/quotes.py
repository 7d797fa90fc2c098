"""Quotation linking: which message a message answers, from the passages it quotes.

DataFrame functions only. A quoted line starts with one or more ``>`` (blanks between them allowed);
their number is its level. Lines are normalised (markers off, lower-cased, everything but letters
and digits one blank). Consecutive lines of one level are a passage; its lines, its paragraphs
(parts between empty lines) and the passage as a whole, their lines joined by blanks, are hashed, so
a quotation that is wrapped anew still meets the text it was taken from. The own text of a message
(level 0) is cut and hashed in the same way.

Each quoted piece links to the newest earlier message of its conversation that holds it as its own.
At each level the message whose linked pieces have most characters is the original, the newer one if
two have as many. A message answers the original of its lowest level that has one: where the message
quoted directly is missing or was changed, the next deeper level decides. Following the answers up
gives a message's thread (the turn of the first message) and depth. ``reply_order`` ranks the
messages of a conversation by thread, then turn, which puts every answer after what it answers. The
text comes without quoted lines and without the line that introduces them ("... wrote:").

The newest earlier holder of a piece is found per block of ``BLOCK`` turns and by the newest holder
of all blocks before, so a line that a whole large conversation repeats is spread over its blocks;
no quoted piece ever meets more than one row per block. Ranks are sums over blocks as well.

Defined cases: a null text stays null and quotes nothing; messages that quote nothing, or nothing
that an earlier message holds, answer nobody: reply_to is null, thread their own turn, depth 0;
empty pieces link nothing, a piece that a message quotes twice at a level counts once; rows that
repeat conversation and turn are all kept and share their links and rank; rows of null conversation
or turn are kept without links and rank; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.session import cut_lineage

BLOCK = 1024
# Verbs that introduce a quotation.
INTRODUCED = "wrote|writes|schrieb|escribió|a écrit"
MARK = r"^[ \t]*>"
_LINE = r"(?md)^[ \t]*>[^\n]*\n?"
# The last line of a passage: the line after it has another number of marks.
_LAST_OF_LEVEL = r"(?m)^(>*)([^>\n][^\n]*|)\n(?!\1(?!>))"
_INTRO = rf"(?md)^[^\n>]*(?:{INTRODUCED})[ ]?:[ \t]*\n([ \t]*>)"


def marks(line: Column) -> Column:
    """The quotation marks a line starts with, without the blanks between them."""
    return F.regexp_replace(F.regexp_extract(line, r"^([ \t>]*)", 1), "[^>]", "")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def passages(text: Column) -> Column:
    """Array of passages: consecutive lines of one level, each line its marks and its normal form."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(marks(x), normal(x)))
    return F.split(F.regexp_replace(F.array_join(lines, "\n"), _LAST_OF_LEVEL, "$1$2\x02"), "\x02")


def pieces(passage: Column) -> Column:
    """The different lines and paragraphs of a passage, and the passage itself, none of them empty."""
    plain = F.regexp_replace(passage, ">", "")
    joined = F.transform(F.split(plain, "\n\n+"), lambda x: F.trim(F.regexp_replace(x, "\n", " ")))
    whole = F.trim(F.regexp_replace(plain, "\n+", " "))
    return F.array_distinct(F.filter(F.concat(F.split(plain, "\n"), joined, F.array(whole)), lambda x: x != ""))


def without_quotes(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, _INTRO, "$1"), _LINE, ""), F.lit(" \t\n"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original) of every level at which a message quotes an earlier one."""
    sound = messages.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", "text")
    quoting = sound.where(F.col("text").rlike(f"(?m){MARK}"))

    def hashed(of: DataFrame) -> DataFrame:
        parts = of.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("passage"))
        every = parts.select("conv_id", "turn", F.length(marks(F.col("passage"))).alias("level"), F.explode(pieces(F.col("passage"))).alias("piece"))
        return every.select("conv_id", "turn", "level", F.md5("piece").alias("hash"), F.length("piece").cast("long").alias("weight"))

    asked = hashed(quoting).where("level > 0").distinct()
    # Only conversations and pieces that are quoted somewhere.
    wanted = asked.select("conv_id", "hash").distinct()
    talks = quoting.select("conv_id").distinct()
    held = hashed(sound.join(talks, "conv_id", "left_semi")).where("level = 0").join(
        wanted, ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "turn").distinct()

    block = F.floor(F.col("turn") / BLOCK).alias("block")
    key = ["conv_id", "hash", "block"]
    newest = held.groupBy("conv_id", "hash", block).agg(F.max("turn").alias("newest"))
    # Within a block: holders and askers in one order, holders of a turn after its askers.
    nothing = F.lit(None).cast("long")
    both = held.select("conv_id", "hash", block, "turn", F.col("turn").alias("holder"), nothing.cast("int").alias("level"), nothing.alias("weight"))
    both = both.unionByName(asked.select("conv_id", "hash", block, "turn", nothing.alias("holder"), "level", "weight"))
    inside = Window.partitionBy(*key).orderBy("turn", F.col("weight").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("holder").over(inside)).where("weight is not null")
    # Across blocks: one row per block.
    blocks = newest.select(*key, "newest").unionByName(
        near.where("near is null").select(*key).distinct().withColumn("newest", nothing))
    before = Window.partitionBy("conv_id", "hash").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    older = blocks.groupBy(*key).agg(F.max("newest").alias("newest")).select(*key, F.max("newest").over(before).alias("far"))
    linked = near.join(older, key, "left").select(
        "conv_id", "turn", "level", F.coalesce("near", "far").alias("original"), "weight").where("original is not null")
    votes = linked.groupBy("conv_id", "turn", "level", "original").agg(F.sum("weight").alias("votes"))
    return votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("votes", "original")).alias("best")).select(
        "conv_id", "turn", "level", F.col("best.original").alias("original"))


def answers(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, originals) of every message that quotes an earlier one.

    originals is an array of (level, original), lowest level first.
    """
    levels = originals(messages).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("level", "original"))).alias("originals"))
    return levels.select("conv_id", "turn", F.col("originals")[0]["original"].alias("reply_to"), "originals")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, thread, turn, n) with reply_order: 1 + the n of all smaller (thread, turn) of the conversation.

    No window holds more rows than a block has numbers, or a conversation blocks.
    """
    conv, thread = ["conv_id"], ["conv_id", "thread"]
    rows = rows.withColumn("tb", F.floor(F.col("thread") / BLOCK)).withColumn("b", F.floor(F.col("turn") / BLOCK))

    def before(frame: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))

    of_block = rows.groupBy(*thread, "tb", "b").agg(F.sum("n").alias("n"))
    of_thread = of_block.groupBy(*thread, "tb").agg(F.sum("n").alias("n"))
    of_threads = of_thread.groupBy("conv_id", "tb").agg(F.sum("n").alias("n"))
    first = before(of_threads, conv, "tb", "n", "far").select("conv_id", "tb", "far")
    second = before(of_thread, ["conv_id", "tb"], "thread", "n", "mid").select("conv_id", "thread", "tb", "mid")
    third = before(of_block, thread, "b", "n", "near").select(*thread, "b", "near")
    inner = before(rows, [*thread, "b"], "turn", "n", "own")
    joined = inner.join(third, [*thread, "b"]).join(second.join(first, ["conv_id", "tb"]).select(*thread, "far", "mid"), thread)
    return joined.withColumn("reply_order", F.col("far") + F.col("mid") + F.col("near") + F.col("own") + 1).select(*rows.columns[:-2], "reply_order")


def threads(links: DataFrame) -> DataFrame:
    """``links`` with the thread (first turn) and depth of each message, by doubling steps."""
    steps = cut_lineage(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = steps.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        moved = cut_lineage(steps.join(up, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, originals, thread, depth, reply_order, n_quoted, max_level, clean_text of every message.

    originals lists level:turn of every level that has an original, lowest level first.
    """
    whole = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    found = cut_lineage(answers(whole))
    listed = F.array_join(F.transform("originals", lambda x: F.concat_ws(":", x["level"].cast("string"), x["original"].cast("string"))), ",")
    reply = found.select("conv_id", "turn", listed.alias("originals")).join(
        threads(found.select("conv_id", "turn", "reply_to")), ["conv_id", "turn"])
    turns = whole.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    placed = ranked(turns.join(reply, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn")))
    levels = F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(marks(x))), lambda n: n > 0)
    return whole.withColumn("levels", F.when(F.col("text").contains(">"), levels).otherwise(F.array().cast("array<int>"))).join(
        placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("originals", F.lit("")).alias("originals"), F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("reply_order").cast("long").alias("reply_order"),
        F.size("levels").cast("long").alias("n_quoted"), F.coalesce(F.array_max("levels"), F.lit(0)).cast("long").alias("max_level"),
        without_quotes(F.col("text")).alias("clean_text"))


SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
l AS (SELECT r, conv_id, turn, pos, length(regexp_replace(regexp_extract(x, '^([ \t>]*)', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS line
      FROM (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM m
            WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
c AS (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY pos) AS fresh FROM l),
p AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY pos) AS passage, sum(CAST(line = '' AS INT)) OVER (PARTITION BY r ORDER BY pos) AS part FROM c),
u AS (SELECT conv_id, turn, level, line AS piece FROM p WHERE line <> ''
      UNION SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY pos) FROM p WHERE line <> '' GROUP BY r, conv_id, turn, level, passage, part
      UNION SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY pos) FROM p WHERE line <> '' GROUP BY r, conv_id, turn, level, passage),
a AS (SELECT q.conv_id, q.turn, q.level, q.piece, max(h.turn) AS original FROM u q JOIN u h
      ON h.conv_id = q.conv_id AND h.piece = q.piece AND h.turn < q.turn WHERE q.level > 0 AND h.level = 0 GROUP BY ALL),
o AS (SELECT conv_id, turn, level, original FROM (SELECT conv_id, turn, level, original, sum(length(piece)) AS votes FROM a GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY votes DESC, original DESC) = 1),
best AS (SELECT conv_id, turn, arg_min(original, level) AS reply_to, string_agg(level || ':' || original, ',' ORDER BY level) AS originals
         FROM o GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM best
       UNION ALL SELECT u.conv_id, u.turn, b.reply_to, u.depth + 1
       FROM up u JOIN best b ON b.conv_id = u.conv_id AND b.turn = u.thread),
top AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1)
SELECT m.conv_id, m.turn, m.role, reply_to, coalesce(originals, '') AS originals, coalesce(thread, m.turn) AS thread,
       CAST(coalesce(depth, 0) AS BIGINT) AS depth,
       CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL
            THEN rank() OVER (PARTITION BY m.conv_id, m.turn IS NULL ORDER BY coalesce(thread, m.turn), m.turn) END AS reply_order,
       CAST(coalesce(len(list_filter(string_split(m.text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*>'))), 0) AS BIGINT) AS n_quoted,
       CAST(coalesce(list_max(list_transform(string_split(m.text, chr(10)), lambda x: length(
           regexp_replace(regexp_extract(x, '^([ \t>]*)', 1), '[^>]', '', 'g')))), 0) AS BIGINT) AS max_level,
       trim(regexp_replace(regexp_replace(m.text, '(?m)^[^\n>]*(?:{INTRODUCED})[ ]?:[ \t]*\n([ \t]*>)', '\1', 'g'),
            '(?m)^[ \t]*>[^\n]*\n?', '', 'g'), ' ' || chr(9) || chr(10)) AS clean_text
FROM m LEFT JOIN best USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn)
"""
