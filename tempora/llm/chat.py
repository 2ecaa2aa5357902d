"""Quotation linking: quote levels are parsed, quoted passages joined to the messages they come from.

A line's level is the number of > marks it starts with. Lines of one level in a row form a
passage; passages and their single lines are lower-cased, their white space is made even, and
they are hashed. A message's own text (level 0, without lines that announce a quote) is hashed
by line, by paragraph and as a whole. A quotation belongs to the latest earlier message of its
conversation that has one of its hashes; a message answers the one that its outermost level
links to. Threads follow from the answers: the root is found by doubling steps, and a message's
position is its place in the reply order of its thread, by turn, so that every reply comes after what
it answers. Positions come from a sort by ranges, so that a thread of any length is not one task's work.

The latest earlier message is found in blocks of BLOCK turns: a window within the block, and one
over the blocks' last turns, so that no window holds all turns of a very common passage.

DataFrame expressions only. Null text: empty, no quotes. Very long texts: lines and passages are cut
once, in linear time. Rows of one conversation and turn, repeated rows too, are one message to those
that quote it and have one position; each row comes back. Null conv_id or turn: never linked, position
0. Ties: of several messages with the quoted passage the latest, of several links the outermost
level's, then the latest. Empty table: no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tempora.functions.lineage import numbered
from tempora.llm.common import materialize, table

BLOCK = 512
_QUOTE = r"^\s{0,3}((?:>\s?)+)"
_ANNOUNCES = r"^\s*(?:On|Am|Le|El)\b.{0,300}(?:wrote|schrieb|écrit|escribió)\s*:\s*$"


def _even(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def _lines(text: Column) -> Column:
    """Array of (level, body) of the lines."""
    def one(line: Column) -> Column:
        level = F.char_length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), r"[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(line, _QUOTE, "").alias("body"))

    return F.transform(F.split(text, r"\r?\n", -1), one)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, blank lines between them: array of (level, body)."""
    blank = lambda x: F.trim(x["body"]) == ""
    opens = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & (x["level"] == F.get(lines, i - 1)["level"]) & ~blank(x), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())

    def run(starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            part = F.slice(lines, at + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - at)
            return F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["body"]), " ").alias("body"))

        return F.transform(starts, one)

    return F.element_at(F.transform(F.array(opens), run), 1)


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, the text without quotes, and hashed quotes (level, h) and own passages."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = messages.select("conv_id", "turn", "role", _lines(text).alias("lines"))
    rows = rows.withColumn("quoted", F.exists("lines", lambda x: x["level"] > 0))
    own_lines = F.filter("lines", lambda x: (x["level"] == 0) & ~(F.col("quoted") & x["body"].rlike(_ANNOUNCES)))
    rows = rows.withColumn("own", own_lines)
    body = F.array_join(F.transform("own", lambda x: x["body"]), "\n")
    quotes = F.filter(F.concat("lines", _passages(F.col("lines"))), lambda x: (x["level"] > 0) & (_even(x["body"]) != ""))
    hashed = F.array_distinct(F.transform(quotes, lambda x: F.concat_ws(":", x["level"].cast("string"), F.xxhash64(_even(x["body"])).cast("string"))))  # as strings, which are told apart by hashing
    hashed = F.transform(hashed, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("level"), F.substring_index(x, ":", -1).cast("bigint").alias("h")))
    own = F.concat(F.transform("own", lambda x: x["body"]), F.transform(_passages(F.col("own")), lambda x: x["body"]), F.array(body))
    own = F.array_distinct(F.transform(F.filter(F.transform(own, _even), lambda x: x != ""), lambda x: F.xxhash64(x)))
    none = F.array().cast("array<struct<level:int,h:bigint>>")
    return rows.select("conv_id", "turn", "role", F.regexp_replace(body, r"^\s*\n|\s+$", "").alias("text"), F.when(F.col("quoted"), hashed).otherwise(none).alias("quotes"), own.alias("passages"))


def _links(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, turn, level, h and the latest earlier turn that has the passage."""
    keys = ["conv_id", "h"]
    own = parsed.select("conv_id", "turn", F.explode("passages").alias("h")).where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    own = own.join(quotes.select(*keys).distinct(), keys, "left_semi").distinct()
    block = F.floor(F.col("turn") / BLOCK)
    asked = quotes.select("conv_id", "h", "turn").distinct()
    both = own.withColumn("mine", F.col("turn")).unionByName(asked.withColumn("mine", F.lit(None).cast("bigint")))
    both = both.groupBy(*keys, "turn").agg(F.max("mine").alias("mine")).withColumn("block", block)
    near = F.max("mine").over(W.partitionBy(*keys, "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1))
    far = both.groupBy(*keys, "block").agg(F.max("mine").alias("last"))
    far = far.withColumn("far", F.max("last").over(W.partitionBy(*keys).orderBy("block").rangeBetween(W.unboundedPreceding, -1)))
    found = both.withColumn("near", near).join(far.select(*keys, "block", "far"), [*keys, "block"]).select(*keys, "turn", F.coalesce("near", "far").alias("source_turn"))
    return quotes.join(found.where(F.col("source_turn").isNotNull()), [*keys, "turn"])


def _threads(answers: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth, by doubling steps over written tables."""
    steps = materialize(answers.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("bigint").alias("depth")), "chat-steps")
    while True:
        above = steps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        grown = steps.join(above, ["conv_id", "up"], "left")
        grown = grown.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"))
        grown = materialize(grown, "chat-steps")
        steps = grown.drop("moved")
        if grown.where("moved").isEmpty():
            return answers.join(steps.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth"), ["conv_id", "turn"])


def _positions(threads: DataFrame) -> DataFrame:
    """conv_id, turn, position: the place of each message of a thread of two or more, the root's being 0."""
    members = threads.select("conv_id", "root_turn", "turn").unionByName(threads.select("conv_id", "root_turn", F.col("root_turn").alias("turn"))).distinct()
    order = numbered(members, [F.col("conv_id"), F.col("root_turn"), F.col("turn")], "n")
    first = order.groupBy("conv_id", "root_turn").agg(F.min("n").alias("first"))
    return order.join(first, ["conv_id", "root_turn"]).select("conv_id", "turn", (F.col("n") - F.col("first")).alias("position"))


def link(messages: DataFrame) -> DataFrame:
    """One row per message: what it answers, its thread, its place in it and its text without quotes."""
    parsed = materialize(parse(messages.select("conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("bigint"))), "chat-parsed")
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.h").where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    counted = parsed.withColumn("n_quotes", F.size("quotes").cast("bigint"))
    if quotes.isEmpty():
        none = F.lit(None).cast("bigint")
        return counted.select("conv_id", "turn", "role", none.alias("parent_turn"), F.col("turn").alias("root_turn"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("position"), "n_quotes", F.lit(0).cast("bigint").alias("n_linked"), "text")
    links = _links(parsed, quotes).groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "source_turn")).alias("b"), F.count("*").alias("n_linked"))
    answers = materialize(links.select("conv_id", "turn", F.col("b.source_turn").alias("parent_turn"), "n_linked"), "chat-answers")
    threads = materialize(_threads(answers), "chat-threads")
    out = counted.join(threads, ["conv_id", "turn"], "left").join(_positions(threads), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("position", F.lit(0)).cast("bigint").alias("position"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "text")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
