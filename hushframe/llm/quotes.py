"""Reply-ordered conversations from messages that quote each other; DataFrame functions only.

1. A line's quote level is the number of ``>`` that it begins with, blanks between
   them allowed; what follows is its content.  Lines of level 0 are the message's own.
2. Passages are runs of consecutive lines of one level that have a word; units are
   passages and their single lines.  A unit is normalised (lower case, runs of
   anything but letters and digits become one space) and hashed.
3. The original of a unit is the earliest message of the conversation that has it
   as its own.  A quoted unit votes for its original if that came before; the
   message replies to the original with the best claim: lowest quote level, most
   votes, latest turn.
4. Roots and depths follow by pointer doubling, in a number of joins that is the
   logarithm of the longest chain.  Messages are ordered by (turn of the root, turn)
   and lose their quoted lines.

Units are counted only in conversations that quote at all, and per unit there is
one original, so that a unit that very many messages share makes no pairs.

Null texts are null in the result and quote nothing.  Rows without conversation
or turn, which have no place in an order, are left out.  Rows that share both are
one message to those who quote it; each is returned.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import Scratch
from hushframe.llm.lines import normal

QUOTE = r"^[ \t]*(>[ \t>]*)"


def _units(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, unit): the hashes of the passages and lines of (conv, turn, row, no, level, content)."""
    one = Window.partitionBy("conv", "turn", "row").orderBy("no")
    text = rows.withColumn("norm", normal(F.col("content")))
    before = F.lag(F.when(F.col("norm") != "", F.col("level"))).over(one)
    new = F.when(before.eqNullSafe(F.col("level")), 0).otherwise(1)
    runs = text.withColumn("new", new).withColumn("run", F.sum("new").over(one)).where("norm <> ''")
    whole = runs.groupBy("conv", "turn", "row", "level", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "norm"))), lambda x: x["norm"]), " ").alias("norm"))
    both = whole.select("conv", "turn", "level", "norm").unionByName(runs.select("conv", "turn", "level", "norm"))
    return both.select("conv", "turn", "level", F.xxhash64("norm").alias("unit")).distinct()


def thread(scratch: Scratch, messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, reply_to, root_turn, depth, position, n_quoted, text) of every message.

    ``reply_to`` is null where nothing is quoted; ``position`` counts from 1.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv is not null and turn is not null")
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(F.regexp_extract(x, QUOTE, 1).alias("marks"), x.alias("line")))
    level = lambda x: F.length(F.translate(x["marks"], " \t", ""))
    own = F.trim(F.array_join(F.transform(F.filter("parts", lambda x: level(x) == 0), lambda x: x["line"]), "\n"))
    cut = rows.withColumn("parts", parts)
    cut = cut.select("conv", "turn", "role", own.alias("own"), F.coalesce(F.size(F.filter("parts", lambda x: level(x) > 0)), F.lit(0)).alias("n_quoted"), "text")
    quoting = scratch.keep(cut.where("n_quoted > 0").select("conv").distinct())
    lines = rows.join(quoting, "conv", "left_semi").select("conv", "turn", F.xxhash64("role", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.withColumn("level", F.length(F.translate(F.regexp_extract("line", QUOTE, 1), " \t", "")))
    units = scratch.keep(_units(lines.withColumn("content", F.regexp_replace("line", QUOTE, ""))))
    first = units.where("level = 0").groupBy("conv", "unit").agg(F.min("turn").alias("parent"))
    votes = units.where("level > 0").join(first, ["conv", "unit"]).where("parent < turn")
    votes = votes.groupBy("conv", "turn", "level", "parent").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "parent")).alias("b"))
    links = scratch.keep(best.select("conv", "turn", F.col("b.parent").alias("reply_to")))
    # pointer doubling: up is an ancestor that lies ``depth`` replies above
    walk = links.select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = walk.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        moved = walk.join(above, ["conv", "up"], "left")
        walk = scratch.keep(moved.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        if walk.where("moved").isEmpty():
            break
        walk = walk.drop("moved")
    walk = walk.select("conv", "turn", F.col("up").alias("root_turn"), "depth")
    out = cut.join(links, ["conv", "turn"], "left").join(walk, ["conv", "turn"], "left")
    out = out.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))
    order = Window.partitionBy("conv").orderBy("root_turn", "turn", "role", "text")
    out = out.withColumn("position", F.row_number().over(order).cast("long"))
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "reply_to", "root_turn", "depth", "position", F.col("n_quoted").cast("long").alias("n_quoted"), F.col("own").alias(text))
