"""Chat formatting by quotation linking, in DataFrame functions.

A line that begins with '>' marks is quoted, at the level that the marks count.
Runs of lines of one level are passages.  A passage, each of its paragraphs and
each of its lines are normalised (marks off, white space collapsed, lower case)
and hashed; so are the unquoted parts of all messages.  Hashes are joined within
the conversation, to earlier turns: the message that shares the longest part
with a level-1 passage is the one replied to, the latest of equals.  Passages
that find nothing there are looked up in the other conversations; of several
messages that have the part, the one of the smallest (conversation, turn)
stands for all.  A message without a link answers the turn before it.

No conversation and no passage is gathered in one task, however often it
occurs.  The latest earlier turn that has a passage, and the turn before a gap,
are running maxima over ranges of rows (`last_before`), one row for each turn
that asks and each that has it; never a join of all that ask with all that
have.  Thread and depth come from pointer doubling over (conversation, turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import prepare, read_table, saved

MARKS = r"(?:[ \t]?>)"
QUOTED = rf"(?m)^{MARKS}"
#: A line that introduces a quotation, in the languages of the corpus.
INTRODUCTION = r"(?im)^[^\n>]*\b(?:wrote|writes|schrieb|écrit|a écrit|escribió)\s?:[ \t]*\n(?=[ \t]?>)"


def unquoted(text: Column) -> Column:
    """The text without quoted lines, the lines that introduce them and the gaps that they leave; without any, the text as it is."""
    bare = F.regexp_replace(text, INTRODUCTION, "")
    bare = F.regexp_replace(bare, rf"(?m)^{MARKS}[^\n]*(?:\n|\z)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(text.rlike(QUOTED), bare).otherwise(text)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parts(block: Column) -> Column:
    """(hash, words) of a block, its paragraphs and its lines; empty ones left out."""
    pieces = F.concat(F.array(block), F.split(block, r"\n[ \t]*\n"), F.split(block, r"\n"))
    clean = F.array_distinct(F.transform(pieces, normalised))
    kept = F.filter(clean, lambda p: p != "")
    return F.transform(kept, lambda p: F.struct(F.xxhash64(p, F.length(p)).alias("hash"), F.size(F.split(p, " ")).alias("words")))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, body) of rows (conv_id, turn, text); passage counts from 0 within turn and level."""
    marks = F.transform(F.regexp_extract_all("text", F.lit(rf"(?m)^({MARKS}+)"), F.lit(1)), lambda m: F.length(F.regexp_replace(m, "[^>]", "")))
    level = F.explode(F.array_distinct(marks)).alias("level")
    pattern = F.concat(F.lit(rf"(?m)(?:^{MARKS}{{"), F.col("level").cast("string"), F.lit(rf"}}(?![ \t]?>)[^\n]*(?:\n|\z))++"))
    return (
        messages.where(F.col("text").rlike(QUOTED))
        .select("conv_id", "turn", "text", level)
        .select("conv_id", "turn", "level", F.posexplode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("passage", "raw"))
        .select("conv_id", "turn", "level", "passage", F.regexp_replace("raw", rf"(?m)^{MARKS}+[ \t]?", "").alias("body"))
    )


def last_before(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add `out`: the greatest `value` among rows of equal keys that come before in `order`.

    Rows are dealt by ranges of (keys, order), so a key of very many rows spans
    many tasks; what a task has seen of its last key is carried to the next by
    one row per range.
    """
    part, carried = "__part", "__carried"
    dealt = rows.repartitionByRange(*keys, order).withColumn(part, F.spark_partition_id()).checkpoint()
    here = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # a range carries on at most one key from those before it, so these are no more rows than ranges
    over = dealt.groupBy(*keys, part).agg(F.max(value).alias("__m")).withColumn(carried, F.max("__m").over(parts)).where(F.col(carried).isNotNull()).drop("__m")
    found = dealt.withColumn(out, F.max(value).over(here)).join(F.broadcast(over), [*keys, part], "left")
    return found.withColumn(out, F.coalesce(out, carried)).drop(part, carried)


def _previous(turns: DataFrame, count: int) -> DataFrame:
    """(conv_id, turn, previous) of distinct turns; null for a conversation's first."""
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    joined = turns.join(before, ["conv_id", "turn"], "left")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    gaps = joined.where("previous is null").join(first, "conv_id").where("turn > first").select("conv_id").distinct()
    gaps = saved(gaps, count)
    if gaps.select("conv_id").first() is None:
        return joined
    lagged = last_before(turns.join(gaps, "conv_id", "left_semi").withColumn("at", F.col("turn")), ["conv_id"], "turn", "at", "previous").drop("at")
    return joined.join(gaps, "conv_id", "left_anti").select("conv_id", "turn", "previous").unionByName(lagged)


def link_quotations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth, n_passages, n_linked, quoted_conv, quoted_turn), one row per message.

    `text` is without quotations; `reply_to` is the turn answered, null for a
    conversation's first; `thread` is the first turn of the chain of replies and
    `depth` the number of replies back to it.  Sorting by (conv_id, thread,
    depth, turn) gives reply-ordered conversations.  `quoted_conv` and
    `quoted_turn` name a message of another conversation that a passage without
    a match in its own quotes.  Null text counts as empty; very long texts are
    parsed whole; rows without a conversation or turn are messages without
    links; rows that repeat a turn share its links; of originals that tie, the
    latest earlier turn is answered and the smallest (conversation, turn)
    elsewhere is named; other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    prepare(conversations.sparkSession)
    count = conversations.count()
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("conv_id is not null and turn is not null")
    bare = known.select("conv_id", "turn", unquoted(F.col("text")).alias("body"))
    passages = quoted_passages(known).distinct().checkpoint()
    asked = passages.select("conv_id", "turn", "level", "passage", F.explode(parts(F.col("body"))).alias("p")).select("conv_id", "turn", "level", "passage", "p.*").checkpoint()
    turns = saved(known.select("conv_id", "turn").distinct(), count)
    if asked.select("turn").first() is None:
        links = turns.select("conv_id", "turn", F.lit(None).cast(turns.schema["turn"].dataType).alias("linked"), F.lit(0).alias("n_linked")).where(F.lit(False))
        outside = turns.select("conv_id", "turn", F.col("conv_id").alias("quoted_conv"), F.col("turn").alias("quoted_turn")).where(F.lit(False))
    else:
        wanted = asked.select("hash").distinct()
        originals = bare.select("conv_id", "turn", F.explode(parts(F.col("body"))).alias("p")).select("conv_id", "turn", "p.hash", "p.words").distinct().join(wanted, "hash", "left_semi").checkpoint()
        # one row for each turn that asks for a part or has it
        sides = asked.select("conv_id", "hash", "turn", F.lit(None).cast(turns.schema["turn"].dataType).alias("has"), F.lit(True).alias("asks"))
        sides = sides.unionByName(originals.select("conv_id", "hash", "turn", F.col("turn").alias("has"), F.lit(False).alias("asks")))
        sides = sides.groupBy("conv_id", "hash", "turn").agg(F.max("has").alias("has"), F.max("asks").alias("asks"))
        answered = last_before(sides, ["conv_id", "hash"], "turn", "has", "o_turn").where("asks and o_turn is not null").select("conv_id", "hash", "turn", "o_turn")
        best = (
            asked.join(answered, ["conv_id", "hash", "turn"])
            .groupBy("conv_id", "turn", "level", "passage")
            .agg(F.max(F.struct("words", "o_turn")).alias("best"))
            .checkpoint()
        )
        links = best.groupBy("conv_id", "turn").agg(
            F.max(F.when(F.col("level") == 1, F.col("best"))).alias("b"), F.count("*").alias("n_linked")
        ).select("conv_id", "turn", F.col("b.o_turn").alias("linked"), "n_linked")
        first = originals.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
        met = asked.join(best.select("conv_id", "turn", "level", "passage"), ["conv_id", "turn", "level", "passage"], "left_anti").join(first, "hash").checkpoint()
        # a hash has one smallest conversation: only what is asked there needs the next one
        own = F.col("at.conv_id") == F.col("conv_id")
        inside = met.where(own).select("hash", F.col("conv_id").alias("own_conv")).distinct()
        second = originals.join(inside, "hash").where("conv_id <> own_conv").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
        outside = (
            met.where(~own)
            .unionByName(met.where(own).drop("at").join(second, "hash"))
            .groupBy("conv_id", "turn")
            .agg(F.max(F.struct("words", "at")).alias("b"))
            .select("conv_id", "turn", F.col("b.at.conv_id").alias("quoted_conv"), F.col("b.at.turn").alias("quoted_turn"))
        )
    counted = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_passages"))
    replies = (
        _previous(turns, count)
        .join(links, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("linked", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    )
    replies = saved(replies, count)
    # pointer doubling: up is where the chain leads after some replies, depth how many; rows that lead to a first turn are done
    parent = F.col("reply_to")
    chain = replies.select("conv_id", "turn", F.coalesce(parent, "turn").alias("up"), parent.isNotNull().cast("long").alias("depth"), parent.isNull().alias("done"))
    chain = saved(chain, count)
    done, still = chain.where("done"), chain.where("not done")
    while still.select("turn").first() is not None:
        above = done.unionByName(still).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("done").alias("done2"))
        moved = (
            still.drop("done")
            .join(above, ["conv_id", "up"])
            .select("conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done2").alias("done"))
        )
        moved = saved(moved, count)
        done, still = done.unionByName(moved.where("done")), moved.where("not done")
    found = (
        done.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
        .join(replies, ["conv_id", "turn"])
        .join(counted, ["conv_id", "turn"], "left")
        .join(outside, ["conv_id", "turn"], "left")
    )
    return rows.withColumn("text", unquoted(F.col("text"))).join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "quoted_conv", "quoted_turn",
    )


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotations, with the turn it answers."""
    return link_quotations(read_table(spark, sf_dir, "conversations"))
