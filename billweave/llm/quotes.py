"""Conversations in reply order, without quoted text.

Method: quotation linking. Lines that start with `>` are quoted; the number of `>` is the level.
Neighbouring lines of one level are a passage; blank quoted lines cut it into paragraphs. Passages, their
paragraphs, the sentences of these, however lines are wrapped, and lines are normalised (A-Z lower-cased,
blanks as one) and hashed, and so are the messages' own texts, their paragraphs, sentences and lines. Where the
hashes of one conversation meet, the quoting message replies to the latest earlier message that said
it; a whole passage or paragraph counts more than a sentence or line, and level 1 more than deeper ones. Messages come in the
order of their path: the turns from the first message of the thread to themselves. A message that
quotes nothing starts a thread, so a conversation without quotes stays in the order of its turns.

Only DataFrame functions are used. Nothing is grouped by conversation: groups are (conversation,
passage), one message, or one link, so a conversation of any length is spread. Links are followed by
doubling, one short round for each doubling of the longest chain.

Rows without conv_id or turn are not linked; they have no path. Null text stays null and quotes
nothing; a text that is all quotes becomes empty. Repeated rows get equal results. A passage found in
several messages of one turn is one. Quotes that no earlier message holds are removed and link nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.rows import ascii_lower, saved

#: A line of quoted text: marks with blanks between them, then the text.
QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: Written by mail programs above a quote.
ATTRIBUTION = r"(?i)^(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió) ?:[ \t]*$"
#: A sentence ends here, in a normalised paragraph.
SENTENCE = "(?<=[.!?…]) "
#: Sentences and lines of fewer words are too common to link by.
LEAST_WORDS = 3


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def without_quotes(text: Column) -> Column:
    """The text's own lines; a line that announces a quote goes with it."""
    lines = F.split(text, "\n")
    marked = F.zip_with(lines, F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                                        F.array(F.lit(""))),
                        lambda line, then: F.when(line.rlike(QUOTED) | line.rlike(ATTRIBUTION)
                                                  & then.rlike(QUOTED), None).otherwise(line))
    own = F.array_join(F.filter(marked, lambda line: line.isNotNull()), "\n")
    return F.when(has_quote(text), F.trim(own)).otherwise(text)


def has_quote(text: Column) -> Column:
    return text.rlike(r"(?m)" + QUOTED)


def quoted_passages(messages: DataFrame) -> DataFrame:
    """mid, conv_id, turn, level, whole, hash: passages and lines that messages quote."""
    lines = (messages.where(has_quote(F.col("text")))
             .select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
             .where(F.col("line").rlike(QUOTED)))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), r"[ \t]", ""))
    lines = lines.withColumn("level", level).withColumn("line", normal(F.regexp_replace("line", MARKS, "")))
    same = Window.partitionBy("mid", "level").orderBy("at")
    passages = (lines.withColumn("run", F.col("at") - F.row_number().over(same))
                .groupBy("mid", "conv_id", "turn", "level", "run")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))),
                                 lambda x: x["line"]).alias("lines")))
    paragraphs = F.transform(F.split(F.array_join("lines", "\n"), r"\n\n+"), normal)
    parts = F.array_union(sentences(paragraphs), F.col("lines"))
    unit = F.explode(F.concat(
        F.transform(F.array_union(F.array(normal(F.array_join("lines", " "))), paragraphs),
                    lambda x: F.struct(F.lit(True).alias("whole"), x.alias("said"))),
        F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("said")))))
    return (passages.select("mid", "conv_id", "turn", "level", unit.alias("unit"))
            .select("mid", "conv_id", "turn", "level", "unit.whole", "unit.said")
            .where((F.length("said") > 0) & (F.col("whole") | (words(F.col("said")) >= LEAST_WORDS)))
            .select("mid", "conv_id", "turn", "level", "whole", F.md5(F.col("said").cast("binary")).alias("hash")))


def sentences(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)))


def said_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, hash: what messages say themselves, as a whole, by paragraph, sentence and line."""
    own = without_quotes(F.col("text"))
    paragraphs = F.split(own, r"\n\s*\n")
    units = F.concat(F.array(own), paragraphs, sentences(F.transform(paragraphs, normal)), F.split(own, "\n"))
    return (messages.select("conv_id", "turn", F.explode(units).alias("said"))
            .withColumn("said", normal(F.col("said"))).where(F.length("said") > 0)
            .select("conv_id", "turn", F.md5(F.col("said").cast("binary")).alias("hash")).distinct())


def reply_links(messages: DataFrame) -> DataFrame:
    """mid and reply_to: the turn of the message that each quoting message replies to."""
    quoted = quoted_passages(messages).distinct()
    asked = quoted.select("conv_id", "hash").distinct()
    talking = messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said_passages(talking).join(asked, ["conv_id", "hash"], "left_semi")
    # of those who said it, the latest before: both sides in order, quotes first within a turn
    both = quoted.withColumn("says", F.lit(None).cast("long")).unionByName(
        said.withColumn("says", F.col("turn")), allowMissingColumns=True)
    before = (Window.partitionBy("conv_id", "hash").orderBy("turn", F.col("says").isNotNull())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = (both.withColumn("reply_to", F.last("says", ignorenulls=True).over(before))
           .where("mid IS NOT NULL AND reply_to IS NOT NULL"))
    # level 1 first, then whole passages, then most lines, then the latest
    votes = met.groupBy("mid", "reply_to").agg(F.min("level").alias("level"), F.max("whole").alias("whole"),
                                               F.count("*").alias("lines"))
    best = F.struct(-F.col("level"), F.col("whole"), F.col("lines"), F.col("reply_to"))
    return votes.groupBy("mid").agg(F.max_by("reply_to", best).alias("reply_to"))


def thread_paths(messages: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, turn, path of turns that reply: the turns from the thread's first to their own.

    Each round doubles how far up a path reaches.
    """
    replies = (links.join(messages.select("mid", "conv_id", "turn").distinct(), "mid")
               .groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")))
    open_paths = saved(replies.withColumn("path", F.array("turn")))
    while True:
        above = open_paths.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"),
                                  F.col("path").alias("before"))
        open_paths = saved(open_paths.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn",
            F.when(F.col("before").isNull(), F.col("up")).otherwise(F.col("further")).alias("up"),
            F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"),
            F.col("before").isNull().alias("done")))
        if not open_paths.where("NOT done").take(1):
            break
        open_paths = open_paths.drop("done")
    return open_paths.select("conv_id", "turn", F.concat(F.array("up"), "path").alias("path"))


def reply_order(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """conv_id, turn, role, text without quotes, reply_to, path, thread, depth and chat, by row.

    Sorted by conv_id and path, rows are in reply order. chat is the message with its role.
    """
    messages = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                         F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    messages = messages.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text"))
    placed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    links = saved(reply_links(placed))
    paths = thread_paths(placed, links)
    own = F.array("turn")
    out = (messages.join(links, "mid", "left").join(paths, ["conv_id", "turn"], "left")
           .withColumn("path", F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), None)
                       .when(F.col("reply_to").isNull(), own).otherwise(F.coalesce("path", own)))
           .withColumn("text", without_quotes(F.col("text"))))
    return out.select("conv_id", "turn", "role", "text", "reply_to", "path",
                      F.element_at("path", 1).alias("thread"), (F.size("path") - 1).alias("depth"),
                      F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"),
                               F.coalesce("text", F.lit(""))).alias("chat"))
