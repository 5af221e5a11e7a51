"""Dealing rows into shards of bounded size.

Method: extendible hashing. A row's bucket is the beginning of its hash bits. All start in one
bucket; only a bucket that is over the byte limit splits on one more bit, until every one fits. The
result is a directory of hash prefixes of different lengths, one shard each.

The splits are found `STEP` bits at a time: bytes are summed by the next bits (at most 2 ** STEP sums
for each bucket still over the limit), then by every shorter prefix of them, and the shortest prefix
that fits is the shard. Buckets over the limit with all those bits go on with the next ones. The bits
are the MD5 of the key; rows with equal keys that do not fit together go on with the MD5 of their
text, and rows with equal key and text with their number in the table, so a hot key splits like any
other. A row that is over the limit by itself is a shard of its own, which `fits` tells.

Sizes are the bytes of the text; null text counts as 0, a null key as the empty key. An empty table
has no shards. Texts are read once; what is summed and kept is one narrow row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.rows import fresh, saved

#: Bits (in hex digits of 4) that one step looks at.
STEP_DIGITS = 4
STEP = 4 * STEP_DIGITS


def bits_of(digits: Column, width: int) -> Column:
    """Hex digits as a string of bits."""
    return F.lpad(F.conv(digits, 16, 2), width, "0")


def hash_digits(key: Column, text: Column, number: Column) -> Column:
    """All hex digits of a row: of its key, its text and its number."""
    return F.concat(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")),
                    F.md5(F.coalesce(text, F.lit("")).cast("binary")),
                    F.lpad(F.lower(F.hex(F.xxhash64(number))), 16, "0"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """cell, shard, shard_bytes, shard_rows, fits: the shard of every group of hash digits.

    `rows` has digits and bytes. A cell is the beginning of the digits, as long as it took.
    """
    found, start = None, 0
    open_cells = None  # beginnings of digits that are over the limit with all bits so far
    while True:
        # the bits so far, and the next ones
        before = F.substring("digits", 1, start)
        part = rows.select(before.alias("before"), F.substring("digits", start + 1, STEP_DIGITS).alias("next"), "bytes")
        if open_cells is not None:
            part = part.join(open_cells, "before", "left_semi")
        cells = part.groupBy("before", "next").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        # bits are cut one by one; at the first step also the empty prefix
        least = 0 if start == 0 else 1
        prefixes = (cells.withColumn("bits", bits_of(F.col("next"), STEP))
                    .withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(STEP))))
                    .withColumn("prefix", F.expr("substring(bits, 1, depth)")))
        sums = prefixes.groupBy("before", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        last = start + STEP_DIGITS >= 80
        done = (F.col("bytes") <= limit) | (F.col("rows") == 1) | F.lit(last) & (F.length("prefix") == STEP)
        fitting = sums.where(done)
        shortest = (prefixes.select("before", "next", "depth", "prefix")
                    .join(fitting, ["before", "prefix"])
                    .groupBy("before", "next")
                    .agg(F.min_by(F.struct("prefix", "bytes", "rows"), "depth").alias("shard")))
        step = saved(cells.select("before", "next").join(shortest, ["before", "next"], "left")
                     .select(F.concat("before", "next").alias("cell"),
                             F.concat(bits_of_all(F.col("before"), start), F.col("shard.prefix")).alias("shard"),
                             F.col("shard.bytes").alias("shard_bytes"), F.col("shard.rows").alias("shard_rows")))
        settled = step.where("shard IS NOT NULL")
        found = settled if found is None else found.unionByName(settled)
        open_cells = step.where("shard IS NULL").select(F.col("cell").alias("before"))
        start += STEP_DIGITS
        if not open_cells.take(1):
            return found.withColumn("fits", F.col("shard_bytes") <= limit)


def bits_of_all(digits: Column, count: int) -> Column:
    """Bits of `count` hex digits, in pieces that fit into a number."""
    pieces = [bits_of(F.substring(digits, at + 1, 8 if at + 8 <= count else count - at),
                      4 * min(8, count - at)) for at in range(0, count, 8)]
    return F.concat(*pieces) if pieces else F.lit("")


def assign(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", number: str | None = None) -> DataFrame:
    """row_id, key, bytes, shard, depth, shard_bytes, shard_rows and fits of every row.

    `number` names a column of `df` that tells its rows apart, and is the row_id; without it, rows get one.
    """
    numbers = F.col(f"`{number}`") if number else F.monotonically_increasing_id()
    rows = saved(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("_text"), numbers.alias("row_id"))
                 .select("row_id", "key", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("bytes"),
                         hash_digits(F.col("key"), F.col("_text"), F.col("row_id")).alias("digits")))
    shards = directory(rows, limit)
    lengths = [r[0] for r in shards.select(F.length("cell")).distinct().collect()]
    out = None
    for length in sorted(lengths):
        mine = shards.where(F.length("cell") == length)
        if length == STEP_DIGITS:
            mine = F.broadcast(mine)  # at most 2 ** STEP rows
        part = rows.withColumn("cell", F.substring("digits", 1, length)).join(mine, "cell")
        out = part if out is None else out.unionByName(part)
    if out is None:  # no rows
        out = rows.withColumn("cell", F.lit("")).join(shards, "cell")
    return out.select("row_id", "key", "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes",
                      "shard_rows", "fits")


def write_shards(df: DataFrame, folder: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes `df` as Parquet, one folder for each shard.

    All rows and columns are written, and one that names the shard (`shard`, with underscores in front where
    `df` has such a column). Rows are numbered in a copy in the shared folder, as numbers that are worked out
    twice need not agree. An empty table writes no shard.
    """
    name, number = fresh(df, "shard"), fresh(df, "row_number")
    rows = saved(df.withColumn(number, F.monotonically_increasing_id()))
    dealt = assign(rows, limit, key, text, number)
    named = dealt.select(F.col("row_id").alias(number), F.concat(F.lit("b"), "shard").alias(name))
    rows.join(named, number).drop(number).repartition(name).write.partitionBy(name).parquet(folder)
