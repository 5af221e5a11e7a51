"""Records and cells of CSV lines that were read one by one, also across the splits of a file.

A line break inside quotes does not end a record, but a reader of lines cuts there, and a task that
starts in the middle of a file cannot know whether it starts inside quotes. Each line is therefore
looked at for both cases: whether it ends inside quotes if it began outside (`ends_inside`), and if it
began inside (`stays_inside`). The two answers are a function of the state; functions of neighbouring lines
combine into one for each split, splits pass their states on, and then every line knows its own.

Quotes count as in Python's csv module: a cell is quoted if a mark is its first character, two marks
inside are one, and what follows the closing mark belongs to the cell. All loops of the patterns are
possessive, so that they neither backtrack nor recurse, however long a line is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A record longer than this many characters is an error: a mark that is never closed would make one
# record of the rest of its file.
MAX_RECORD = 1 << 20

INSIDE = '[^"]*+(?:""[^"]*+)*+'
CLOSED = f'(?:"{INSIDE}"[^,]*+|[^",][^,]*+)?+'
OPEN = f'"{INSIDE}\\z'
# A mark that is never closed reaches to the end.
CELL = f'(?:"{INSIDE}(?:"[^,]*+)?+|[^",][^,]*+)?+'


def _between(line: Column) -> Column:
    """What stands between the first two marks."""
    return F.substring_index(F.substring_index(line, '"', 2), '"', -1)


def flat(line: Column) -> Column:
    """The line with one mark in place of its quoted cell, if that cell has the only two marks; a line without
    marks as it is; NULL for all others. Commas of a flat line divide cells, so that no pattern is needed."""
    before, after = F.substring_index(line, '"', 1), F.substring_index(line, '"', -1)
    closed = (after == "") | after.startswith(",")
    return F.when(~line.contains('"'), line).when(closed & _one_pair(line), F.concat(before, F.lit('"'), after))


def _one_pair(line: Column) -> Column:
    """Whether a line has just two marks, the first of which begins a cell."""
    before, first = F.substring_index(line, '"', 1), F.substring_index(line, '"', 2)
    size = F.octet_length(line)
    two = (F.octet_length(first) < size) & (F.octet_length(F.substring_index(line, '"', 3)) == size)
    return ((before == "") | before.endswith(",")) & two


def _flat_said(cell: Column, line: Column) -> Column:
    return F.when(cell == '"', _between(line)).otherwise(cell)


def flat_cell(flat_line: Column, line: Column, n: Column) -> Column:
    """What the n-th cell (from 0) of a flat line says; empty if there is none."""
    to_comma = F.call_function("substring_index", flat_line, F.lit(","), n)
    cell = F.substring_index(F.call_function("substring_index", flat_line, F.lit(","), n + 1), ",", -1)
    return F.when(to_comma != flat_line, _flat_said(cell, line)).otherwise("")


def last_flat_cell(flat_line: Column, line: Column) -> Column:
    return _flat_said(F.substring_index(flat_line, ",", -1), line)


def flat_cells(flat_line: Column, line: Column) -> Column:
    return F.transform(F.split(flat_line, ","), lambda cell: _flat_said(cell, line))


def ends_inside(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside."""
    return line.contains('"') & ~_one_pair(line) & line.rlike(f"\\A(?:{CLOSED},)*+{OPEN}")


def stays_inside(line: Column) -> Column:
    """Whether a line that begins inside of quotes ends inside."""
    return ~line.contains('"') | line.rlike(f'\\A{INSIDE}(?:\\z|"[^,]*+,(?:{CLOSED},)*+{OPEN})')


def raw_cell(line: Column, n: int) -> Column:
    """The n-th cell (from 0) as it is written; empty if there is none."""
    return F.regexp_extract(F.concat(F.lit(","), line), f"\\A(?:,{CELL}){{{n}}}+,({CELL})", 1)


def raw_cells(line: Column, most: Column | None = None, n: int = 0) -> Column:
    """All cells as they are written, or the first n where ``most`` is true."""
    text = F.concat(F.lit(","), line)
    if most is not None:
        text = F.when(most, F.regexp_extract(text, f"\\A((?:,{CELL}){{0,{n}}}+)", 1)).otherwise(text)
    return F.regexp_extract_all(text, F.lit(f",({CELL})"), 1)


def unquoted(raw: Column) -> Column:
    """What a written cell says."""
    said = F.replace(F.regexp_extract(raw, f'\\A"({INSIDE})', 1), F.lit('""'), F.lit('"'))
    rest = F.regexp_extract(raw, f'\\A"{INSIDE}"([^,]*+)\\z', 1)
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    simple = raw.endswith('"') & (F.length(raw) > 1) & ~inner.contains('"')  # spared the patterns
    return F.when(~raw.startswith('"'), raw).when(simple, inner).otherwise(F.concat(said, rest))


def _state(start: Column, value: Column, flips: Column) -> Column:
    """Inside or not: where the last constant left off, or else the start, flipped so many times."""
    return (F.coalesce(value, start).cast("int") + F.coalesce(flips, F.lit(0))) % 2 == 1


def _function(frame) -> tuple[Column, Column]:
    """(last constant, flips since) over a frame of rows with `fixed`, `flip` and `flips` (running, own
    row included)."""
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "flips")), ignorenulls=True).over(frame)
    return last["fixed"], F.sum("flip").over(frame) - F.coalesce(last["flips"], F.lit(0))


def _frames(group: list[str], order: str) -> tuple:
    """All rows of the group up to one's own, and those before."""
    whole = W.partitionBy(*group).orderBy(order)
    return tuple(whole.rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))


def whole_records(lines: DataFrame) -> DataFrame:
    """source_path, at (split, number) and line -> the same with a row for each record.

    `number` orders the lines of a split, `split` the splits of a file. A record has the place of its
    first line, `number` being counted from 1 in each split (numbers as they come may differ when lines
    are read again, as they are here); its lines are joined by a line feed, whatever stood there. Lines are dealt by split, so
    that no task holds more than one, and looked at for a split that begins outside and one that
    begins inside; what passes between splits is one narrow row for each.
    """
    place = ["source_path", "split"]
    to, before = _frames(place, "number")
    inside, stays = ends_inside(F.col("line")), stays_inside(F.col("line"))
    looked = (lines.select("source_path", "at.split", "at.number", "line", inside.alias("a"), stays.alias("b"))
              .filter(F.col("source_path").isNotNull() & F.col("split").isNotNull()))
    # both answers equal: the state is fixed; (inside, outside): it flips; else it stays
    functions = looked.select(*place, "number", "line", F.when(F.col("a") == F.col("b"), F.col("a")).alias("fixed"),
                              (F.col("a") & ~F.col("b")).cast("int").alias("flip"))
    value, since = _function(before)
    running = (functions.withColumns({"flips": F.sum("flip").over(to), "size": F.sum(F.length("line")).over(to),
                                      "ordinal": F.count(F.lit(1)).over(to)})
               .withColumns({"value": value, "since": since}))
    cases = {"outside": F.lit(False), "inside": F.lit(True)}
    start_of = F.struct("ordinal", (F.col("size") - F.length("line")).alias("before"))
    # of either case: the first line of the record that a line belongs to, if it is in this split
    running = running.withColumns({case: F.last(F.when(~_state(start, F.col("value"), F.col("since")), start_of),
                                                ignorenulls=True).over(to) for case, start in cases.items()})
    ends = running.withColumns({f"to_{case}": _state(
        F.coalesce("fixed", _state(start, F.col("value"), F.col("since"))), F.lit(None).cast("boolean"), F.col("flip"))
        for case, start in cases.items()})
    splits = ends.groupBy(*place).agg(F.max_by(F.struct(
        "to_outside", "to_inside", F.col("outside.ordinal").alias("outside"), F.col("inside.ordinal").alias("inside")),
        "number").alias("last"))
    to_split, before_split = _frames(["source_path"], "split")
    a, b = F.col("last.to_outside"), F.col("last.to_inside")
    value, since = _function(before_split)
    splits = (splits.withColumns({"fixed": F.when(a == b, a), "flip": (a & ~b).cast("int")})
              .withColumn("flips", F.sum("flip").over(to_split))
              .withColumn("begins_inside", _state(F.lit(False), value, since)))
    last = F.when(F.col("begins_inside"), F.col("last.inside")).otherwise(F.col("last.outside"))
    begun = F.when(last.isNotNull(), F.struct(F.col("split"), last.alias("number")))
    # lines before the first record of their split belong to the last one of the splits before
    splits = splits.select(*place, "begins_inside",
                           F.last(begun, ignorenulls=True).over(before_split).alias("carried"))
    known = running.join(splits, place).withColumn(
        "first", F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("outside")))
    size = F.col("size") - F.coalesce("first.before", F.lit(0))
    line = F.when(size <= MAX_RECORD, F.col("line")).otherwise(F.raise_error(
        F.concat(F.lit(f"a record of more than {MAX_RECORD} characters in "), "source_path")).cast("string"))
    at = F.when(F.col("first").isNull(), F.col("carried")).otherwise(
        F.struct("split", F.col("first.ordinal").alias("number")))
    return (known.select("source_path", at.alias("at"), F.struct("split", "number", line.alias("line")).alias("part"))
            .groupBy("source_path", "at").agg(F.array_sort(F.collect_list("part")).alias("parts"))
            .select("source_path", "at",
                    F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line")))
