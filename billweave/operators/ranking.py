"""Top-N and exact numbering within groups, also when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from billweave.operators.store import stored


def top_per_group(df: DataFrame, group: list[str], order: list, n: int,
                  position: str = "position") -> DataFrame:
    """The first n rows per group. Spark limits each map task to n rows per group before the
    shuffle (WindowGroupLimit), so a hot group sends at most n rows per task."""
    window = W.partitionBy(*group).orderBy(*order)
    return (df.withColumn(position, F.row_number().over(window))
              .filter(F.col(position) <= n))


def ones(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def in_ranges(df: DataFrame, info: DataFrame, group: list[str], order: list[str],
              ranges: int | None = None) -> DataFrame:
    """``df`` with the columns of ``info``, dealt by group and order into consecutive ranges; ``_slot``
    is the group and the number of the range.

    Spark samples the rows for ranges of about equal size, a hot group included. How many there are
    is ``ranges`` or, by default, spark.sql.shuffle.partitions, less what adaptive execution puts together.
    """
    key = F.struct(*group).alias("_group")
    rest = info.select(key, *[c for c in info.columns if c not in group])
    rows = df.select("*", key).join(rest, "_group")
    count = [ranges] if ranges else []
    return (rows.repartitionByRange(*count, "_group", *order)
            .withColumn("_slot", F.struct("_group", F.spark_partition_id().alias("range"))).drop("_group"))


def numbered(df: DataFrame, info: DataFrame, group: list[str], order: list[str],
             sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Join ``info`` (one row per group) to ``df`` and add running sums in ascending ``order``; rows
    that are equal in it are taken as equal.

    ``sums`` maps a new column to a number: each row gets its sum over the rows of the group up to
    and including itself. ``{"rank": lit(1)}`` is an exact row number, ``ones(condition)`` counts.

    A single window per group would sort a hot group in one task. Rows are therefore dealt by group
    and order into ranges, summed within each, and shifted by the sums of the group's ranges before
    (a prefix sum over ranges, not over rows). Where Spark's sample puts the borders differs from
    evaluation to evaluation, so the rows with their sums are written once (``stored``), and both
    the sums of the ranges and the rows are read from that table.
    """
    running = W.partitionBy("_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = {name: F.coalesce(F.sum(value).over(running), F.lit(0)) for name, value in sums.items()}
    rows = stored(in_ranges(df, info, group, order, ranges).withColumns(within))
    by_range = rows.groupBy("_slot").agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    before = (W.partitionBy("_slot._group").orderBy("_slot.range")
              .rowsBetween(W.unboundedPreceding, -1))
    shifts = by_range.select("_slot", *[F.sum(f"_{name}").over(before).alias(f"_{name}") for name in sums])
    # Joined by one struct, so that adaptive execution can split a large range or broadcast the sums.
    return (rows.join(shifts, "_slot")
            .withColumns({name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in sums})
            .drop("_slot", *[f"_{name}" for name in sums]))
