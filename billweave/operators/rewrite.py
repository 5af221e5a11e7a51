"""Rewriting a table by day, and proof that nothing was lost on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rewrite_by_day(df: DataFrame, path: str, at: str, day: str = "day", cluster: list[str] | None = None) -> None:
    """Writes ``df`` as Parquet with a folder for each day of ``at``; only days that ``df`` holds are
    replaced, so a rewrite can go month by month and be repeated.

    Rows are dealt by day, and a day that is much larger than others goes to several tasks, one file
    each. ``cluster`` orders the rows within a file. Rows without a time share one folder.
    """
    rows = df.withColumn(day, F.col(at).cast("date")).hint("rebalance", day)
    (rows.sortWithinPartitions(day, *(cluster or []))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))


def row_hash(columns: list[str], seed: int) -> Column:
    """One number for the row's values, whatever the order of the columns; NULL and its place count."""
    return F.xxhash64(F.lit(seed), *[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(columns)])


def day_digests(df: DataFrame, at: str, columns: list[str] | None = None) -> DataFrame:
    """day, n_rows and checksum of each day, independent of the order of rows.

    The checksum is the sum of two hashes of every row; equal rows count as often as they occur.
    """
    columns = columns or df.columns
    sums = [F.sum(row_hash(columns, seed).cast("decimal(38,0)")) for seed in (1, 2)]
    return (df.groupBy(F.col(at).cast("date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.struct(*sums).alias("checksum")))


def reconcile(before: DataFrame, after: DataFrame, at: str) -> DataFrame:
    """day, rows_before, rows_after, state of every day of either table.

    ``state`` is equal, lost (only before), added (only after) or differs. Only columns of ``before`` are
    compared; a column that ``after`` lacks is an error.
    """
    missing = set(before.columns) - set(after.columns)
    if missing:
        raise ValueError(f"columns that are gone: {sorted(missing)}")
    left = day_digests(before, at).alias("b")
    right = day_digests(after, at, before.columns).alias("a")
    rows_before, rows_after = F.col("b.n_rows"), F.col("a.n_rows")
    state = (F.when(rows_after.isNull(), "lost").when(rows_before.isNull(), "added")
             .when((rows_before == rows_after) & (F.col("b.checksum") == F.col("a.checksum")), "equal")
             .otherwise("differs"))
    return (left.join(right, F.col("b.day").eqNullSafe(F.col("a.day")), "full")
            .select(F.coalesce("b.day", "a.day").alias("day"), F.coalesce(rows_before, F.lit(0)).alias("rows_before"),
                    F.coalesce(rows_after, F.lit(0)).alias("rows_after"), state.alias("state")))
