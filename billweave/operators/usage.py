"""When tables were last read, and what their age and idleness call for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLE = ["project", "dataset", "table"]
# Days without a read from which a table is idle, and from which it is a zombie.
IDLE, ZOMBIE = 30, 90
# Ages beyond count as this many days.
MAX_DAYS = 36_525
# Days that an interval join looks up at once.
BUCKET = 30


def table_reads(jobs: DataFrame) -> DataFrame:
    """Jobs with an array ``tables`` of (dataset, table) -> project, dataset, table, day, once a day.

    A table that every job reads is one row a day for each task before anything is shuffled.
    """
    return (jobs.select("project", F.col("created").cast("date").alias("day"), F.explode("tables").alias("read"))
            .select("project", "read.dataset", "read.table", "day").distinct())


def last_reads(catalog: DataFrame, reads: DataFrame, snapshots: list[dt.date]) -> DataFrame:
    """For every table and snapshot day: the last day up to then on which it was read, or NULL.

    An as-of join: reads and snapshots of a table in one order, each snapshot takes the read before
    it. A table has at most one read a day there, so no table is large.
    """
    days = F.explode(F.array(*[F.lit(day) for day in snapshots]))
    asked = catalog.select(*TABLE, days.alias("day")).distinct()
    both = (reads.select(*TABLE, "day", F.col("day").alias("read"), F.lit(False).alias("asks"))
            .unionByName(asked.select(*TABLE, "day", F.lit(None).cast("date").alias("read"), F.lit(True).alias("asks"))))
    # On one day reads come first: they count for that day's snapshot.
    order = W.partitionBy(*TABLE).orderBy("day", "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (both.withColumn("last_read", F.last("read", ignorenulls=True).over(order)).filter("asks")
            .select(*TABLE, F.col("day").alias("snapshot"), "last_read"))


def table_idleness(catalog: DataFrame, jobs: DataFrame, snapshots: list[dt.date], idle: int = IDLE,
                   zombie: int = ZOMBIE) -> DataFrame:
    """AP-C03: project, dataset, table, snapshot, last_read, idle_days and state.

    ``state`` is used, idle (``idle`` days without a read or more), zombie (``zombie`` or more) or never, for
    tables that no job read up to the snapshot.
    """
    found = last_reads(catalog, table_reads(jobs), snapshots)
    days = F.datediff("snapshot", "last_read")
    state = (F.when(days.isNull(), "never").when(days >= zombie, "zombie").when(days >= idle, "idle")
             .otherwise("used"))
    return found.select("*", days.alias("idle_days"), state.alias("state"))


def in_bands(df: DataFrame, bands: DataFrame, days: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the band that holds ``days``; rows that no band holds get NULL.

    ``bands`` has lower (included), upper (excluded, NULL for none) and the column ``name``. Bands are dealt
    out over buckets of days and met by equality; only those of one's own bucket are compared. Days
    below 0 are in no band, days above a century count as one.
    """
    value = F.when(days > MAX_DAYS, MAX_DAYS).otherwise(days)
    upper = F.coalesce("upper", F.lit(MAX_DAYS + 1))
    dealt = (bands.filter(F.col("lower") < upper)
             .select(F.col("lower").alias("_lower"), upper.alias("_upper"), F.col(name).alias("_name"),
                     F.explode(F.sequence(F.floor(F.col("lower") / BUCKET), F.floor((upper - 1) / BUCKET)))
                     .alias("_of_band")))
    rows = df.withColumns({"_days": value, "_bucket": F.floor(value / BUCKET)})
    inside = F.expr("_bucket = _of_band AND _days >= _lower AND _days < _upper")
    return rows.join(dealt, inside, "left").select(*df.columns, F.col("_name").alias(name))


def retention(catalog: DataFrame, jobs: DataFrame, bands: DataFrame, as_of: dt.date) -> DataFrame:
    """AP-C05: age against last access. Per project, band of age and band of idleness: tables and bytes.

    ``bands`` has lower, upper and action; both the days since creation and those since the last read (or
    since creation, without one) are looked up in it.
    """
    idle = last_reads(catalog, table_reads(jobs), [as_of]).drop("snapshot")
    rows = catalog.join(idle, TABLE, "left").withColumns({
        "age_days": F.datediff(F.lit(as_of), F.col("created").cast("date")),
        "idle_days": F.datediff(F.lit(as_of), F.coalesce("last_read", F.col("created").cast("date")))})
    by_age = in_bands(rows, bands.withColumnRenamed("action", "age_action"), F.col("age_days"), "age_action")
    found = in_bands(by_age, bands, F.col("idle_days"), "action")
    return found.groupBy("project", "age_action", "action").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("num_bytes").alias("num_bytes"),
        F.count_if(F.col("last_read").isNull()).alias("n_never_read"))
