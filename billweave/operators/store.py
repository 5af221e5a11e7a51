"""Tables that are written once where a result must not be worked out twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_table(spark: SparkSession) -> str:
    """A path for a table in the folder in spark.checkpoint.dir; the table goes when the driver's JVM ends.

    Only in local mode may that setting be missing; a temporary folder is set then.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file://" + tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    table = f"{folder}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return table


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a new table and read from there, without lineage."""
    table = new_table(df.sparkSession)
    df.write.parquet(table)
    return df.sparkSession.read.schema(df.schema).parquet(table)
