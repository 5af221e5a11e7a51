"""Helpers shared by the operators: columns computed by Arrow batches, names, ASCII case."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of input that are worked on at once; longer rows come alone.
SLICE_BYTES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes."""
    step = max(1, int(batch.num_rows * min(1.0, size / max(batch.nbytes, 1))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def with_arrow(df: DataFrame, inputs: list[str], fields: list[T.StructField],
               start: Callable[[], Callable[..., list]], size: int = SLICE_BYTES) -> DataFrame:
    """`df` and the columns `fields`, which Python computes from `inputs` without a shuffle.

    start() is called once in each task and gives a function from the lists of the input cells to
    the lists of the new columns' cells; it gets about `size` bytes of input at once. A column that has the name of a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in new]
    passed = [f.name for f in kept]
    source = df.select(*[F.col(f"`{c}`") for c in passed],
                       *[F.col(f"`{c}`") for c in inputs if c not in passed])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = passed + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, size):
                cells = work(*[part.column(c).to_pylist() for c in inputs])
                columns = [part.column(c) for c in passed]
                columns += [pa.array(v, t) for v, t in zip(cells, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file://" + tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: computed once, with no lineage.

    The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
