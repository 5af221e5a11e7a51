"""Schemas of the tables that operators take."""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DateType, DecimalType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType, TimestampType)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


S, B, L = StringType(), BooleanType(), LongType()

BILLING_FACT = _table(account=S, period=DateType(), service=S, project=S,
                      cost=DecimalType(24, 10))
SPEND_FACT = _table(account=S, used_at=DateType(), service=S, team_tag=S,
                    cost=DecimalType(24, 10))
TABLE_CATALOG = _table(project=S, dataset=S, table=S, num_bytes=L, time_partitioned=B,
                       range_partitioned=B)
JOB_LOG = _table(project=S, user=S, bytes_billed=L, created=TimestampType(), job_type=S,
                 statement_type=S)
MODEL_FILES = _table(project=S, path=S, name=S, sql=S)
MODEL_META = _table(project=S, name=S, has_description=B, has_tests=B)
SOURCE_META = _table(project=S, source=S, table=S, has_freshness=B)
PROJECT_ROOTS = _table(project=S, has_marker=B)
QUERY_LOG = _table(path=S, sql=S, bytes_processed=L, error=S)
PRICED_QUERY = _table(path=S, bytes_processed=L, usd=DecimalType(18, 2), skipped=S, error=S)
RUBRIC = _table(position=IntegerType(), dimension=S, weight=DecimalType(6, 4), criterion_id=S,
                name=S, text=S)
ANSWERS = _table(platform=S, criterion_id=S, score=IntegerType())
SCORES = _table(platform=S, dimension=S, points=L, max_points=L, score=DoubleType())
