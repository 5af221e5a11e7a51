"""The weighted rubric of the scorecard."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions.wording import CRITERIA, DEFAULT_LANG, phrases
from billweave.schema import RUBRIC

# Dimension, weight, ids of its criteria.
DIMENSIONS = (
    ("architecture", "0.18", ("ARC-01", "ARC-02", "ARC-03", "ARC-04", "ARC-05")),
    ("governance", "0.16", ("GOV-01", "GOV-02", "GOV-03", "GOV-04")),
    ("quality", "0.15", ("QUA-01", "QUA-02", "QUA-03", "QUA-04")),
    ("cost", "0.16", ("COS-01", "COS-02", "COS-03", "COS-04", "COS-05")),
    ("scalability", "0.10", ("SCA-01", "SCA-02", "SCA-03")),
    ("security", "0.11", ("SEC-01", "SEC-02", "SEC-03")),
    ("ai_readiness", "0.14", ("AIR-01", "AIR-02", "AIR-03", "AIR-04")),
)


def default_rubric(spark: SparkSession, lang: str = DEFAULT_LANG) -> DataFrame:
    """28 rows: position of the dimension, dimension, weight, criterion_id and what it asks; the names
    of dimensions are left to the language of a report."""
    phrases(lang)
    return spark.createDataFrame(
        [(place, dimension, Decimal(weight), criterion, None, CRITERIA[lang][criterion])
         for place, (dimension, weight, criteria) in enumerate(DIMENSIONS, 1)
         for criterion in criteria], RUBRIC)


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """A rubric from a YAML file: dimensions -> name, weight, criteria[id, text]."""
    import yaml

    text = spark.read.text(path, wholetext=True).first().value
    dimensions = yaml.safe_load(text)["dimensions"]
    return spark.createDataFrame(
        [(place, dimension, Decimal(str(entry.get("weight", 0))), criterion["id"],
          entry.get("name"), criterion.get("text"))
         for place, (dimension, entry) in enumerate(dimensions.items(), 1)
         for criterion in entry.get("criteria") or [{"id": None}]], RUBRIC)


def dimension_weights(rubric: DataFrame) -> DataFrame:
    """One row per dimension with its weight and the most points it can give."""
    return rubric.groupBy("dimension").agg(
        F.min("position").alias("position"), F.first("weight").alias("weight"),
        F.max("name").alias("name"),
        (F.count("criterion_id") * 2).alias("max_points"))
