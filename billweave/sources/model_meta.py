"""YAML files of model projects -> what they say about models and sources.

Spark has no YAML reader, so the text is parsed in the tasks, batch by batch. A file that cannot be
read in any way is left out; it does not end the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.operators.models import table_freshness

_PARSED = ("project string, kind string, parent string, name string, "
           "has_description boolean, has_tests boolean, has_freshness boolean")


def _parser():
    """The function for mapInPandas. It is built here, not named in the module, so that workers
    get it whole and need no copy of this package."""
    columns = [column.split()[0] for column in _PARSED.split(", ")]

    def items(value, key: str) -> list[dict]:
        entries = value.get(key) if isinstance(value, dict) else None
        return [entry for entry in (entries if isinstance(entries, list) else [])
                if isinstance(entry, dict)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for project, text in zip(batch["project"], batch["yaml"]):
                found = []
                try:
                    document = yaml.safe_load(text)
                    for model in items(document, "models"):
                        tested = any(part.get("tests")
                                     for part in [model, *items(model, "columns")])
                        found.append((project, "model", "", str(model.get("name", "")),
                                      bool(model.get("description")), tested, False))
                    for source in items(document, "sources"):
                        name = str(source.get("name", ""))
                        found.append((project, "source", "", name, False, False,
                                      bool(source.get("freshness"))))
                        for table in items(source, "tables"):
                            found.append((project, "table", name, str(table.get("name", "")), False,
                                          False, bool(table.get("freshness"))))
                except Exception:  # whatever is wrong with one file
                    continue
                rows += found
            yield pd.DataFrame(rows, columns=columns)

    return parse


def parse_schema_files(schema_files: DataFrame) -> DataFrame:
    """Models and sources of all files, from one parse; ``kind`` tells them apart."""
    try:
        import yaml  # noqa: F401
    except ImportError as error:
        raise ImportError("reading model metadata needs PyYAML on driver and workers") from error
    return schema_files.select("project", "yaml").mapInPandas(_parser(), _PARSED)


def model_meta(parsed: DataFrame) -> DataFrame:
    """project, name, has_description, has_tests; one row per mention of a model."""
    return parsed.filter(F.col("kind") == "model").select(
        "project", "name", "has_description", "has_tests")


def source_meta(parsed: DataFrame) -> DataFrame:
    """project, source, table, has_freshness (its own or its source's)."""
    kind = F.col("kind")
    tables = parsed.filter(kind == "table").select(
        "project", F.col("parent").alias("source"), F.col("name").alias("table"), "has_freshness")
    sources = parsed.filter(kind == "source").select(
        "project", F.col("name").alias("source"), "has_freshness")
    return table_freshness(tables, sources)
