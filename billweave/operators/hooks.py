"""Extension points: plain functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[..., DataFrame]


def apply_quantifiers(findings: DataFrame, *quantifiers: Step) -> DataFrame:
    """Pass findings through each function in turn, e.g. to fill ``impact_usd``."""
    for quantifier in quantifiers:
        findings = findings.transform(quantifier)
    return findings


def choose(table: dict[str, Step], name: str, builtin: dict[str, Step]) -> Step:
    """A renderer or report template by name: the caller's own first, then the built-in ones. The
    only own template also replaces the built-in 'default'."""
    if name == "default" and len(table) == 1:
        return next(iter(table.values()))
    found = table.get(name) or builtin.get(name)
    if found is None:
        raise KeyError(f"unknown {name!r}; known: {sorted({*table, *builtin})}")
    return found


def render(renderers: dict[str, Step], name: str, findings: DataFrame,
           context: dict[str, DataFrame], builtin: dict[str, Step] | None = None) -> DataFrame:
    """Call a renderer with findings and a context such as {'lines': ...}."""
    return choose(renderers, name, builtin or {})(findings, context)
