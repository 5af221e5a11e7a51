"""Small text pieces used by reports and findings."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **values: Column) -> Column:
    """'{a} of {b}' with columns for a and b -> one STRING column."""
    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def pad_right(text: Column, width: int) -> Column:
    """Pad with blanks on the right; unlike rpad alone it never shortens."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def pad_left(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def has_template_marks(sql: Column) -> Column:
    """True for SQL text that still holds uncompiled template tags."""
    return sql.contains("{{") | sql.contains("{%")


def score_bar(score: Column) -> Column:
    """Twenty cells, one filled per five points."""
    filled = F.floor(score / F.lit(5)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(20) - filled))


def letters(position: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, ... so that no two positions share a name."""
    alphabet = F.lit(string.ascii_uppercase)
    name, shorter = None, 0
    for width in range(1, 8):
        place = position.cast("long") - (shorter + 1)
        spelled = F.concat(*[
            F.substring(alphabet, (F.floor(place / 26**power) % 26 + 1).cast("int"), F.lit(1))
            for power in reversed(range(width))])
        shorter += 26**width
        fits = position <= shorter
        name = F.when(fits, spelled) if name is None else name.when(fits, spelled)
    return name


# Order and icon of severities.
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}
SEVERITY_ICON = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "⚪"}


def _lookup(key: Column, table: dict, default) -> Column:
    out = None
    for value, result in table.items():
        out = F.when(key == value, result) if out is None else out.when(key == value, result)
    return out.otherwise(default)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_ORDER, 9)


def severity_icon(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_ICON, "⚪")
