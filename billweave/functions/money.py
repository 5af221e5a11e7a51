"""Parsing, rounding and printing of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_TYPE = "decimal(24,10)"

# Labels of rows that hold a total instead of a service.
TOTAL_LABELS = ("total", "total costs ($)", "total cost ($)")

# Blanks of every kind, no-break ones too.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def quick_strip(cell: Column) -> Column:
    """The same, and quicker for a column of cells that mostly begin and end with a visible ASCII character."""
    visible = F.substring(cell, 1, 1).between("!", "~") & F.substring(cell, -1, 1).between("!", "~")
    return F.when(visible, cell).otherwise(strip(cell))


def _without(cell: Column, marks: str) -> Column:
    """Marks are replaced one by one, which takes a tenth of the time of translate()."""
    for mark in marks:
        cell = F.replace(cell, F.lit(mark), F.lit(""))
    return cell


def amount_text(cell: Column, decimal_mark: str = ".") -> Column:
    """A cell without blanks, currency sign and thousands marks, and with a point."""
    if decimal_mark == ".":
        bare = _without(cell, "$,")
    elif decimal_mark == ",":
        bare = F.replace(_without(cell, "$."), F.lit(","), F.lit("."))
    else:
        raise ValueError(f"decimal_mark must be '.' or ',', not {decimal_mark!r}")
    return quick_strip(bare)


def parse_money(cell: Column, decimal_mark: str = ".") -> Column:
    """'$1,234.50' -> 1234.50; blank or non-numeric text and numbers from 1e14 on -> NULL.

    Decimal on purpose: 'nan' and 'inf' become NULL instead of poisoning every total, and sums
    do not depend on the order in which shuffled rows arrive. Amounts are rounded to ten decimals.
    ``reject_reason`` says why a cell is NULL.
    """
    # Spared the cast, which takes longest where it fails.
    word = (cell == "") | F.substring(cell, 1, 1).between("A", "z")
    return F.when(~word | cell.isNull(), amount_text(cell, decimal_mark).try_cast(MONEY_TYPE))


def reject_reason(cell: Column, decimal_mark: str = ".") -> Column:
    """Of a cell that ``parse_money`` gives NULL for: 'missing', 'not a number' or 'out of range'."""
    text = amount_text(cell, decimal_mark)
    return (F.when(text.isNull() | (text == ""), "missing").when(text.rlike(NUMBER), "out of range")
            .otherwise("not a number"))


def is_total_row(service: Column) -> Column:
    return (service == "") | F.lower(strip(service)).isin(*TOTAL_LABELS)


def is_total_label(service: Column) -> Column:
    """The same of a service that is stripped already."""
    return (service == "") | (F.substring(service, 1, 1).isin("t", "T") & F.lower(service).isin(*TOTAL_LABELS))


def amount(cost: Column, unit: int = 1) -> Column:
    """Stored cost -> currency units as DOUBLE; unit=100 when the cost column counts cents."""
    as_double = cost.cast("double")
    return as_double if unit == 1 else as_double / F.lit(float(unit))


def _dotted(x: Column) -> Column:
    return F.translate(F.format_number(x, 0), ",", ".")


def money(x: Column) -> Column:
    """12450.0 -> '$12.450' (no decimals, ties to even, dot between thousands)."""
    return F.concat(F.lit("$"), _dotted(x))


def signed_money(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise("-"), money(F.abs(x)))


def two_figures(x: Column) -> Column:
    """Keep two significant figures of the magnitude; zero stays zero."""
    size = F.abs(x)
    step = F.pow(F.lit(10.0), F.floor(F.log10(size)) - 1)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.bround(size / step, 0) * step)


def coarse_amount(x: Column) -> Column:
    return _dotted(two_figures(x))


def percent(x: Column, digits: int = 0) -> Column:
    """Number text of a percentage, without the sign and without thousands marks."""
    return F.translate(F.format_number(x, digits), ",", "")


def dollars(x: Column) -> Column:
    """12450.5 -> '$12,450.50', the style of the query-cost report."""
    return F.concat(F.lit("$"), F.format_number(x, 2))


def share_pct(part: Column, whole: Column) -> Column:
    """part / whole in percent, two decimals, ties to even; 0 when there is nothing to share."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(F.bround(ratio, 2), F.lit(0.0))


# Divisors of the three byte units in use.
GB = 1e9
TB = 1e12
TIB = float(1 << 40)

# Fixed value: list price of on-demand scanning, USD per TiB.
USD_PER_TIB = 6.25


def scan_price(nbytes: Column, usd_per_tib: float = USD_PER_TIB) -> Column:
    """Price of scanned bytes in whole cents, kept as DECIMAL so that totals are exact."""
    return F.bround(nbytes / F.lit(TIB) * F.lit(float(usd_per_tib)), 2).cast("decimal(18,2)")
