import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from billweave.schema import BILLING_FACT  # noqa: E402
from billweave.sources.billing_csv import read_billing  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "6g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


GCP_HEADER = "Project name,Project ID,Service description,Cost ($),Discounts ($),Subtotal ($)\n"
# (project, service, cents) of two months of one customer
JUNE = [("lago", "Map Tiles", 80000), ("lago", "Object Vault", 120000),
        ("cumbre", "Batch Runner", 300000), ("cumbre", "Mail Relay", 7550),
        ("puerto", "Voice Lines", 42450)]
JULY = [("lago", "Map Tiles", 190000), ("lago", "Object Vault", 115000),
        ("cumbre", "Batch Runner", 240000), ("cumbre", "Stream Hub", 95000),
        ("puerto", "Voice Lines", 42450), ("puerto", "Map Tiles", 30000)]


def gcp_csv(bill, mark=""):
    """A cost table with discounts, quoted thousands and a total row."""
    lines = [f'{project},{project}-9,{service},"{(cents + 25) / 100:,.2f}",-0.25,"{cents / 100:,.2f}"'
             for project, service, cents in bill]
    total = sum(cents for *_, cents in bill)
    return mark + GCP_HEADER + "\n".join([*lines, f',,Total,,,"{total / 100:,.2f}"', ""])


@pytest.fixture(scope="session")
def bills(spark, tmp_path_factory):
    """Two periods of one customer: (before, after)."""
    folder = tmp_path_factory.mktemp("bills")
    (folder / "june.csv").write_text(gcp_csv(JUNE, "\ufeff"), encoding="utf-8")
    (folder / "july.csv").write_text(gcp_csv(JULY), encoding="utf-8")
    return (read_billing(spark, str(folder / "june.csv"), "norte", "2026-06-01"),
            read_billing(spark, str(folder / "july.csv"), "norte", "2026-07-01"))


@pytest.fixture(scope="session")
def fact(spark):
    """rows of (account, month number of 2026, service, project, cost) -> billing fact"""
    from decimal import Decimal

    def build(*rows):
        return spark.createDataFrame(
            [(account, dt.date(2026, month, 1), service, project, Decimal(str(cost)))
             for account, month, service, project, cost in rows], BILLING_FACT)
    return build


def rows(df, *columns):
    """Rows as tuples, sorted."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
