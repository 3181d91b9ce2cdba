"""Fiscal calendar: the year runs April to March and is named by its first calendar year."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(day: Column) -> Column:
    return F.year(F.add_months(day.cast("date"), -3))


def fiscal_quarter(day: Column) -> Column:
    return F.quarter(F.add_months(day.cast("date"), -3))


def in_fiscal_year(day: Column, year: int) -> Column:
    """Range predicate on the bare column, so that it reaches the scan."""
    return (day >= F.lit(f"{year}-04-01").cast("date")) & (
        day < F.lit(f"{year + 1}-04-01").cast("date")
    )
