"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(d: Column) -> Column:
    return (F.year(d) * 12 + F.month(d)).cast("int")


def fiscal_year(report: Column) -> Column:
    """The year of the day 15 days before: a year that ends in early January belongs to the year before."""
    return F.year(F.date_sub(report, 15)).cast("int")


def month_begin(d: Column, months: int) -> Column:
    return F.add_months(F.trunc(d, "MM"), months)
