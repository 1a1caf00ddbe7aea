"""Ages, with the present moment as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole days, never below zero; null counts as zero."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400).cast("int")
    return F.coalesce(F.greatest(days, F.lit(0)), F.lit(0))


def age_label(days: Column) -> Column:
    part = lambda n, unit: F.concat(F.floor(days / n).cast("string"), F.lit(unit))
    return F.when(days == 0, "today").when(days < 7, part(1, "d")).when(days < 30, part(7, "w")).otherwise(part(30, "mo"))


def added_since(ts: Column, as_of: Column, days: int) -> Column:
    return ts >= as_of - F.make_dt_interval(F.lit(days))
