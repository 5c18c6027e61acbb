"""Calendar rules: splits, lead bands, convective days, run and valid times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split(t: Column) -> Column:
    """Saturdays validate, Sundays test, the rest trains."""
    day = F.weekday(t)
    return F.when(day == 5, "validation").when(day == 6, "test").otherwise("train")


def lead_band(fxx: Column) -> Column:
    """Name of the six-hour band of a lead time from 1 to 48; null outside."""
    first = F.floor((fxx - 1) / 6) * 6 + 1
    return F.when(fxx.between(1, 48), F.concat(F.lit("f"), first.cast("string"), F.lit("_"), (first + 5).cast("string")))


def convective_day(t: Column) -> Column:
    """Start of the 12-to-12 UTC day that a time belongs to."""
    return F.date_trunc("DAY", t - F.expr("INTERVAL 12 HOURS")) + F.expr("INTERVAL 12 HOURS")


def outlook_day(issued: Column, valid: Column) -> Column:
    """Day number of an outlook, 1 to 3."""
    days = F.datediff(convective_day(valid), convective_day(issued)) + 1
    return F.greatest(F.lit(1), F.least(F.lit(3), days))


def valid_time(run: Column, fxx: Column) -> Column:
    return run + F.make_dt_interval(hours=fxx)


def run_time(valid: Column, fxx: Column) -> Column:
    return valid - F.make_dt_interval(hours=fxx)


def is_final(day_end: Column, seen: Column, grace_hours: int) -> Column:
    """Whether what was fetched at a time may be trusted for a day: only after its grace."""
    return seen >= day_end + F.make_dt_interval(hours=F.lit(grace_hours))
