"""Ordered computations along a column of levels, as higher-order functions on arrays; nothing is exploded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolate(coord: Column, values: Column, target: Column) -> Column:
    """Linear in coord, which rises along the array; clamped to the ends, and to the lower level where a span is zero."""
    k = F.size(coord)
    below = F.size(F.filter(coord, lambda c: c < target))
    hi = F.greatest(F.lit(1), F.least(k - 1, below))
    lo = hi - 1
    span = coord[hi] - coord[lo]
    w = F.when(span > 0, (target - coord[lo]) / span).otherwise(F.lit(0.0))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))
    return values[lo] + w * (values[hi] - values[lo])


def interpolate_logp(pressure: Column, values: Column, target: Column) -> Column:
    """interpolate() in log pressure; pressure falls along the array."""
    return interpolate(F.transform(pressure, lambda p: -F.log(p)), values, -F.log(target))


def running(values: Column, combine, start: Column) -> Column:
    """The array of combine over each value and what came before it."""
    kind = "array<double>"
    grown = F.aggregate(values, F.struct(start.alias("at"), F.array().cast(kind).alias("all")), lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["all"], F.array(combine(acc["at"], v))).alias("all")), lambda acc: acc["all"])
    return grown


def running_max(values: Column) -> Column:
    return running(values, lambda m, v: F.greatest(m, v), F.lit(float("-inf")))


def running_sum(values: Column) -> Column:
    return running(values, lambda s, v: s + v, F.lit(0.0))


def trapezoid(values: Column, step: float) -> Column:
    """Integral over evenly spaced values."""
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: (a + b) / 2 * F.lit(step))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def gradient(values: Column, step: float) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(values)
    return F.transform(values, lambda _, i: (values[F.least(i + 1, n - 1)] - values[F.greatest(i - 1, F.lit(0))]) / ((F.least(i + 1, n - 1) - F.greatest(i - 1, F.lit(0))) * F.lit(step)))


def first_crossing(contributions: Column) -> Column:
    """(index, positive, negative): the first level where the running sum is above zero; the positive parts from there on and the negative parts below; index -1 and zeros if there is none."""
    kind = "struct<i: int, cum: double, index: int, positive: double, negative: double>"

    def step(s: Column, v: Column) -> Column:
        cum = s["cum"] + v
        at = F.when((s["index"] < 0) & (cum > 0), s["i"]).otherwise(s["index"])
        return F.struct((s["i"] + 1).alias("i"), cum.alias("cum"), at.alias("index"), F.when((at >= 0) & (v > 0), s["positive"] + v).otherwise(s["positive"]).alias("positive"), F.when((at < 0) & (v < 0), s["negative"] + v).otherwise(s["negative"]).alias("negative"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("cum"), F.lit(-1).alias("index"), F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative")).cast(kind)
    none = F.lit(0.0)
    return F.aggregate(contributions, start, step, lambda s: F.struct(s["index"].alias("index"), F.when(s["index"] >= 0, s["positive"]).otherwise(none).alias("positive"), F.when(s["index"] >= 0, s["negative"]).otherwise(none).alias("negative")))


def quantile_bin(dist: Column, q: float) -> Column:
    """The first bin where the cumulative share reaches q; -1 without mass."""
    total = F.aggregate(dist, F.lit(0.0), lambda s, v: s + v)
    cum = running_sum(dist)
    return F.when(total > 0, F.array_min(F.filter(F.transform(cum, lambda c, i: F.when(c / total >= F.lit(q), i)), lambda i: i.isNotNull()))).otherwise(-1)


def modal_bin(dist: Column) -> Column:
    """The first largest bin; -1 without mass."""
    clean = F.transform(dist, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(clean, F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.array_position(clean, F.array_max(clean)).cast("int") - 1).otherwise(-1)


def expected_bin(dist: Column, none: Column) -> Column:
    """Mean bin by mass; none without mass."""
    total = F.aggregate(dist, F.lit(0.0), lambda s, v: s + v)
    moment = F.aggregate(F.transform(dist, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, moment / total).otherwise(none)


def recurrence(values: Column, start: Column, step) -> Column:
    """The array of states s[i] = step(s[i-1], values[i]) from start on; the state is carried, so this is no window."""
    return running(values, step, start)
