"""Parsing of texts that reports come with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def ef_rating(text: Column) -> Column:
    """The digit of an EF rating in any case, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)EF\s*([0-5])", 1), F.lit("")).cast("int"), F.lit(-1))


def first_mph(text: Column) -> Column:
    """The first number, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(-1.0))


def damage_hazard(text: Column, ef: Column) -> Column:
    """tor for a rated tornado, wind where the text speaks of it, else null."""
    up = F.upper(text)
    return F.when(ef >= 0, "tor").when(up.contains("TSTM") | up.contains("WIND"), "wind")


def is_prescribed(name: Column) -> Column:
    """Whether a fire's name has a token of prescribed burns."""
    up, out = F.upper(name), F.lit(False)
    for t in C.PRESCRIBED_TOKENS:
        out = out | up.contains(t)
    return out


def first_positive(*values: Column) -> Column:
    """The first that reads as a number above zero."""
    numbers = [v.try_cast("double") for v in values]
    return F.coalesce(*(F.when((x > 0) & ~F.isnan(x), x) for x in numbers))


def any_time(text: Column) -> Column:
    """UTC time from 'YYYY-MM-DD[ HH[:MM[:SS]]]' (T allowed) or from epoch milliseconds; else null."""
    clean = F.regexp_replace(F.trim(text), "T", " ")
    clean = F.regexp_replace(clean, r"\s*(Z|UTC)$", "")
    shapes = [F.try_to_timestamp(clean, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd")]
    millis = F.when(clean.rlike(r"^\d{11,14}$"), F.timestamp_millis(clean.try_cast("bigint")))
    return F.coalesce(*shapes, millis)


def threshold_text(p: Column) -> Column:
    """A probability as outlooks write their thresholds, with two decimals: 0.05."""
    return F.format_string("%.2f", p.cast("double"))


def at_threshold(text: Column, p: Column) -> Column:
    """Whether an outlook's threshold says the probability: told as numbers, so that 0.3, 0.30 and .30 are the same; texts that are no number (SIGN) say none."""
    return F.coalesce(F.round(text.try_cast("double"), 2) == F.round(p.cast("double"), 2), F.lit(False))


def feature_name(*parts: Column | str, threshold: Column | None = None) -> Column:
    """Parts joined by underscores, and the whole number of a threshold as _ge<n>: the names that generated features have."""
    name = F.concat_ws("_", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return name if threshold is None else F.concat(name, F.lit("_ge"), threshold.cast("int").cast("string"))


def as_json(*columns: str) -> Column:
    """Columns as one JSON object; nulls are left out, times are in ISO form."""
    return F.to_json(F.struct(*columns))
