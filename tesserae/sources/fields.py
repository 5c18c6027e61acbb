"""Decoded model fields (run, fxx, field, level, y, x, value) as columns of levels and as surface state; scenes that came in damaged are set apart.

A scene is one (run, fxx). Nothing gathers a scene: checks and the unit of pressure are partial sums by scene, columns are groups of one cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCENE = ["run", "fxx"]
CELL = ["iy", "ix"]
#: Fields of columns, of a surface that columns can't do without, and of lagged members.
ISOBARIC = ("tmp", "dpt", "ugrd", "vgrd", "hgt", "vvel")
REQUIRED = ("t2m", "td2m", "u10", "v10", "psfc", "zsfc")
PROBABILITY = ("refc", "refd", "uh03", "uh25")
#: A median pressure above this is in Pa, not mb.
PASCALS = 2000.0


def _known(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))


def block_mean(size: int) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A regrid hook: blocks of size x size cells as their mean. A hook gets rows (keys, y, x, value) and gives rows (keys, iy, ix, value)."""

    def regrid(rows: DataFrame, keys: list[str]) -> DataFrame:
        place = [F.floor(F.col(c) / size).cast("int").alias(f"i{c}") for c in ("y", "x")]
        return rows.groupBy(*keys, *place).agg(F.avg("value").alias("value"))

    return regrid


def as_is(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The hook that leaves the native grid."""
    return rows.select(*keys, F.col("y").cast("int").alias("iy"), F.col("x").cast("int").alias("ix"), "value")


def damaged_columns(rows: DataFrame, cells: int, fields: tuple[str, ...] = ISOBARIC) -> DataFrame:
    """run, fxx, field, levels, cells: fields of scenes whose levels are fewer than the scene's fullest field has (0: none at all), or of which a level has other than so many cells."""
    level = rows.where(F.col("field").isin(*fields) & F.col("level").isNotNull()).groupBy(*SCENE, "field", "level").agg(F.count("*").alias("cells"))
    off = F.max(F.when(F.col("cells") != cells, F.col("cells")))
    each = level.groupBy(*SCENE, "field").agg(F.count("*").alias("levels"), off.alias("off"))
    most = each.groupBy(*SCENE).agg(F.max("levels").alias("most"))
    every = most.withColumn("field", F.explode(F.array(*map(F.lit, fields)))).join(each, [*SCENE, "field"], "left")
    bad = every.withColumn("levels", F.coalesce("levels", F.lit(0))).where("levels < most OR off IS NOT NULL")
    return bad.select(*SCENE, "field", "levels", F.when(F.col("levels") > 0, F.coalesce("off", F.lit(cells))).otherwise(0).alias("cells"))


def columns_of_levels(rows: DataFrame, cells: int, regrid: Callable[[DataFrame, list[str]], DataFrame] = as_is, fields: tuple[str, ...] = ISOBARIC) -> tuple[DataFrame, DataFrame]:
    """(columns, damaged): columns has run, fxx, iy, ix, level (array, falling) and an array for each field; scenes that are in damaged (damaged_columns) have none.

    Rows come in any order. Regridding works level by level, before columns are made. A missing value (null or NaN) stays null at its level.
    """
    own = _known(rows).where(F.col("field").isin(*fields) & F.col("level").isNotNull())
    bad = damaged_columns(rows, cells, fields)
    sound = own.join(bad.select(*SCENE).distinct(), SCENE, "left_anti")
    placed = regrid(sound, [*SCENE, "field", "level"])
    falling = lambda f: F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("level", "value"))), asc=False)
    made = placed.groupBy(*SCENE, *CELL).agg(*(falling(f).alias(f) for f in fields))
    levels = F.transform(fields[0], lambda s: s["level"].cast("double")).alias("level")
    return made.select(*SCENE, *CELL, levels, *(F.transform(f, lambda s: s["value"]).alias(f) for f in fields)), bad


def damaged_surface(rows: DataFrame, cells: int, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """run, fxx, field, cells: required fields that a scene lacks (0) or has with other than so many cells."""
    n = rows.where(F.col("field").isin(*required) & F.col("level").isNull()).groupBy(*SCENE, "field").agg(F.count("*").alias("cells"))
    every = rows.select(*SCENE).distinct().withColumn("field", F.explode(F.array(*map(F.lit, required))))
    return every.join(n, [*SCENE, "field"], "left").select(*SCENE, "field", F.coalesce("cells", F.lit(0)).alias("cells")).where(F.col("cells") != cells)


def pascal_scenes(rows: DataFrame, pressure: str = "psfc", limit: float = PASCALS) -> DataFrame:
    """run, fxx of scenes whose median pressure is above the limit: decided by counts on both sides, and by the two values in the middle where these are equal."""
    p = _known(rows).where((F.col("field") == pressure) & F.col("level").isNull() & F.col("value").isNotNull())
    above = F.col("value") > limit
    s = p.groupBy(*SCENE).agg(F.sum(above.cast("long")).alias("a"), F.count("*").alias("n"), F.min(F.when(above, F.col("value"))).alias("over"), F.max(F.when(~above, F.col("value"))).alias("under"))
    return s.where((2 * F.col("a") > F.col("n")) | ((2 * F.col("a") == F.col("n")) & ((F.col("over") + F.col("under")) / 2 > limit))).select(*SCENE)


def surface(rows: DataFrame, cells: int, fields: list[str], regrid: Callable[[DataFrame, list[str]], DataFrame] = as_is, required: tuple[str, ...] = REQUIRED, pressure: str = "psfc") -> tuple[DataFrame, DataFrame]:
    """(state, damaged): state has run, fxx, iy, ix and a column for each of fields, null where a scene lacks one; pressure in mb. Scenes in damaged (damaged_surface) have no state. Soil or any other field of another product is just more rows."""
    bad = damaged_surface(rows, cells, required)
    sound = _known(rows).where(F.col("field").isin(*fields) & F.col("level").isNull()).join(bad.select(*SCENE).distinct(), SCENE, "left_anti")
    placed = regrid(sound, [*SCENE, "field"])
    state = placed.groupBy(*SCENE, *CELL).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    if pressure in fields:
        state = state.join(pascal_scenes(rows, pressure).withColumn("__pa", F.lit(True)), SCENE, "left")
        state = state.withColumn(pressure, F.when(F.col("__pa"), F.col(pressure) / 100.0).otherwise(F.col(pressure))).drop("__pa")
    return state, bad


def probability_fields(rows: DataFrame, regrid: Callable[[DataFrame, list[str]], DataFrame] = as_is) -> DataFrame:
    """run, fxx, iy, ix and the four fields that lagged members add; no field is required."""
    return surface(rows, 0, list(PROBABILITY), regrid, (), "")[0]


def one_field(rows: DataFrame, field: str, regrid: Callable[[DataFrame, list[str]], DataFrame] = as_is) -> DataFrame:
    """run, fxx, iy, ix, value of one surface field; the filter reaches the scan."""
    return regrid(_known(rows.where((F.col("field") == field) & F.col("level").isNull())), SCENE)
