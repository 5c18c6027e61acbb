"""Queries over decoded fields and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reproject
from ..sources import fields, views
from .registry import query

#: Cells of a scene made from so many vectors, in rows of ACROSS; levels of a field.
CELLS, ACROSS, LEVELS = 40, 8, 8


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as decoded fields: each is a cell of a scene, eight numbers a field from the lowest level up. Each fifth scene lacks a level of dew points."""
    v = views.columns(spark, sf_dir).select(F.floor(F.col("vec_id") / CELLS).alias("run"), F.lit(1).alias("fxx"), F.floor(F.col("vec_id") % CELLS / ACROSS).alias("y"), (F.col("vec_id") % ACROSS).alias("x"), "v")
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(1000.0 - 75 * k).alias("level"), F.col("v")[8 * i + k].alias("value")) for i, f in enumerate(fields.ISOBARIC) for k in range(LEVELS)))
    rows = v.select("run", "fxx", "y", "x", F.explode(each).alias("e")).select("run", "fxx", "e.field", "e.level", "y", "x", "e.value")
    return rows.where("NOT (run % 5 = 2 AND field = 'dpt' AND level = 475)")


@query("""SELECT run, iy, ix, 8 AS levels, 1000.0::DOUBLE AS lowest, round(v[1], 6) AS tmp_low, round(v[16], 6) AS dpt_top, round(list_sum(v[33:40]), 6) AS hgt_sum FROM (
SELECT vec_id // 40 AS run, (vec_id % 40 // 8)::INT AS iy, (vec_id % 8)::INT AS ix, v, count(*) OVER (PARTITION BY vec_id // 40) AS n FROM v_columns) WHERE n = 40 AND run % 5 <> 2""", ["v_columns"])
def decoded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of levels from rows in any order; scenes with a ragged field, or without all their cells, have none."""
    c, _ = fields.columns_of_levels(decoded(spark, sf_dir), CELLS)
    total = F.aggregate("hgt", F.lit(0.0), lambda s, x: s + x)
    return c.select("run", "iy", "ix", F.size("level").alias("levels"), F.col("level")[0].alias("lowest"), F.round(F.col("tmp")[0], 6).alias("tmp_low"), F.round(F.col("dpt")[LEVELS - 1], 6).alias("dpt_top"), F.round(total, 6).alias("hgt_sum"))


@query("""SELECT run, field, CASE WHEN run % 5 = 2 AND field = 'dpt' THEN 7 ELSE 8 END AS levels, n AS cells FROM (SELECT vec_id // 40 AS run, count(*) AS n FROM v_columns GROUP BY 1), (SELECT unnest(['tmp', 'dpt', 'ugrd', 'vgrd', 'hgt', 'vvel']) AS field) WHERE n <> 40 OR (run % 5 = 2 AND field = 'dpt')""", ["v_columns"])
def decoded_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields for which scenes have to be read again."""
    return fields.damaged_columns(decoded(spark, sf_dir), CELLS).select("run", "field", F.col("levels").cast("int").alias("levels"), "cells")


@query("""SELECT run, iy, ix, round(CASE WHEN median(p) OVER (PARTITION BY run) > 2000 THEN p / 100 ELSE p END, 6) AS psfc, round(v[2], 6) AS t2m FROM (
SELECT vec_id // 40 AS run, (vec_id % 40 // 8)::INT AS iy, (vec_id % 8)::INT AS ix, v, (1000 + 20 * v[1]) * (CASE WHEN vec_id // 40 % 3 = 1 THEN 100 ELSE 1 END) AS p, count(*) OVER (PARTITION BY vec_id // 40) AS n FROM v_columns) WHERE n = 40 AND run % 7 <> 3""", ["v_columns"])
def decoded_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface state with the unit of pressure told by each scene's median; scenes without a required field have none."""
    v = views.columns(spark, sf_dir).select(F.floor(F.col("vec_id") / CELLS).alias("run"), F.lit(1).alias("fxx"), F.floor(F.col("vec_id") % CELLS / ACROSS).alias("y"), (F.col("vec_id") % ACROSS).alias("x"), "v")
    pressure = (1000 + 20 * F.col("v")[0]) * F.when(F.col("run") % 3 == 1, 100).otherwise(1)
    each = F.array(*(F.struct(F.lit(f).alias("field"), (pressure if f == "psfc" else F.col("v")[i + 1]).alias("value")) for i, f in enumerate(fields.REQUIRED)))
    rows = v.select("run", "fxx", "y", "x", F.explode(each).alias("e")).select("run", "fxx", "e.field", F.lit(None).cast("double").alias("level"), "y", "x", "e.value")
    state, _ = fields.surface(rows.where("NOT (run % 7 = 3 AND field = 'u10')"), CELLS, list(fields.REQUIRED))
    return state.select("run", "iy", "ix", F.round("psfc", 6).alias("psfc"), F.round("t2m", 6).alias("t2m"))


#: Pixels of the grid to a cell of the target, and the target's offset.
PIXELS, OFFSET_X, OFFSET_Y = 2.7, 0.3, 0.6


def _overlap(v: str, i: str, offset: float) -> str:
    return f"(least(({v} + 1 + {offset!r}::DOUBLE) / {PIXELS!r}::DOUBLE, {i} + 1) - greatest(({v} + {offset!r}::DOUBLE) / {PIXELS!r}::DOUBLE, {i}))"


@query(f""", p AS (SELECT g.v, t.iy, t.ix, {_overlap('g.iy', 't.iy', OFFSET_Y)} * {_overlap('g.ix', 't.ix', OFFSET_X)} AS a FROM v_grid g, (SELECT y::INT AS iy, x::INT AS ix FROM range(10) a(y), range(13) b(x)) t
WHERE g.v IS NOT NULL AND {_overlap('g.iy', 't.iy', OFFSET_Y)} > 0 AND {_overlap('g.ix', 't.ix', OFFSET_X)} > 0)
SELECT iy, ix, round(sum(v * a) / sum(a), 6) AS value, round(sum(v * a), 4) AS mass, round(sum(a), 6) AS area FROM p GROUP BY 1, 2""", ["v_grid"])
def reproject_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid on a coarser one that doesn't fit it: pixels are cut at the cells' edges."""
    g = views.grid(spark, sf_dir).select(F.col("iy").alias("y"), F.col("ix").alias("x"), F.col("v").alias("value"))
    p = reproject.pieces(g, lambda x, y: ((x + F.lit(OFFSET_X)) / F.lit(PIXELS), (y + F.lit(OFFSET_Y)) / F.lit(PIXELS)))
    return reproject.by_area(p).select("iy", "ix", F.round("value", 6).alias("value"), F.round("mass", 4).alias("mass"), F.round("area", 6).alias("area"))
