"""Rasters onto another grid by area: each pixel is cut at the target's cell edges, and its parts count by their area, so that mass is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clipped(poly: str, axis: str, bound: str, keep_above: bool) -> str:
    """SQL: a polygon (array of x, y in order) cut at axis = bound."""
    inside = lambda p: f"({p}.{axis} {'>=' if keep_above else '<='} {bound})"
    other = "y" if axis == "x" else "x"
    t = f"(({bound}) - p.{axis}) / (q.{axis} - p.{axis})"
    cut = f"named_struct('{axis}', CAST({bound} AS DOUBLE), '{other}', p.{other} + (q.{other} - p.{other}) * ({t}))"
    cut = f"named_struct('x', ({cut}).x, 'y', ({cut}).y)"
    edge = f"concat(CASE WHEN {inside('p')} THEN array(p) ELSE slice(array(p), 1, 0) END, CASE WHEN {inside('p')} <> {inside('q')} THEN array({cut}) ELSE slice(array(p), 1, 0) END)"
    pairs = f"zip_with({poly}, concat(slice({poly}, 2, size({poly})), slice({poly}, 1, 1)), (p, q) -> {edge})"
    return f"CASE WHEN size({poly}) = 0 THEN {poly} ELSE flatten({pairs}) END"


def _area(poly: str) -> str:
    """SQL: the area of a polygon, about its first corner, so that far-off places lose no digits."""
    turned = f"concat(slice({poly}, 2, size({poly})), slice({poly}, 1, 1))"
    o = f"{poly}[0]"
    cross = f"(p.x - {o}.x) * (q.y - {o}.y) - (q.x - {o}.x) * (p.y - {o}.y)"
    return f"CASE WHEN size({poly}) < 3 THEN 0D ELSE abs(aggregate(zip_with({poly}, {turned}, (p, q) -> {cross}), 0D, (s, v) -> s + v)) / 2 END"


def pieces(raster: DataFrame, corner: Callable[[Column, Column], tuple[Column, Column]], value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """keys, iy, ix, value, area: each pixel (y, x, value) cut at the target's cell edges.

    corner gives the target's coordinates (fx, fy, in cells: cell ix is from ix to ix + 1) of a place (x, y) of the raster, where pixel x is from x to x + 1; an edge
    between two corners is straight on the target. Pixels without a value, or with a corner that has no place, are left out.
    """
    keys = keys or []
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    ring = []
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)):
        fx, fy = corner(x + dx, y + dy)
        ring.append(F.struct(fx.cast("double").alias("x"), fy.cast("double").alias("y")))
    quads = raster.select(*keys, v.alias("value"), F.array(*ring).alias("quad")).where(F.col("value").isNotNull() & ~F.exists("quad", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])))
    ends = lambda c: (F.floor(F.array_min(F.transform("quad", lambda p: p[c]))), F.ceil(F.array_max(F.transform("quad", lambda p: p[c]))) - 1)
    for name, c in (("ix", "x"), ("iy", "y")):
        lo, hi = ends(c)
        quads = quads.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))
        low, high = _clipped("quad", c, name, True), _clipped("half", c, f"({name} + 1)", False)
        quads = quads.withColumn("half", F.expr(low)).withColumn("quad", F.expr(high)).drop("half").where(F.size("quad") > 2)
    return quads.select(*keys, F.col("iy").cast("int"), F.col("ix").cast("int"), "value", F.expr(_area("quad")).alias("area")).where("area > 0")


def by_area(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, iy, ix, value (the mean by area), mass (the sum of value times area), area of the cells that any part reaches."""
    keys = keys or []
    s = parts.groupBy(*keys, "iy", "ix").agg(F.sum(F.col("value") * F.col("area")).alias("mass"), F.sum("area").alias("area"))
    return s.select(*keys, "iy", "ix", (F.col("mass") / F.col("area")).alias("value"), "mass", "area")


def class_shares(parts: DataFrame, classes: dict[str, list[int]]) -> DataFrame:
    """iy, ix and, for each named group of classes, its share of the cell's covered area."""
    return parts.groupBy("iy", "ix").agg(*((F.sum(F.when(F.col("value").isin([float(c) for c in v]), F.col("area")).otherwise(0.0)) / F.sum("area")).alias(n) for n, v in classes.items()))


def mosaic(tiles: DataFrame, cells: DataFrame, tile: str = "tile", fallback: DataFrame | None = None, least_share: float = 0.0) -> DataFrame:
    """iy, ix, value of every cell: the mean over the tiles that have a value there (tiles: tile, iy, ix, value, area as by_area gives them), else that of fallback (iy, ix, value), else 0.

    least_share leaves out what a tile says of cells of which it covers less: at a tile's edge another tile knows more.
    """
    mean = tiles.where(F.col("area") >= least_share).groupBy("iy", "ix").agg(F.avg("value").alias("__mean"), F.countDistinct(tile).alias("tiles"))
    out = cells.select("iy", "ix").join(mean, ["iy", "ix"], "left")
    if fallback is not None:
        out = out.join(fallback.select("iy", "ix", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("__other")), ["iy", "ix"], "left")
    other = F.col("__other") if fallback is not None else F.lit(None).cast("double")
    return out.select("iy", "ix", F.coalesce("__mean", other, F.lit(0.0)).alias("value"), F.coalesce("tiles", F.lit(0)).alias("tiles"))


def log_population(density: Column) -> Column:
    """log(1 + people per square kilometre); what is missing or below 0 counts as none."""
    return F.log1p(F.greatest(F.coalesce(F.nanvl(density.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
