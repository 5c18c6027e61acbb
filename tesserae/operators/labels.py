"""Labels: reports stamped on the grid around their cell, from points, two-point tracks and damage paths."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo

#: Partitions of merged points for each task of a scan: rows that the scan's task would make of its points are held by so many tasks.
PARTS_A_SPLIT = 4


def around(miles: float = C.NEIGHBOURHOOD_MI) -> Column:
    """The offsets within a radius, as an array of structs; a literal, so nothing is joined."""
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in C.stencil(miles)))


def on_cells(points: DataFrame, miles: float = C.NEIGHBOURHOOD_MI, ny: int = C.NY, nx: int = C.NX, lat: str = "lat", lon: str = "lon", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row for each point and cell within the radius of its own; points outside the grid and cells beyond its edge go. merge: what is done with the points by their own cells (cy, cx) before."""
    iy, ix = geo.cell(F.col(lat), F.col(lon))
    own = points.withColumns({"cy": iy, "cx": ix}).where(geo.in_domain(F.col("cy"), F.col("cx"), ny, nx))
    own = merge(own) if merge else own
    hit = own.withColumn("o", F.explode(around(miles))).withColumns({"iy": F.col("cy") + F.col("o.dy"), "ix": F.col("cx") + F.col("o.dx")})
    return hit.where(geo.in_domain(F.col("iy"), F.col("ix"), ny, nx)).drop("o", "cy", "cx")


def _splits(df: DataFrame) -> float:
    """How many tasks a scan of df's size has, by Spark's own rule, from the plan's statistics alone: nothing runs."""
    state, cores = df.sparkSession._jsparkSession.sessionState().conf(), df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size / min(state.filesMaxPartitionBytes(), max(state.filesOpenCostInBytes(), size / cores))


def once_a_cell(own: DataFrame, key: str, *values: str) -> DataFrame:
    """key, cy, cx, n and the greatest of each of values: one row for the points of a key in a cell. Rows of a key stand in one partition, of which there are more as what is read grows.

    They are merged before they are sent there: a key of very many points has a row for each cell at most.
    """
    parts = max(own.sparkSession.sparkContext.defaultParallelism, math.ceil(PARTS_A_SPLIT * _splits(own)))
    merged = own.groupBy(key, "cy", "cx").agg(F.count("*").alias("n"), *(F.max(v).alias(v) for v in values))
    return merged.repartition(parts, key)


def stamp(points: DataFrame, keys: list[str], miles: float = C.NEIGHBOURHOOD_MI, values: dict[str, Column] | None = None) -> DataFrame:
    """keys, iy, ix, n and the greatest of each of values over the points that reach a cell."""
    merged = [F.max(c).alias(k) for k, c in (values or {}).items()]
    return on_cells(points, miles).groupBy(*keys, "iy", "ix").agg(F.count("*").alias("n"), *merged)


def severe_labels(reports: DataFrame, keys: list[str], miles: float = C.NEIGHBOURHOOD_MI) -> DataFrame:
    """Flag, significant flag, greatest intensity and peak bins per cell of severe reports (with_severity)."""
    severe = reports.where("severe")
    return stamp(severe, keys, miles, {"flag": F.lit(1), "sig": F.col("significant").cast("int"), "bin": F.col("bin"), "pib": F.col("pib")})


def track_points(tracks: DataFrame, step_km: float = 5.0) -> DataFrame:
    """tracks (slat, slon, elat, elon) with lat and lon of evenly spaced points, both ends included."""
    km = geo.haversine(F.col("slat"), F.col("slon"), F.col("elat"), F.col("elon")) * F.lit(C.MI_TO_KM)
    n = tracks.withColumn("n_points", geo.segment_points(km, step_km))
    part = F.col("k").cast("double") / (F.col("n_points") - 1).cast("double")
    each = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_points") - 1)))
    return each.withColumns({"lat": F.col("slat") + (F.col("elat") - F.col("slat")) * part, "lon": F.col("slon") + (F.col("elon") - F.col("slon")) * part})


def path_points(paths: DataFrame, path: str = "path", step_km: float = 5.0) -> DataFrame:
    """paths with lat and lon of the points of each segment of path (array of structs lat, lon); where segments meet, both have the point. A path of one point is that point."""
    ends = F.when(F.size(path) > 1, F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))).otherwise(F.array(F.struct(F.col(path)[0].alias("a"), F.col(path)[0].alias("b"))))
    seg = paths.select("*", F.posexplode(ends).alias("segment", "s"))
    seg = seg.select(*paths.columns, "segment", F.col("s.a.lat").alias("slat"), F.col("s.a.lon").alias("slon"), F.col("s.b.lat").alias("elat"), F.col("s.b.lon").alias("elon"))
    return track_points(seg, step_km).drop("slat", "slon", "elat", "elon")


def fire_labels(points: DataFrame, keys: list[str], miles: float = C.NEIGHBOURHOOD_MI) -> DataFrame:
    """Flag and greatest known size per cell; a known size beats an unknown one."""
    return stamp(points, keys, miles, {"flag": F.lit(1), "size": F.nanvl(F.col("final_size"), F.lit(None).cast("double"))})


def label_summary(labels: DataFrame, flags: list[str]) -> DataFrame:
    return labels.agg(*(F.sum(f).alias(f) for f in flags))


def practically_perfect(labels: DataFrame) -> DataFrame:
    """The greatest flag over a period per cell; to be smoothed with zeros beyond the edge."""
    return labels.groupBy("hazard", "iy", "ix").agg(F.max("flag").alias("flag"))
