"""Loaders of tables, files and feeds; every reader prunes columns and pushes filters down to its scan where the format allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .feeds import PagedReader, PagedSource, date_literal, fetch, records, timestamp_literal, with_retry  # noqa: F401

REPORT_DDL = "time timestamp_ntz, lat double, lon double, hazard string, magnitude double, ef int, source string, wind_mph double"
TRACK_DDL = "time timestamp_ntz, slat double, slon double, elat double, elon double, ef int"
DAMAGE_DAY_DDL = "points array<struct<lat: double, lon: double, mph: double, ef: int, hazard: string>>, tracks array<struct<path: array<array<double>>, maxwind: double, ef: int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, path: str, where: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A parquet file or folder of parts, or a table of the catalogue as 'table:name'; the filter and the columns reach the scan."""
    df = spark.table(path.removeprefix("table:")) if path.startswith("table:") else spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def feature_columns(df: DataFrame, not_features: set[str]) -> list[str]:
    """Columns of a schema that are neither labels nor about the row; no data is read."""
    return [c for c in df.columns if c not in not_features]


def _first_by_hash(rows: DataFrame, key: list[str], caps: dict[str, int], seed: int) -> DataFrame:
    """Of each split in caps at most so many rows, the first by a seeded hash of the key: counts by the hash's high bits find the
    bucket in which a cap is reached, and only that bucket's rows are sorted."""
    h = F.xxhash64(F.lit(seed), *key)
    bucket = F.shiftright(h, 48)
    by = Window.partitionBy("split").orderBy("bucket")
    counts = rows.groupBy("split", bucket.alias("bucket")).count().withColumn("before", F.sum("count").over(by) - F.col("count"))  # at most 2 ** 16 rows of a split
    cap = F.element_at(F.create_map(*(F.lit(x) for k, n in caps.items() for x in (k, n))), F.col("split"))
    edges = {r.split: (r.bucket, cap_left) for r in counts.where(F.col("before") < cap).groupBy("split").agg(F.max(F.struct("bucket", "before")).alias("e")).select("split", "e.*").collect() if (cap_left := caps[r.split] - r.before) > 0}
    out = rows.where("false")
    for split, (edge, left) in edges.items():
        own = rows.where(F.col("split") == split)
        out = out.unionByName(own.where(bucket < edge)).unionByName(own.where(bucket == edge).orderBy(h, *key).limit(left))
    return out


def capped_split(df: DataFrame, split: str, key: list[str], cap: int | None = None, seed: int = 0, bag: int = 0, bags: int = 1, positive: Column | None = None) -> DataFrame:
    """Rows of a split; of the negatives those of one of bags disjoint folds; then at most cap rows, the first by a seeded hash of the key."""
    rows = df.where(F.col("split") == split)
    if bags > 1:
        fold = F.pmod(F.xxhash64(F.lit("fold"), *key), F.lit(bags)) == bag
        rows = rows.where(fold if positive is None else positive | fold)
    return rows if cap is None else _first_by_hash(rows, key, {split: cap}, seed)


def capped_splits(df: DataFrame, key: list[str], caps: dict[str, int], seed: int = 0) -> DataFrame:
    """Rows of several splits, training and validation say, each to its own cap, from one count of both."""
    return _first_by_hash(df.where(F.col("split").isin(*caps)), key, caps, seed)


def final_days(reports: DataFrame, as_of: Column, grace_hours: int = 12) -> DataFrame:
    """Reports of days that were over for the grace at as_of."""
    day_end = F.date_trunc("DAY", F.col("time")) + F.expr("INTERVAL 1 DAY")
    return reports.where(as_of >= day_end + F.make_dt_interval(hours=F.lit(grace_hours)))


def csv_reports(spark: SparkSession, path: str) -> DataFrame:
    """time, lat, lon, size of a CSV feed; values that don't parse are null and incomplete rows go."""
    raw = spark.read.option("header", True).schema("time string, lat string, lon string, size string").csv(path)
    return raw.select(text.any_time(F.col("time")).alias("time"), *(F.col(c).try_cast("double").alias(c) for c in ("lat", "lon", "size"))).na.drop(subset=["time", "lat", "lon"])


def damage_days(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and paths of damage-day JSON files, one document a file; points of unknown hazard go, pairs are (lat, lon)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", DAMAGE_DAY_DDL).alias("d"))
    points = raw.select(F.explode("d.points").alias("p")).select("p.*").where(F.col("hazard").isNotNull())
    tracks = raw.select(F.explode("d.tracks").alias("t")).select(F.transform("t.path", lambda q: F.struct(q[0].alias("lat"), q[1].alias("lon"))).alias("path"), F.col("t.maxwind").alias("maxwind_mph"), F.col("t.ef").alias("ef"))
    return points, tracks


def tracks_in_window(tracks: DataFrame, centre: Column, half_minutes: int) -> DataFrame:
    """Tracks of a closed window; a zero end point becomes the start, a rating outside 0 to 5 becomes -1."""
    half = F.make_dt_interval(mins=F.lit(half_minutes))
    nowhere = (F.col("elat") == 0) | (F.col("elon") == 0)
    return tracks.where(F.col("time").between(centre - half, centre + half)).select("time", "slat", "slon", F.when(nowhere, F.col("slat")).otherwise(F.col("elat")).alias("elat"), F.when(nowhere, F.col("slon")).otherwise(F.col("elon")).alias("elon"), F.when(F.col("ef").between(0, 5), F.col("ef")).otherwise(-1).alias("ef"))


def incidents(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Incidents whose time overlaps a period; those not contained yet count as open; prescribed burns and incomplete rows go."""
    overlap = (F.col("start") <= end) & (F.col("contain").isNull() | (F.col("contain") >= start))
    return rows.where(F.col("irwin").isNotNull() & F.col("start").isNotNull() & overlap & ~F.coalesce(text.is_prescribed(F.col("name")), F.lit(False)))


def progressions(versions: DataFrame) -> DataFrame:
    """irwin, footprint: versions (irwin, time, points) as one array by time."""
    return versions.groupBy("irwin").agg(F.array_sort(F.collect_list(F.struct("time", "points"))).alias("footprint"))


def grid_rows(raster: DataFrame, value: str = "value", block: int = 5, combine: str = "avg") -> DataFrame:
    """A raster's rows (y, x, value) averaged (or combined otherwise) to blocks iy, ix; NaN counts as missing."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return raster.groupBy(F.floor(F.col("y") / block).cast("int").alias("iy"), F.floor(F.col("x") / block).cast("int").alias("ix")).agg(getattr(F, combine)(v).alias(value))


def class_fractions(raster: DataFrame, classes: dict[str, list[int]], block: int = 5) -> DataFrame:
    """For each named group of classes, its share of a block's cells."""
    iy, ix = (F.floor(F.col(c) / block).cast("int").alias(f"i{c}") for c in ("y", "x"))
    return raster.groupBy(iy, ix).agg(*(F.avg(F.when(F.col("value").isin(v), 1.0).otherwise(0.0)).alias(n) for n, v in classes.items()))
