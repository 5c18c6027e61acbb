"""The three jobs of a forecast system as functions on tables: build the training matrix, train by band, predict with products."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import times
from ..operators import dataset, events, grid, models, products
from ..sources import sinks

CELL = ["iy", "ix"]


def member_state(raw: DataFrame, mean: list[str], largest: list[str], block: int = C.BLOCK) -> DataFrame:
    """A run's native fields on the output grid: block means of some, block maxima of others; missing fields stay out."""
    have = set(raw.columns)
    aggs = [F.avg(grid.missing_to_null(F.col(c))).alias(c) for c in mean if c in have] + [F.max(grid.missing_to_null(F.col(c))).alias(c) for c in largest if c in have]
    return grid.blocks(raw, aggs, block, C.NATIVE_NY, C.NATIVE_NX, ["run", "fxx"]).withColumnsRenamed({"by": "iy", "bx": "ix"})


#: How long after its end a day's reports may still change.
GRACE_HOURS = 12


def stale_days(spark: SparkSession, path: str, days: list[dt.date], grace_hours: int = GRACE_HOURS) -> list[dt.date]:
    """Those of days that the store at path was never filled with, or before they were final; in order."""
    log = f"{path.rstrip('/')}.fetched"
    if not sinks.exists(spark, log):
        return sorted(set(days))
    seen = spark.read.parquet(log).where(F.col("day").isin(days)).groupBy("day").agg(F.max("at").alias("at"))
    end = F.date_add("day", 1).cast("timestamp")
    final = {r.day for r in seen.where(times.is_final(end, F.col("at"), grace_hours)).select("day").collect()}  # of the days asked for
    return sorted(set(days) - final)


def refresh_reports(spark: SparkSession, path: str, days: list[dt.date], fetch: Callable[[list[dt.date]], list[DataFrame]], now: dt.datetime, grace_hours: int = GRACE_HOURS, unknown_wind: float | None = None, force: bool = False) -> list[dt.date]:
    """Fills the report store at path, partitioned by day, for days; gives those that were fetched.

    Only days that the store lacks, or had before they were final, are fetched (all, if force): fetch gives a table of reports (time, lat, lon, hazard, magnitude...) of those
    days from each source, the first source's report of equal ones counts. A day is replaced as a whole, one that has no reports any more is emptied. The days are noted only when their
    reports are in place, so a run that dies fetches them again. now is a UTC time without a zone.
    """
    wanted = sorted(set(days)) if force else stale_days(spark, path, days, grace_hours)
    if not wanted:
        return []
    reports = events.merged(*fetch(wanted), unknown_wind=unknown_wind).withColumn("day", F.to_date("time")).where(F.col("day").isin(wanted))
    sinks.overwrite(reports.repartition("day"), path, "day", [{"day": str(d)} for d in wanted])
    noted = spark.createDataFrame([(d,) for d in wanted], "day date").withColumn("at", F.lit(now.isoformat(sep=" ")).cast("timestamp"))
    noted.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}.fetched")
    return wanted


def reports_of(spark: SparkSession, path: str, days: list[dt.date]) -> DataFrame:
    """The stored reports of days; only their partitions are read."""
    return spark.read.parquet(path).where(F.col("day").isin(days))


def plan_samples(reports: DataFrame, leads: list[int], least_reports: int = 1, done: DataFrame | None = None) -> DataFrame:
    """valid, fxx, run of every busy hour and lead that isn't done yet."""
    hours = events.busy_hours(reports, least_reports).select(F.col("hour").cast("timestamp_ntz").alias("valid"))
    pairs = dataset.sample_pairs(hours, leads)
    return pairs if done is None else sinks.not_done(pairs, done, ["run", "fxx"])


def build_matrix(samples: DataFrame, features: DataFrame, labels: DataFrame, flags: list[str], keep: float, seed: int = 0) -> DataFrame:
    """Training rows: samples x cells of features (valid, iy, ix, ...), labels (valid, iy, ix, flags...), split, weight.

    All cells with any flag are kept, of the others the share keep with weight 1 / keep. Labels join before the sampling, and
    a cell without a label has 0. Each join is on (valid, iy, ix), so one partitioning serves all. key is a number of the row.
    """
    keys = ["valid", *CELL]
    rows = samples.join(features, "valid").join(labels.select(*keys, *flags), keys, "left").fillna(0, flags)
    positive = F.lit(False)
    for f in flags:
        positive = positive | (F.col(f) == 1)
    key = dataset.row_key(F.col("valid"), F.col("fxx"), F.col("iy"), F.col("ix"))
    return dataset.subsample(rows.withColumn("key", key), positive, F.col("key"), keep, seed).withColumn("split", times.split(F.col("valid")))


def build_hindcast(hours: DataFrame, features: DataFrame, labels: DataFrame, flags: list[str], keep: float, seed: int = 0) -> DataFrame:
    """Training rows of hours (valid) from the state of that very hour: no lead time (fxx 0) and no limit on what had been issued."""
    samples = hours.select("valid").distinct().withColumns({"fxx": F.lit(0), "run": F.col("valid")})
    return build_matrix(samples, features, labels, flags, keep, seed).drop("fxx", "run")


def build_fire_matrix(runs: DataFrame, features: DataFrame, fires: DataFrame, keep: float = 0.02, leads: list[int] | None = None, least_fires: int = 1, seed: int = 0) -> DataFrame:
    """Training rows of runs (run) at each lead time where so many fires are active: cells with an active fire (fires: irwin, start, end, iy, ix) are all
    kept. One run is one state, so features are (run, fxx, iy, ix, ...)."""
    pairs = runs.select("run").distinct().withColumn("fxx", F.explode(F.array(*map(F.lit, leads or range(1, 25)))))
    pairs = pairs.withColumn("valid", F.col("run") + F.make_dt_interval(hours=F.col("fxx")))
    days = F.sequence(F.date_trunc("DAY", "start"), F.date_trunc("DAY", "end"), F.expr("INTERVAL 1 DAY"))
    active = fires.withColumn("day", F.explode(days)).join(pairs.withColumn("day", F.date_trunc("DAY", "valid")), "day").where("valid BETWEEN start AND end")
    busy = active.groupBy("run", "fxx", "valid").agg(F.countDistinct("irwin").alias("n")).where(F.col("n") >= least_fires).drop("n")
    labels = active.select("run", "fxx", *CELL).distinct().withColumn("flag", F.lit(1))
    rows = features.join(busy, ["run", "fxx"]).join(labels, ["run", "fxx", *CELL], "left").fillna(0, ["flag"])
    key = dataset.row_key(F.col("valid"), F.col("fxx"), F.col("iy"), F.col("ix"))
    return dataset.subsample(rows.withColumn("key", key), F.col("flag") == 1, F.col("key"), keep, seed).withColumn("split", times.split(F.col("valid")))


def with_static(rows: DataFrame, static: DataFrame | None, names: list[str], fill: float | None = None) -> DataFrame:
    """rows with the static fields (iy, ix, names): a left join; without a table, or for names that it lacks, nulls or the fill, and a warning."""
    lacking = [n for n in names if static is None or n not in static.columns]
    if lacking:
        logging.getLogger(__name__).warning("static fields are missing: %s", ", ".join(lacking))
    out = rows if static is None else rows.join(static.select(*CELL, *(n for n in names if n not in lacking)), CELL, "left")
    out = out.withColumns({n: F.lit(None).cast("double") for n in lacking})
    return out if fill is None else out.fillna(fill, names)


def with_temporal(matrix: DataFrame, hours: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """matrix with values of the hours before and after (hours: valid, iy, ix, values) as <v>_before and <v>_after; null where there is no such hour."""
    keys = keys or ["valid", *CELL]
    out = matrix
    for name, shift in (("before", "INTERVAL 1 HOUR"), ("after", "INTERVAL -1 HOUR")):
        moved = hours.select((F.col("valid") + F.expr(shift)).alias("valid"), *CELL, *(F.col(v).alias(f"{v}_{name}") for v in values))
        out = out.join(moved, keys, "left")
    return out


def member_chances(rows: DataFrame, fields: DataFrame, thresholds: dict[str, tuple[float, ...]], members: int = C.MEMBERS) -> DataFrame:
    """rows (valid, fxx, run, iy, ix, ...) with prob_<field>_ge<threshold>: of the newest runs that a forecast of the sample's run could know of, the share whose field (fields: run, fxx, iy, ix, ...) reaches it.

    Only the rows' own cells are looked up. A run without a row doesn't count, a missing value doesn't reach a threshold; without any run the share is null.
    """
    asked = rows.select("valid", "run").distinct()
    runs = events.recent_runs(asked.select(F.col("valid").alias("t"), F.col("run").alias("as_of")), members).select(F.col("t").alias("valid"), F.col("as_of").alias("run"), F.col("run").alias("__run"), F.col("lag").alias("__lag"))
    names = {f"prob_{f}_ge{t:g}": (f, t) for f, ts in thresholds.items() for t in ts if f in fields.columns}
    own = fields.select(F.col("run").alias("__run"), F.col("fxx").alias("__lag"), *CELL, *dict.fromkeys(f for f, _ in names.values()))
    keys = ["valid", "run", *CELL]
    each = rows.select(*keys).distinct().join(runs, ["valid", "run"]).join(own, ["__run", "__lag", *CELL])
    known = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f, _ in names.values()}
    shares = each.groupBy(*keys).agg(*(F.avg(F.coalesce(known[f] >= t, F.lit(False)).cast("double")).alias(n) for n, (f, t) in names.items()))
    return rows.join(shares, keys, "left")


def flush(samples: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, days: int = 7, least_free_gb: float = 0.0, by: str = "valid_date") -> int:
    """Builds the rows of samples (valid, ...) a few days at a time into the table at path, partitioned by day; gives the number of days that are left because the disk is full.

    A day's rows change places by renaming, together with those that the table has of the day already, so a job that dies leaves whole days, and one that goes on
    (samples without those done) repeats none. Progress and the time that is left are logged.
    """
    spark, log = samples.sparkSession, logging.getLogger(__name__)
    # What is left to do may be told by the very table that changes here: the plan is written down first.
    plan = sinks.shared_path(spark, "samples")
    samples.write.parquet(plan)
    samples = spark.read.schema(samples.schema).parquet(plan)
    every = sorted(r[0] for r in samples.select(F.to_date("valid")).distinct().collect())  # days
    began = time.monotonic()
    for k in range(0, len(every), days):
        if (free := sinks.free_gb(spark, path)) < least_free_gb:
            log.warning("%.0f GB are free, less than %.0f: %d days are left", free, least_free_gb, len(every) - k)
            return len(every) - k
        some = every[k : k + days]
        rows = make(samples.where(F.to_date("valid").isin(some))).withColumn(by, F.to_date("valid"))
        if (old := stored(spark, path, rows)) is not None:
            rows = rows.unionByName(old.where(F.col(by).isin(some)))
        sinks.overwrite(rows.repartition(by, F.pmod(F.xxhash64("key"), F.lit(8))), path, by)
        done = min(len(every), k + days)
        log.info("%d of %d days, %.0f s left", done, len(every), (time.monotonic() - began) / done * (len(every) - done))
    return 0


#: All hazards that predictions may have; fires have categories of their own.
FIRE = "wildfire"
PREDICTED = (*C.HAZARDS, FIRE)


def day_categories(predictions: DataFrame, run: str = "run") -> DataFrame:
    """run, hazard, iy, ix with the greatest probability, the greatest hourly cig and their category. A fire's cig counts only where its greatest probability reaches the lowest contour."""
    best = products.with_cig(predictions, hazards=PREDICTED).groupBy(run, "hazard", *CELL).agg(F.max("p").alias("p"), F.max("cig").alias("cig"))
    masked = F.when((F.col("hazard") == FIRE) & ~F.coalesce(F.col("p") >= C.PROB_LEVELS[FIRE][0], F.lit(False)), 0).otherwise(F.col("cig"))
    return products.with_category(best.withColumn("cig", masked.cast("int")), hazards=PREDICTED)


def render(predictions: DataFrame, path: str, run: str = "run") -> None:
    """The products of runs as tables beside one another: hourly (with all that is derived), day maxima, and the combined category of the storms."""
    sinks.overwrite(sinks.prediction_rows(predictions, run, PREDICTED), f"{path}/hourly", run)
    day = day_categories(predictions, run)
    sinks.overwrite(day, f"{path}/day", run)
    storms = day.where(F.col("hazard") != FIRE)
    sinks.overwrite(storms.groupBy(run, *CELL).agg(F.max("category").alias("category")), f"{path}/combined", run)


def classes_of(hazard: str) -> dict[str, int]:
    """The numbers of classes of a hazard's intensity (dist) and, where it has one, of its peak intensity (pib)."""
    return {"dist": len(C.INTENSITY_EDGES[hazard])} | ({"pib": len(C.PIB_EDGES[hazard]) + 1} if hazard in C.PIB_EDGES else {})


def train(matrix: DataFrame, features: list[str], flag: str, bags: int = 1, pooled: bool = False, **params) -> dict[str, models.Band]:
    """A band's models for each lead band with training rows, or one for all."""
    rows = matrix.withColumn("band", F.lit("pooled") if pooled else times.lead_band(F.col("fxx")))
    names = [r.band for r in rows.where("split = 'train'").select("band").distinct().collect()]  # at most eight
    return {b: models.train_band(rows.where(F.col("band") == b), features, flag, bags, **params) for b in sorted(names)}


def with_run(cells: DataFrame) -> DataFrame:
    """cells with their run: as it is there, or what valid and fxx say, or null."""
    if "run" in cells.columns:
        return cells
    return cells.withColumn("run", times.run_time(F.col("valid"), F.col("fxx")) if "valid" in cells.columns else F.lit(None).cast("timestamp"))


def predict(bands: dict[str, models.Band], cells: DataFrame, features: list[str], hazard: str, cached: DataFrame | None = None, hours: list[int] | None = None) -> DataFrame:
    """From cached, if that holds all hours asked for, else computed anew: run, fxx, iy, ix, hazard, p, dist and pib (arrays of shares, zeros without such a model; pib null for a hazard that has none) of cells (run, or valid from which it
    follows, or neither; fxx, iy, ix, features)."""
    if cached is not None and hours and products.covered(cached, hours):
        return cached.where(F.col("fxx").isin(hours) & (F.col("hazard") == hazard))
    rows = cells if not hours else cells.where(F.col("fxx").isin(hours))
    out = models.predict(bands, with_run(rows), features)
    sizes = classes_of(hazard)
    for name, n in sizes.items():
        out = models.conditional(bands, out, name, n)
    pib = F.col("pib") if "pib" in sizes else F.lit(None).cast("array<double>")
    return out.select("run", "fxx", *CELL, F.lit(hazard).alias("hazard"), "p", "dist", pib.alias("pib"))


STORED_BY = ["hazard", "run"]


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The predictions stored at path, with the types of like, or nothing."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def lacking(cells: DataFrame, have: DataFrame | None, hazard: str) -> DataFrame:
    """The cells of runs and lead times that the store has nothing of for the hazard."""
    if have is None:
        return cells
    done = have.where(F.col("hazard") == hazard).select(F.col("run").alias("__run"), F.col("fxx").alias("__fxx")).distinct()
    return cells.join(done, F.col("run").eqNullSafe(F.col("__run")) & (F.col("fxx") == F.col("__fxx")), "left_anti")


def store(predictions: DataFrame, path: str) -> None:
    """Puts predictions of one hazard into the store at path, partitioned by hazard and run. Other hazards, other runs, and lead times of the same runs that predictions don't have, stay."""
    spark = predictions.sparkSession
    if (old := stored(spark, path, predictions)) is not None:
        new = predictions.select(F.col("hazard").alias("__h"), F.col("run").alias("__r"), F.col("fxx").alias("__f")).distinct()
        same = (F.col("hazard") == F.col("__h")) & F.col("run").eqNullSafe(F.col("__r"))
        kept = old.join(new.select("__h", "__r").distinct(), same, "left_semi").join(new, same & (F.col("fxx") == F.col("__f")), "left_anti")
        predictions = predictions.unionByName(kept)
    sinks.overwrite(predictions, path, STORED_BY)


def smoothed(predictions: DataFrame) -> DataFrame:
    """predictions with p as the median of the raw and the two smoothed grids, hour by hour."""
    return grid.median_of_smooths(predictions.select("fxx", "hazard", *CELL, "p"), "p", ["fxx", "hazard"])


def label_flags(reports: DataFrame, cell: tuple[Column, Column]) -> DataFrame:
    """valid, iy, ix, flag of the cells with a report in the hour's window."""
    w = events.in_windows(reports).select(F.col("valid_time").cast("timestamp_ntz").alias("valid"), cell[0].alias("iy"), cell[1].alias("ix"))
    return w.distinct().withColumn("flag", F.lit(1))
