"""Products of predictions: severity classes, category lookups, day maxima, ensembles of bands, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import bins, columns


def severity(dist: Column) -> Column:
    """Expected bin; 0 without mass."""
    return columns.expected_bin(dist, F.lit(0.0))


def with_cig(preds: DataFrame, dist: str = "dist", hazards: tuple[str, ...] = C.HAZARDS) -> DataFrame:
    """preds with severity and cig (0 to 3) of each row's hazard."""
    s = preds.withColumn("severity", severity(F.col(dist)))
    return s.withColumn("cig", bins.by_hazard(F.col("hazard"), {h: bins.cig_index(h, F.col("severity")) for h in hazards}))


def with_category(rows: DataFrame, p: str = "p", cig: str = "cig", hazards: tuple[str, ...] = C.HAZARDS) -> DataFrame:
    """rows with the category of probability (0 to 1) and cig; -1 below the lowest level."""
    percent = F.col(p) * F.lit(100.0)
    return rows.withColumn("category", bins.by_hazard(F.col("hazard"), {h: bins.category(h, percent, F.col(cig)) for h in hazards}))


def day_max(preds: DataFrame) -> DataFrame:
    """hazard, iy, ix with the day's greatest probability and greatest hourly cig, and their category."""
    hourly = with_cig(preds)
    day = hourly.groupBy("hazard", "iy", "ix").agg(F.max("p").alias("p"), F.max("cig").alias("cig"))
    return with_category(day)


def combined(preds: DataFrame) -> DataFrame:
    """iy, ix with the greatest category over the hazards."""
    return day_max(preds).groupBy("iy", "ix").agg(F.max("category").alias("category"))


def weighted_distribution(preds: DataFrame, keys: list[str], n: int, dist: str = "dist", weight: str = "p") -> DataFrame:
    """keys, bin, share: the distributions' mean weighted by probability, summing to 1; all in one pass of partial sums."""
    sums = preds.groupBy(*keys).agg(*(F.sum(F.get(F.col(dist), F.lit(i)) * F.col(weight)).alias(f"__{i}") for i in range(n)))
    total = sum((F.coalesce(f"__{i}", F.lit(0.0)) for i in range(n)), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(i).alias("bin"), F.when(total > 0, F.coalesce(f"__{i}", F.lit(0.0)) / total).alias("share")) for i in range(n)))
    return sums.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")


def logistic_calibration(p: Column, a: float, b: float) -> Column:
    """Platt's map of clipped log odds."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-(F.lit(a) * F.log(q / (1 - q)) + F.lit(b))))


def ensemble(scored: DataFrame, keys: list[str], calibration: dict[str, tuple[float, float]]) -> DataFrame:
    """keys, p: scored (keys, band, bag, p) averaged over bags, calibrated per band, averaged over bands; in that order."""
    bag_mean = scored.groupBy(*keys, "band").agg(F.avg("p").alias("p"))
    out = F.col("p")
    for band, (a, b) in calibration.items():
        out = F.when(F.col("band") == band, logistic_calibration(F.col("p"), a, b)).otherwise(out)
    return bag_mean.withColumn("p", out).groupBy(*keys).agg(F.avg("p").alias("p"))


def aligned_bins(dist: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, bin, share with a row for every bin; bins that a model hasn't seen have 0."""
    cells = dist.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.join(dist, [*keys, "bin"], "left").fillna({"share": 0.0})


def reference_tilts(marginal: DataFrame, tilts: tuple[float, ...] = C.TILTS) -> DataFrame:
    """tilt, bin, percent: the marginal (bin, share) times exp(tilt * bin), summing to 100, to two decimals (half to even)."""
    t = F.explode(F.array(*map(F.lit, tilts)))
    w = marginal.withColumn("tilt", t).withColumn("w", F.col("share") * F.exp(F.col("tilt") * F.col("bin")))
    total = w.groupBy("tilt").agg(F.sum("w").alias("total"))  # a row for each tilt
    return w.join(F.broadcast(total), "tilt").select("tilt", "bin", F.bround(100 * F.col("w") / F.col("total"), 2).alias("percent"))


def covered(predictions: DataFrame, hours: list[int]) -> bool:
    """Whether stored predictions hold every hour asked for."""
    have = predictions.where(F.col("fxx").isin(hours)).select("fxx").distinct().count()
    return have == len(set(hours))
