"""Training rows: planning, sampling with weights, splits, bags, size classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins, times

#: Room for lead times and for the rows and columns of a grid in row_key.
LEADS, SIDE = 1000, 4096


def hashed_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a key as text: the first 52 bits of its MD5, which any engine can redo. Keys that differ have numbers that are as good as independent."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def row_key(valid: Column, fxx: Column, iy: Column, ix: Column) -> Column:
    """A number for each row of a matrix that no other row has: hour, lead time, and place on a grid of up to SIDE x SIDE cells."""
    hour = F.floor(F.unix_seconds(valid.cast("timestamp")) / 3600).cast("bigint")
    return ((hour * LEADS + fxx) * SIDE + iy) * SIDE + ix


def subsample(rows: DataFrame, positive: Column, key: Column, keep: float, seed: int = 0) -> DataFrame:
    """All positives with weight 1, and the share keep of the rest with weight 1 / keep."""
    chosen = rows.where(positive | (hashed_share(key, seed) < F.lit(keep)))
    return chosen.withColumn("weight", F.when(positive, F.lit(1.0)).otherwise(F.lit(1.0 / keep)))


def bag(rows: DataFrame, positive: Column, key: Column, bags: int, seed: int = 1) -> DataFrame:
    """A row for each positive and bag, and each negative in just one: bag, and weight times bags for negatives. The seed is another than that of
    subsample, or what that has kept would all be in one bag."""
    fold = F.floor(hashed_share(key, seed) * bags).cast("int")
    own = F.when(positive, F.sequence(F.lit(0), F.lit(bags - 1))).otherwise(F.array(fold))
    out = rows.withColumn("bag", F.explode(own))
    return out.withColumn("weight", F.when(positive, F.col("weight")).otherwise(F.col("weight") * bags))


def sample_pairs(hours: DataFrame, leads: list[int]) -> DataFrame:
    """valid, fxx, run for every hour and lead."""
    each = hours.withColumn("fxx", F.explode(F.array(*map(F.lit, leads))))
    return each.withColumn("run", times.run_time(F.col("valid"), F.col("fxx")))


def populated_bands(rows: DataFrame) -> DataFrame:
    """Bands that have a training row."""
    return rows.where(F.col("split") == "train").select(times.lead_band(F.col("fxx")).alias("band")).distinct()


def sized_positives(rows: DataFrame, flag: str, bin_: str, least_rows: int = 50, least_classes: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Positives with a known bin; of each value of keys (hazard, band), or of all, none at all where these are fewer than so many rows or classes."""
    known = rows.where((F.col(flag) == 1) & (F.col(bin_) >= 0))
    enough = known.groupBy(*(F.col(k).alias(f"__{k}") for k in keys or [])).agg(F.count("*").alias("__n"), F.countDistinct(bin_).alias("__c")).where((F.col("__n") >= least_rows) & (F.col("__c") >= least_classes))
    if not keys:
        return known.join(F.broadcast(enough), how="left_semi")  # one row
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return known.join(enough, same, "left_semi")


def size_marginal(sizes: DataFrame, size: str) -> DataFrame:
    """bin, n, share of known positive sizes."""
    known = sizes.where(F.col(size).isNotNull() & ~F.isnan(size) & (F.col(size) > 0))
    counts = known.groupBy(bins.size_bin(F.col(size)).alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("total")).alias("share"))


def weighted_resample(rows: DataFrame, weight: str, key: Column, n: float, seed: int = 0) -> DataFrame:
    """A bootstrap of about n rows, drawn in proportion to weight: a row comes as often as its expected number, rounded up or down by its hash."""
    total = rows.agg(F.sum(weight).alias("total"))
    expected = F.col(weight) * F.lit(float(n)) / F.col("total")
    times = F.floor(expected) + F.when(hashed_share(key, seed) < expected - F.floor(expected), 1).otherwise(0)
    drawn = rows.join(F.broadcast(total)).withColumn("__n", times.cast("int")).where("__n > 0").drop("total")
    return drawn.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__n")
