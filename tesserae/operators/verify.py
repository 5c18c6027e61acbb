"""Verification: reliability, contingency, rank metrics, capture, histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks


def dense_low_edges(n: int = 10, split: float = 0.1) -> list[float]:
    """Probability edges, half of them below split."""
    return np.unique(np.concatenate([np.linspace(0, split, n // 2 + 1), np.linspace(split, 1, n - n // 2 + 1)])).tolist()


def edge_bin(p: Column, edges: list[float]) -> Column:
    """Place of p between the edges, clipped to the first and last bin."""
    n = sum((F.when(p >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), n))


def reliability(rows: DataFrame, edges: list[float], p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """bin, mean_p, mean_y (weighted), weight; bins without weight are left out."""
    b = rows.groupBy(edge_bin(F.col(p), edges).alias("bin")).agg(F.sum(F.col(p) * F.col(w)).alias("sp"), F.sum(F.col(y) * F.col(w)).alias("sy"), F.sum(w).alias("weight"))
    return b.where("weight > 0").select("bin", (F.col("sp") / F.col("weight")).alias("mean_p"), (F.col("sy") / F.col("weight")).alias("mean_y"), "weight")


def reliability_bootstrap(rows: DataFrame, edges: list[float], key: str, times: int = 300, least_positive: int = 1, seed: int = 0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """reliability() with a percentile band of mean_y from so many Poisson bootstraps.

    Each row has its own Poisson counts from its key's hash, so sums of counts combine before the shuffle and no bin is gathered.
    """
    edges_bin = edge_bin(F.col("p"), edges)

    def sums(frames):
        for f in frames:
            rng = [np.random.default_rng([seed, int(k) & 0x7FFFFFFF]) for k in f["key"]]
            draws = np.stack([g.poisson(1.0, times) for g in rng]) if len(f) else np.zeros((0, times))
            for b, part in f.groupby("bin"):
                d = draws[f.index.get_indexer(part.index)] * part["w"].to_numpy()[:, None]
                yield pd.DataFrame({"bin": [b], "sy": [(d * part["y"].to_numpy()[:, None]).sum(0).tolist()], "sw": [d.sum(0).tolist()], "p": [float((part["p"] * part["w"]).sum())], "y": [float((part["y"] * part["w"]).sum())], "weight": [float(part["w"].sum())], "positives": [int(part["y"].sum())]})

    partial = rows.select(F.xxhash64(key).alias("key"), edges_bin.alias("bin"), "p", F.col("y").cast("double"), F.col("w").cast("double")).mapInPandas(sums, "bin int, sy array<double>, sw array<double>, p double, y double, weight double, positives long")
    each = partial.select("bin", "p", "y", "weight", "positives", F.posexplode(F.arrays_zip("sy", "sw")).alias("draw", "s"))
    mean = each.groupBy("bin", "draw").agg(F.sum("s.sy").alias("sy"), F.sum("s.sw").alias("sw"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum("weight").alias("weight"), F.sum("positives").alias("positives"))
    rate = F.when(F.col("sw") > 0, F.col("sy") / F.col("sw"))
    out = mean.groupBy("bin").agg((F.max("p") / F.max("weight")).alias("mean_p"), (F.max("y") / F.max("weight")).alias("mean_y"), F.max("weight").alias("weight"), F.max("positives").alias("positives"), F.percentile(rate, F.lit(low)).alias("low"), F.percentile(rate, F.lit(high)).alias("high"))
    return out.where(F.col("positives") >= least_positive)


def contingency(rows: DataFrame, thresholds: list[float], p: str = "p", y: str = "y") -> DataFrame:
    """threshold, pod, far, sr, csi, bias; the rows are summed once by the number of thresholds that they reach."""
    reached = sum((F.when(F.col(p) >= F.lit(t), 1).otherwise(0) for t in thresholds), F.lit(0))
    s = rows.groupBy(reached.alias("k")).agg(F.sum(y).cast("double").alias("hits"), F.count("*").cast("double").alias("n"))
    steps = s.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "least int, threshold double")
    all_ = s.agg(F.sum("hits").alias("positive"))
    t = F.broadcast(steps).join(s, F.col("k") >= F.col("least"), "left").groupBy("threshold").agg(F.coalesce(F.sum("hits"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("f")).join(F.broadcast(all_))
    over = lambda x, d: x / F.greatest(d, F.lit(1.0))
    a, f, o = F.col("a"), F.col("f"), F.col("positive")
    return t.select("threshold", over(a, o).alias("pod"), over(f - a, f).alias("far"), over(a, f).alias("sr"), over(a, f + o - a).alias("csi"), over(f, o).alias("bias"))


def exact_auc(rows: DataFrame, p: str = "p", y: str = "y", w: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, auc, ap: by cumulative sums over the distinct scores, so a tie counts half and equal scores are one step.

    rows are read once: the sums of the distinct scores are dealt to ranges of scores and written, and a score's place follows from the sums of
    the ranges above its own and its place in its range. The result reads that table, which stays in the shared folder.
    """
    keys = keys or []
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    own = [f"__k{i}" for i in range(len(keys))]
    steps = rows.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(p).alias("__p")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(F.lit(0.0))).alias("pos"), F.sum(F.when(F.col(y) == 0, weight).otherwise(F.lit(0.0))).alias("neg"))
    ranged = steps.repartitionByRange(*own, F.desc("__p")).withColumn("__r", F.spark_partition_id())
    path = sinks.shared_path(rows.sparkSession, "auc-steps")
    ranged.write.parquet(path)
    held = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    up = Window.partitionBy(*own, "__r").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    # A row for each key and range: of one key's, all are below its own in number of ranges, which is the number of shuffle partitions.
    ranges = held.groupBy(*own, "__r").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("__r", "a", "b"))).alias("all"))
    above = "aggregate(filter(all, v -> v.__r < x.__r), 0D, (s, v) -> s + v.{})"
    sums = F.expr(f"transform(all, x -> named_struct('__r', x.__r, '__tp', {above.format('a')}, '__fp', {above.format('b')}))")
    before = ranges.select(*(F.col(o).alias(f"{o}_") for o in own), F.explode(sums).alias("x")).select(*(f"{o}_" for o in own), F.col("x.__r").alias("__of"), "x.__tp", "x.__fp")
    same = F.col("__r") == F.col("__of")
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))
    s = held.join(before, same).select(*own, "pos", "neg", (F.col("__tp") + F.sum("pos").over(up)).alias("tp"), (F.col("__fp") + F.sum("neg").over(up)).alias("fp"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.when(F.col("tp") + F.col("fp") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    totals = s.groupBy(*own).agg(area.alias("a"), ap.alias("b"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return totals.select(*(F.col(o).alias(k) for o, k in zip(own, keys, strict=True)), (F.col("a") / (F.col("P") * F.col("N"))).alias("auc"), (F.col("b") / F.col("P")).alias("ap"))


def capture(samples: DataFrame, levels: list[float], keys: list[str], p: str = "p") -> DataFrame:
    """keys, level, rate: the percentage of reports whose cell had a probability of at least each level; no forecast counts as 0."""
    each = F.explode(F.array(*(F.struct(F.lit(l).alias("level"), (F.coalesce(p, F.lit(0.0)) >= F.lit(l)).alias("hit")) for l in levels)))  # noqa: E741
    return samples.select(*keys, p).select(*keys, each.alias("e")).groupBy(*keys, "e.level").agg((100.0 * F.avg(F.col("e.hit").cast("double"))).alias("rate"))


def histogram(rows: DataFrame, value: Column, name: str, spine: list[int], keys: list[str]) -> DataFrame:
    """keys, name, n with a row for every value of spine."""
    counts = rows.groupBy(*keys, value.alias(name)).agg(F.count("*").alias("n"))
    dense = rows.select(*keys).distinct().withColumn(name, F.explode(F.array(*map(F.lit, spine))))
    return dense.join(counts, [*keys, name], "left").fillna({"n": 0})


def class_balance(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """keys, n, and of each flag the count and percentage of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(f).alias(f"{f}_n") for f in flags), *((100.0 * F.avg(f)).alias(f"{f}_pct") for f in flags))
