"""Models by hazard and band: boosted trees of Spark ML or of trees.py, bags, calibration, ensembles, importance, partial dependence."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dataset, trees, verify

#: Defaults of the trees: rounds, depth, step, bins, shares of rows and columns, least rows of a leaf.
PARAMS = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "maxBins": 64, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": 7}


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with the vector of features; missing values stay NaN for none, so they are put to a value below all."""
    filled = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(-9999.0)).alias(f"__{f}") for f in features]
    held = rows.select("*", *filled)
    return VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__x").transform(held).drop(*(f"__{f}" for f in features))


def gbt(rows: DataFrame, features: list[str], label: str, weight: str | None = None, **params) -> Model:
    """A weighted binary classifier."""
    settings = PARAMS | params
    est = GBTClassifier(featuresCol="__x", labelCol="__y", **({"weightCol": weight} if weight else {}), **settings)
    return est.fit(assembled(rows.withColumn("__y", F.col(label).cast("double")), features))


def leafwise(rows: DataFrame, features: list[str], label: str, weight: str | None = None, **settings) -> trees.Boosted:
    """A weighted binary classifier whose trees grow best leaf first, with L2."""
    return trees.fit(rows, features, label, 1, weight, **settings)


#: Learners by name; a new one is added here.
LEARNERS: dict[str, Callable[..., Model | trees.Boosted]] = {"gbt": gbt, "leafwise": leafwise}


def scored(model: Model | trees.Boosted, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """rows with the probability of class 1."""
    if isinstance(model, trees.Boosted):
        return model.scored(rows, name)
    out = model.transform(assembled(rows, features))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias(name))


def multiclass(rows: DataFrame, features: list[str], label: str, classes: int, flag: str = "flag", weight: str | None = None, **settings) -> trees.Boosted | None:
    """Softmax trees on positives with a known class, or nothing where these are too few or of one class."""
    known = dataset.sized_positives(rows, flag, label)
    model = trees.fit(known, features, label, classes, weight, **settings)
    return model if len(model.seen) > 1 else None


@dataclass
class Calibration:
    """A map of probabilities: steps (isotonic) or a line in log odds (logistic)."""

    kind: str
    model: Model

    def apply(self, rows: DataFrame, p: str = "p", name: str = "calibrated") -> DataFrame:
        if self.kind == "logistic":
            x = _log_odds(F.col(p))
            return rows.withColumn(name, 1 / (1 + F.exp(-(F.lit(float(self.model.coefficients[0])) * x + F.lit(float(self.model.intercept))))))
        fitted = self.model.transform(rows.withColumn("__x", F.col(p))).withColumnRenamed("prediction", name)
        return fitted.select(*rows.columns, name)


def _log_odds(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def calibrate(rows: DataFrame, kind: str, p: str = "p", label: str = "y", weight: str = "w") -> Calibration:
    """Fitted on weighted validation rows, whose base rate is then right."""
    if kind not in ("isotonic", "logistic"):
        raise ValueError(f"no calibration {kind}")
    r = rows.select(F.col(p).alias("p"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("w"))
    if kind == "isotonic":
        return Calibration(kind, IsotonicRegression(featuresCol="p", labelCol="label", weightCol="w").fit(r).setFeaturesCol("__x"))
    x = VectorAssembler(inputCols=["x"], outputCol="features").transform(r.withColumn("x", _log_odds(F.col("p"))))
    return Calibration(kind, LogisticRegression(weightCol="w", labelCol="label").fit(x))


@dataclass
class Band:
    """The models of a lead band: one for each bag, their calibration, and softmax models of what a positive is like, by name (intensity, pib)."""

    bags: list[Model | trees.Boosted]
    calibration: Calibration | None = None
    conditional: dict[str, trees.Boosted] = field(default_factory=dict)


def save_bands(bands: dict[str, Band], features: list[str], path: str, **about) -> None:
    """A folder for each band with its bags and calibration, and a manifest: bands, features in order and what else is said."""
    spark = SparkSession.getActiveSession()
    listed = {}
    for name, band in bands.items():
        for k, m in enumerate(band.bags):
            if isinstance(m, trees.Boosted):
                m.save(f"{path}/{name}/bag-{k}")
            else:
                m.write().overwrite().save(f"{path}/{name}/bag-{k}")
        for k, m in band.conditional.items():
            m.save(f"{path}/{name}/{k}")
        if band.calibration:
            band.calibration.model.write().overwrite().save(f"{path}/{name}/calibration")
        kinds = ["leafwise" if isinstance(m, trees.Boosted) else "gbt" for m in band.bags]
        listed[name] = {"bags": kinds, "calibration": band.calibration and band.calibration.kind, "conditional": sorted(band.conditional)}
    manifest = json.dumps({"bands": listed, "features": features} | about)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bands(path: str) -> tuple[dict[str, Band], dict]:
    """What save_bands wrote: the bands and the manifest."""
    about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/manifest").first()[0])
    bands = {}
    for name, b in about["bands"].items():
        kind = b["calibration"]
        fitted = None
        if kind == "isotonic":
            fitted = Calibration(kind, IsotonicRegressionModel.load(f"{path}/{name}/calibration").setFeaturesCol("__x"))
        elif kind:
            fitted = Calibration(kind, LogisticRegressionModel.load(f"{path}/{name}/calibration"))
        load = {"gbt": GBTClassificationModel.load, "leafwise": trees.Boosted.load}
        bags = [load[learner](f"{path}/{name}/bag-{k}") for k, learner in enumerate(b["bags"])]
        bands[name] = Band(bags, fitted, {k: trees.Boosted.load(f"{path}/{name}/{k}") for k in b["conditional"]})
    return bands, about


def metrics(bands: dict[str, Band], rows: DataFrame, features: list[str], label: str) -> list[tuple[str, str, str, float]]:
    """(band, split, name, value) for rows, auc and ap of the validation and test rows; rows has band."""
    out = []
    for name, band in bands.items():
        own = rows.where((F.col("band") == name) & (F.col("split") != "train"))
        p = mean_of_bags(band, own, features)
        if band.calibration:
            p = band.calibration.apply(p, "p", "__cal").drop("p").withColumnRenamed("__cal", "p")
        counts = {r.split: r["count"] for r in own.groupBy("split").count().collect()}
        for r in verify.exact_auc(p, "p", label, "weight", ["split"]).collect():
            out += [(name, r.split, k, float(v)) for k, v in (("rows", counts[r.split]), ("auc", r.auc), ("ap", r.ap)) if v is not None]
    return out


def train_band(rows: DataFrame, features: list[str], label: str, bags: int = 1, learner: str = "gbt", calibrator: str | None = "isotonic", key: str = "key", conditional: dict[str, tuple[str, int]] | None = None, conditional_settings: dict | None = None, **params) -> Band:
    """rows: split, weight, key, features, label. Each bag has all positives and its own negatives; the bags' mean is calibrated on validation rows.

    conditional: models of what positives are like, by name: the column of their class (below 0: unknown) and the number of classes. Positives are in every bag, so one model
    of each is enough; where these are too few or of one class there is none.
    """
    train_rows = dataset.bag(rows.where("split = 'train'"), F.col(label) == 1, F.col(key), bags)
    band = Band([LEARNERS[learner](train_rows.where(F.col("bag") == b), features, label, "weight", **params) for b in range(bags)])
    if calibrator:
        check = mean_of_bags(band, rows.where("split = 'validation'"), features)
        band.calibration = calibrate(check, calibrator, "p", label, "weight")
    for name, (column, classes) in (conditional or {}).items():
        if m := multiclass(rows.where("split = 'train'"), features, column, classes, label, "weight", **conditional_settings or {}):
            band.conditional[name] = m
    return band


def mean_of_bags(band: Band, rows: DataFrame, features: list[str]) -> DataFrame:
    out = rows
    for k, m in enumerate(band.bags):
        out = scored(m, out, features, f"__b{k}")
    mean = sum((F.col(f"__b{k}") for k in range(len(band.bags))), F.lit(0.0)) / len(band.bags)
    return out.select(*rows.columns, mean.alias("p"))


def predict(bands: dict[str, Band], rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with p: the mean over all bands of each band's calibrated bag mean, for every lead time."""
    out = rows
    for k, b in enumerate(bands.values()):
        out = mean_of_bags(b, out, features)
        if b.calibration:
            out = b.calibration.apply(out, "p", "__cal").drop("p").withColumnRenamed("__cal", "p")
        out = out.withColumnRenamed("p", f"__p{k}")
    mean = sum((F.col(f"__p{k}") for k in range(len(bands))), F.lit(0.0)) / len(bands)
    return out.select(*rows.columns, mean.alias("p"))


def conditional(bands: dict[str, Band], rows: DataFrame, name: str, classes: int) -> DataFrame:
    """rows with the array name: the mean over the bands that have such a model of its shares; zeros where none has."""
    out, models = rows, [b.conditional[name] for b in bands.values() if name in b.conditional]
    for k, m in enumerate(models):
        out = m.scored(out, f"__d{k}")
    each = [sum((F.col(f"__d{k}")[i] for k in range(len(models))), F.lit(0.0)) / max(1, len(models)) for i in range(classes)]
    return out.select(*rows.columns, F.array(*each).alias(name))


def shuffled(rows: DataFrame, column: str, key: str, seed: int, buckets: int = 1024) -> DataFrame:
    """rows with the column's values dealt anew among rows of the same bucket, so that no task sees all rows."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets))
    own = rows.withColumn("__g", bucket)
    place = lambda s: F.row_number().over(Window.partitionBy("__g").orderBy(F.xxhash64(F.lit(s), key), key))
    values = own.select("__g", place(seed + 1).alias("__n"), F.col(column).alias("__v"))
    return own.withColumn("__n", place(seed + 2)).join(values, ["__g", "__n"]).withColumn(column, F.col("__v")).drop("__g", "__n", "__v")


def permutation_importance(model: Model, rows: DataFrame, features: list[str], label: str, key: str, top: int = 25, seed: int = 5) -> DataFrame:
    """feature, drop: how much of the area under the curve goes when a column is shuffled; the top features."""
    base = verify.exact_auc(scored(model, rows, features), "p", label).first()["auc"]
    every = None
    for i, f in enumerate(features):
        s = scored(model, shuffled(rows, f, key, seed + 10 * i), features).select(F.lit(f).alias("feature"), "p", label)
        every = s if every is None else every.unionByName(s)
    auc = verify.exact_auc(every, "p", label, keys=["feature"])
    return auc.select("feature", (F.lit(base) - F.col("auc")).alias("drop")).orderBy(F.desc("drop"), "feature").limit(top)


def partial_dependence(model: Model, rows: DataFrame, features: list[str], feature: str, points: int = 20) -> DataFrame:
    """value, p: the mean score with the feature put to each of its quantiles for all rows."""
    shares = [(i + 0.5) / points for i in range(points)]
    grid = rows.agg(F.percentile_approx(feature, shares).alias("g")).select(F.explode("g").alias("__v")).distinct()
    moved = rows.join(F.broadcast(grid)).withColumn(feature, F.col("__v"))  # a row for each of points quantiles
    return scored(model, moved, features).groupBy(F.col("__v").alias("value")).agg(F.avg("p").alias("p"))
