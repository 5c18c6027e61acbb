"""Queries with fitted models and column physics: rows only, as SQL cannot fit or carry parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import features, models, physics, verify
from ..sources import views
from ..sources.tables import table
from .outlooks import EDGES
from .registry import query

FEATURES = ["n_chars", "words", "upper", "lines"]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    x = d.select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words"), F.length(F.regexp_replace("text", "[^A-Z!#*|]", "")).alias("upper"), F.size(F.split("text", "\n")).alias("lines"))
    day = F.col("doc_id") % 7
    split = F.when(day == 5, "validation").when(day == 6, "test").otherwise("train")
    return x.join(l, "doc_id").select(F.col("doc_id").alias("key"), *FEATURES, F.col("quality").alias("y"), split.alias("split"), F.lit(1.0).alias("weight"), (1 + F.col("doc_id") % 48).alias("fxx"))


@query()
def train_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    band = models.train_band(rows, FEATURES, "y", bags=2, maxIter=8)
    out = models.predict({"f1_48": band}, rows.where("split = 'test'"), FEATURES)
    return out.select(F.col("key").alias("doc_id"), "y", F.round("p", 6).alias("p"))


@query()
def calibrate_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    iso, line = (models.calibrate(s, k) for k in ("isotonic", "logistic"))
    return line.apply(iso.apply(s, "p", "isotonic"), "p", "logistic").select("doc_id", "p", F.round("isotonic", 6).alias("isotonic"), F.round("logistic", 6).alias("logistic"))


@query()
def reliability_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.reliability_bootstrap(views.scores(spark, sf_dir), EDGES, "doc_id")


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    model = models.gbt(rows.where("split = 'train'"), FEATURES, "y", "weight", maxIter=8)
    return models.permutation_importance(model, rows.where("split <> 'train'").select("key", *FEATURES, "y"), FEATURES, "y", "key")


@query()
def partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    model = models.gbt(rows.where("split = 'train'"), FEATURES, "y", "weight", maxIter=8)
    return models.partial_dependence(model, rows.where("split = 'test'"), FEATURES, "upper")


@query()
def intensity_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir).withColumn("bin", (F.col("lines") % 3).cast("int")).withColumn("flag", F.lit(1))
    m = models.multiclass(rows.where("split = 'train'"), FEATURES, "bin", 4, rounds=5, leaves=8)
    test = rows.where("split = 'test'").select("key", *FEATURES)
    out = test.withColumn("dist", F.array(*[F.lit(0.0)] * 4)) if m is None else m.scored(test)
    return out.select(F.col("key").alias("doc_id"), F.transform("dist", lambda v: F.round(v, 6)).alias("dist"))


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of air made from v_columns: warm and moist below, with wind that turns and grows upward."""
    v = views.columns(spark, sf_dir)
    p = F.array(*(F.lit(float(x)) for x in C.FETCH_LEVELS))
    noise = lambda i: F.element_at("v", (i % 60 + 1).cast("int"))
    z = F.transform(p, lambda x: 44330.8 * (1 - F.pow(x / 1013.25, F.lit(0.190263))))
    t = F.transform(z, lambda h, i: F.greatest(F.lit(302.0) - F.lit(0.0067) * h, F.lit(210.0)) + 2 * noise(i))
    td = F.zip_with(t, z, lambda a, h: a - F.lit(2.0) - F.lit(0.003) * h)
    u = F.transform(z, lambda h, i: 4 + F.lit(0.0032) * h + 5 * noise(i + 19))
    w = F.transform(z, lambda h, i: 6 - F.lit(0.0004) * h + 5 * noise(i + 38))
    psfc = F.lit(1000.0) - F.col("vec_id") % 8 * F.lit(5.0)
    return v.select("vec_id", (F.col("vec_id") % 4).alias("scene"), p.alias("level"), t.alias("tmp"), td.alias("dpt"), u.alias("ugrd"), w.alias("vgrd"), z.alias("hgt"), F.transform(p, lambda x, i: noise(i)).alias("vvel"), psfc.alias("psfc"), (44330.8 * (1 - F.pow(psfc / 1013.25, F.lit(0.190263)))).alias("zsfc"), (F.lit(303.0) + noise(F.lit(7))).alias("t2m"), (F.lit(296.0) + noise(F.lit(9))).alias("td2m"), (4 + noise(F.lit(11))).alias("u10"), (6 + noise(F.lit(13))).alias("v10"))


@query()
def sounding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physics.column_features(soundings(spark, sf_dir), ["vec_id"], "scene")


SCENE_NY, SCENE_NX = 12, 16


@query()
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of air as a cell of a scene of 12 x 16 cells, with all features of the catalogue."""
    n = SCENE_NY * SCENE_NX
    cell = lambda c: c.cast("int")
    s = soundings(spark, sf_dir).drop("scene").withColumns({"scene": F.floor(F.col("vec_id") / n), "iy": cell(F.floor(F.col("vec_id") % n / SCENE_NX)), "ix": cell(F.col("vec_id") % SCENE_NX)})
    s = s.withColumns({"lat": F.lit(35.0) + F.col("iy") * F.lit(0.1), "pwat": F.col("td2m") - F.lit(270.0), "elev": F.col("zsfc")})
    return features.scene_features(s, "scene", SCENE_NY, SCENE_NX)


@query()
def spatial_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the dense grid, which the neighbourhood needs; cells without a motion have means and no gradients."""
    return physics.expanded(views.grid(spark, sf_dir), "v", {"own": ("u2", "v2")}, views.NY, views.NX)
