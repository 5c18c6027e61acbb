"""The library's functions from SQL against the same ones on columns."""

import pytest
from pyspark.sql import functions as F
from tesserae import constants as C
from tesserae.functions import bins, columns, geo, sql, times


@pytest.fixture(scope="module")
def known(spark):
    return sql.register(spark)


def test_scalars_equal_columns(spark, known):
    rows = spark.createDataFrame([(h, float(v), c, p, t) for h in ("tor", "wind", "hail", "wildfire", "other") for v in (-1.0, 0.0, 1.0, 1.5, 55.0, 65.0, 74.5, 140.0, 6000.0, float("nan")) for c, p, t in ((0, 0.5, "2024-05-04 11:59:59"), (3, 30.0, "2024-05-05 12:00:00"), (5, 75.0, "2024-05-06 00:00:00"))] + [("tor", None, 1, None, None)], "h string, v double, c int, p double, t string").withColumn("t", F.to_timestamp("t"))
    h, v = F.col("h"), F.col("v")
    pairs = {
        "tess_intensity_bin(h, v)": bins.by_hazard(h, {x: bins.intensity_bin(x, v) for x in C.INTENSITY_EDGES}),
        "tess_pib_bin(h, v)": bins.by_hazard(h, {x: bins.pib_bin(x, v) for x in C.PIB_EDGES}),
        "tess_category(h, p, c)": bins.by_hazard(h, {x: bins.category(x, F.col("p"), F.col("c")) for x in C.CATEGORY_TABLE}),
        "tess_cig(h, p)": bins.by_hazard(h, {x: bins.cig_index(x, F.col("p")) for x in C.CIG_REFERENCE}),
        "tess_split(t)": F.when(F.col("t").isNull(), "train").otherwise(times.split(F.col("t"))),
        "tess_convective_day(t)": times.convective_day(F.col("t")),
        "tess_haversine(c, p, v, 40D)": geo.haversine(F.col("c").cast("double"), F.col("p"), v, F.lit(40.0)),
        "tess_expected_bin(array(1D, p, 2D))": columns.expected_bin(F.array(F.lit(1.0), F.col("p"), F.lit(2.0)), F.lit(0.0)),
        "tess_modal_bin(array(0D, p, v))": columns.modal_bin(F.array(F.lit(0.0), F.col("p"), v)),
        "tess_lead_band(c * 10)": times.lead_band(F.col("c") * 10),
    }
    for text, column in pairs.items():
        got = rows.select(F.expr(text).cast("string").alias("a"), column.cast("string").alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], text
    assert spark.sql("SELECT tess_threshold_text(0.05D), tess_threshold_text(0.3D), tess_percent_name('prob_refc', 40D)").first()[:] == ("0.05", "0.30", "prob_refc_ge40")
    plan = rows.select(F.expr("tess_category(h, p, c)"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "WholeStageCodegen" in plan or "*(1)" in plan


def test_tables_equal_columns(spark, known):
    for miles in (0.0, 25.0, 50.0):
        assert {tuple(r) for r in spark.sql(f"SELECT * FROM tess_stencil({miles}D)").collect()} == set(C.stencil(miles))
    got = spark.sql("SELECT k, lat, lon FROM tess_densify(30D, -100D, 31D, -98D, 5)").collect()
    want = spark.range(1).select(geo.linspace(F.lit(30.0), F.lit(31.0), F.lit(5)).alias("a"), geo.linspace(F.lit(-100.0), F.lit(-98.0), F.lit(5)).alias("b")).first()
    assert [r.k for r in got] == [0, 1, 2, 3, 4] and [r.lat for r in got] == want.a and [r.lon for r in got] == want.b
    assert [tuple(r) for r in spark.sql("SELECT * FROM tess_leads(6, 18, 6)").collect()] == [(6, "f1_6"), (12, "f7_12"), (18, "f13_18")]
