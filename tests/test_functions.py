import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tesserae import constants as C
from tesserae.functions import bins, columns, geo, text, times


def test_stencils_and_grid():
    assert [len(C.stencil(r)) for r in C.RADII_MI] == [21, 89, 357]
    assert (C.NY, C.NX) == (211, 359)
    assert C.X0 == pytest.approx(-2691520.143, abs=1e-3) and C.Y0 == pytest.approx(-1581306.153, abs=1e-3)
    assert C.cig_edges("tor") == pytest.approx([0.6610, 0.9697, 1.2155], abs=1e-4)
    assert C.cig_edges("wildfire") == pytest.approx([1.0825, 1.7950, 2.7850])
    assert [C.lead_band(f) for f in (1, 6, 7, 48)] == ["f1_6", "f1_6", "f7_12", "f43_48"]


@given(st.floats(22, 47), st.floats(-122, -62))
@settings(max_examples=50, deadline=None)
def test_projection_round_trip(lat, lon):
    x, y = C.lcc_xy(lat, lon)
    dy = C.RHO0 - y
    rho = math.hypot(x, dy)
    back = math.degrees(2 * math.atan((C.EARTH_RADIUS * C.LCC_F / rho) ** (1 / C.CONE)) - math.pi / 2)
    assert back == pytest.approx(lat, abs=1e-9)
    assert C.ORIGIN_LON + math.degrees(math.atan2(x, dy) / C.CONE) == pytest.approx(lon, abs=1e-9)


def one(spark, *cols):
    r = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
    return [*r]


def test_bins(spark):
    wind = [bins.intensity_bin("wind", F.lit(v)) for v in (49.9, 50.0, 55.9, 56.0, 83.0)]
    assert one(spark, *wind) == [-1, 0, 0, 1, 4]
    pib = [bins.pib_bin("hail", F.lit(v)) for v in (0.9, 1.0, 5.0, 0.0, float("nan"))]
    assert one(spark, *pib) == [0, 1, 6, -1, -1]
    ef = [bins.intensity_bin("tor", F.lit(v)) for v in (-1.0, 0.0, 4.0, 5.0)]
    assert one(spark, *ef) == [-1, 0, 4, 4]
    cat = [bins.category("tor", F.lit(p), F.lit(c)) for p, c in ((0.9, 0), (1.0, 1), (30.0, 2))]
    assert one(spark, *cat) == [-1, 1, 5]
    assert bins.edge_labels((1.0, 1.5, 2.0)) == ["1-1.5", "1.5-2", "2+"]


@pytest.mark.parametrize("hazard", sorted(C.CATEGORY_TABLE))
def test_category_rises_with_probability(spark, hazard):
    for cig in range(4):
        got = one(spark, *(bins.category(hazard, F.lit(float(p)), F.lit(cig)) for p in range(0, 101, 5)))
        assert got == sorted(got) and got[0] == -1


def test_arrays(spark):
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    dist = a(6, 3, 1)
    assert one(spark, *(columns.quantile_bin(dist, q) for q in (0.5, 0.75, 0.9, 0.95)), columns.quantile_bin(a(0, 0), 0.5)) == [0, 1, 1, 2, -1]
    assert one(spark, columns.modal_bin(a(1, 5, 5)), columns.modal_bin(a(0, 0))) == [1, -1]
    p, v = a(1000, 800, 600), a(10, 20, 40)
    got = one(spark, *(columns.interpolate_logp(p, v, F.lit(float(t))) for t in (1050, 1000, 800, 500)))
    assert got == pytest.approx([10, 10, 20, 40])
    assert one(spark, columns.gradient(a(1, 2, 4, 8), 1.0))[0] == pytest.approx(np.gradient([1, 2, 4, 8]))
    c = one(spark, columns.first_crossing(a(-1, -2, 5, 1, -3)))[0]
    assert (c["index"], c["positive"], c["negative"]) == (2, 6.0, -3.0)
    c = one(spark, columns.first_crossing(a(-1, -2)))[0]
    assert (c["index"], c["positive"], c["negative"]) == (-1, 0.0, 0.0)


def test_text_and_time(spark):
    t = [text.ef_rating(F.lit("rated eF 3")), text.ef_rating(F.lit("none")), text.first_mph(F.lit("gust 61.5 mph")), text.first_mph(F.lit("x")), text.is_prescribed(F.lit("Spring RX 4"))]
    assert one(spark, *t) == [3, -1, 61.5, -1.0, True]
    when = [text.any_time(F.lit(x)).cast("string") for x in ("2023-05-11 20", "2023-05-11T20:30", "2023-05-11", "1683835200000", "soon")]
    assert one(spark, *when) == ["2023-05-11 20:00:00", "2023-05-11 20:30:00", "2023-05-11 00:00:00", "2023-05-11 20:00:00", None]
    day = [times.split(F.lit(d).cast("timestamp")) for d in ("2023-05-12", "2023-05-13", "2023-05-14")]
    assert one(spark, *day) == ["train", "validation", "test"]
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    assert one(spark, geo.point_in_ring(F.lit(1.0), F.lit(1.0), ring), geo.point_in_ring(F.lit(5.0), F.lit(1.0), ring)) == [True, False]


def test_names_thresholds_and_views(spark):
    rows = spark.createDataFrame([("0.05", 0.05), (".30", 0.3), ("SIGN", 0.1), (None, 0.1), ("0.15", 0.150001)], "t string, p double")
    assert [r[0] for r in rows.select(text.at_threshold(F.col("t"), F.col("p"))).collect()] == [True, True, False, False, True]
    assert one(spark, text.threshold_text(F.lit(0.3)), text.feature_name("prob", F.lit("refc"), threshold=F.lit(40.0)), text.feature_name("cape", "sb")) == ["0.30", "prob_refc_ge40", "cape_sb"]
    j = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(NULL AS INT) AS c").select(text.as_json("a", "b", "c").alias("j")).first().j
    assert j == '{"a":1,"b":"x"}'
    places = spark.createDataFrame([(35.0, -97.0), (35.0, -90.0), (50.0, -97.0), (None, -97.0), (0.0, 179.0), (0.0, -179.0), (float("nan"), 179.0)], "lat double, lon double")
    inside = lambda e: [r[0] for r in places.select(geo.in_view(F.col("lat"), F.col("lon"), e)).collect()]
    assert inside((-100.0, -95.0, 30.0, 40.0)) == [True, False, False, False, False, False, False]
    assert inside((170.0, -170.0, -10.0, 10.0)) == [False, False, False, False, True, True, False]
