import functools
import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tesserae import constants as C
from tesserae.functions import soundings
from tesserae.operators import dataset, events, grid, labels, models, physics, products, verify
from tesserae.plans import events as events_plans
from tesserae.sources import sinks, tables, views

from .compare import same
from .conftest import SF


def dense(spark, field):
    rows = [(y, x, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(field)]
    return spark.createDataFrame(rows, "iy int, ix int, v double")


def back(df, shape, col):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.iy, r.ix] = np.nan if r[col] is None else r[col]
    return out


@pytest.fixture(scope="module")
def field():
    f = np.random.default_rng(1).normal(size=(13, 17))
    f[3, 4] = f[0, 0] = np.nan
    return f


def test_neighbourhood_against_numpy(spark, field):
    r = C.cells(50.0)
    got = grid.neighbourhood(dense(spark, field), ["v"], r)
    want, spread = np.empty(field.shape), np.empty(field.shape)
    for (y, x), _ in np.ndenumerate(field):
        near = [field[b, a] for b in range(field.shape[0]) for a in range(field.shape[1]) if (b - y) ** 2 + (a - x) ** 2 <= r * r]
        want[y, x], spread[y, x] = np.nanmean(near), np.nanstd(near)
    assert np.allclose(back(got, field.shape, "v_mean"), want) and np.allclose(back(got, field.shape, "v_std"), spread)


def test_neighbourhood_of_nothing_is_null(spark):
    got = grid.neighbourhood(dense(spark, np.full((3, 3), np.nan)), ["v"], 1.0)
    assert got.where("v_mean IS NOT NULL OR v_std IS NOT NULL").count() == 0


def test_gradient_and_smoothing_against_numpy(spark, field):
    f = np.nan_to_num(field)
    g = grid.gradients(dense(spark, f), ["v"], 2.0)
    assert np.allclose(back(g, f.shape, "v_dx"), np.gradient(f, 2.0, axis=1)) and np.allclose(back(g, f.shape, "v_dy"), np.gradient(f, 2.0, axis=0))
    k = np.array(grid.kernel(1.5))
    n = len(k) // 2
    line = lambda a: np.convolve(np.pad(a, n, mode="edge"), k, "valid")
    want = np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, f))
    assert np.allclose(back(grid.gaussian(dense(spark, f), ["v"], 1.5), f.shape, "v"), want)
    assert sum(grid.kernel(C.cells(25))) == pytest.approx(1) and len(grid.kernel(C.cells(25))) == 23


def test_directional_gradient_of_a_plane(spark):
    plane = np.add.outer(2.0 * np.arange(20), 3.0 * np.arange(20))
    d = dense(spark, plane).withColumns({"u": F.lit(1.0), "w": F.lit(0.0)})
    r = grid.directional(d, "v", "u", "w", 2.0, 20, 20).where("iy = 10 AND ix = 10").first()
    assert (r.forward, r.leftward, r.straddling) == pytest.approx((12.0, 8.0, 0.0))


def test_members_of_a_valid_time(spark):
    h = spark.sql("SELECT timestamp_ntz'2023-05-11 20:00:00' AS t, timestamp_ntz'2023-05-11 18:00:00' AS as_of UNION ALL SELECT timestamp_ntz'2023-05-13 00:00:00', timestamp_ntz'2023-05-11 18:00:00'")
    got = events.recent_runs(h).groupBy("t").agg(F.sort_array(F.collect_list("lag")).alias("l")).orderBy("t").collect()
    assert [r.l for r in got] == [[2, 3, 4, 5, 6, 7], [30, 36, 42, 48]]


def test_nearest_anchor_takes_the_later_of_equals(spark):
    p = spark.createDataFrame([(1, "2024-01-01", 35.0, -97.0), (9, "2024-01-02", 35.0, -97.0)], "event_id long, day string, lat double, lon double")
    a = spark.createDataFrame([(5, "2024-01-01", 35.1, -97.0, 1), (6, "2024-01-01", 34.9, -97.0, 2), (7, "2024-01-01", 36.5, -97.0, 3)], "event_id long, day string, lat double, lon double, seq int")
    a = a.unionByName(a.where("event_id = 5").withColumns({"event_id": F.lit(8).cast("long"), "seq": F.lit(4)}))
    got = events.nearest_anchor(p, a, "event_id").collect()
    assert [(r.event_id, r.anchor_id) for r in got] == [(1, 8)]


def test_window_hours_are_closed(spark):
    t = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-01 10:30:00', timestamp_ntz'2024-01-01 10:29:59', timestamp_ntz'2024-01-01 11:00:00')) AS time")
    got = [r.n for r in t.select(F.size(events.window_hours(F.col("time"))).alias("n")).collect()]
    assert got == [2, 1, 1]


def test_outlook_of_closest_issuance(spark):
    o = spark.sql("SELECT * FROM VALUES ('d1', timestamp_ntz'2024-01-01 06:00:00', timestamp_ntz'2024-01-02 12:00:00'), ('d1', timestamp_ntz'2024-01-01 13:00:00', timestamp_ntz'2024-01-02 12:00:00'), ('d1', timestamp_ntz'2024-01-01 01:00:00', timestamp_ntz'2024-01-01 02:00:00') t(category, issue, expire)")
    got = events.outlook_at(o, F.lit("2024-01-01 20:00:00").cast("timestamp_ntz")).collect()
    assert [r.issue.hour for r in got] == [13]


def test_stamping_stays_on_the_grid(spark):
    lat, lon = spark.range(1).select(*__import__("tesserae.functions.geo", fromlist=["cell_centre"]).cell_centre(F.lit(0), F.lit(0))).first()
    p = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    got = labels.on_cells(p).select("iy", "ix").collect()
    assert len(got) == sum(1 for dy, dx in C.stencil(25.0) if dy >= 0 and dx >= 0)
    fire = labels.fire_labels(p.withColumn("final_size", F.lit(float("nan"))).unionByName(p.withColumn("final_size", F.lit(7.0))), [])
    assert {r["size"] for r in fire.collect()} == {7.0}


def test_tracks_are_told_apart_without_a_shuffle_of_their_cells(spark, tmp_path):
    """Repeated rows, one id in many places and null ids, values and users: as a plain distinct count; only sums of cells are sent on."""
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'")
    odd = [e, e.where("event_id % 3 = 0"), e.withColumn("event_id", F.lit(77).cast("long"))]
    odd += [e.where("event_id % 5 = 1").withColumn(c, F.lit(None).cast(dict(e.dtypes)[c])) for c in ("event_id", "user_id", "value")]
    functools.reduce(DataFrame.unionByName, odd).write.parquet(f"{tmp_path}/events.parquet")
    got = events_plans.track_stamp(spark, str(tmp_path))
    hits = labels.on_cells(labels.track_points(views.tracks(spark, str(tmp_path))))
    want = hits.groupBy("iy", "ix").agg(F.count("*").alias("n"), F.max("ef").alias("ef"), F.countDistinct("event_id").alias("tracks"))
    assert got.count() > 100 and got.dtypes == want.dtypes
    same(got.toPandas(), want.toPandas())
    sent = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", got._jdf.queryExecution().executedPlan().toString())
    keys = {tuple(sorted(re.findall(r"(\w+)#", x))) for x in sent}
    assert keys == {("cx", "cy", "event_id"), ("event_id",), ("ix", "iy")}
    assert events_plans.track_stamp(spark, str(tmp_path)).where("n < tracks").isEmpty()


def test_subsample_is_unbiased_and_bags_are_disjoint(spark):
    rows = spark.range(200_000).withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    s = dataset.subsample(rows, F.col("y") == 1, F.col("id"), 0.1)
    n, w = s.where("y = 0").agg(F.count("*"), F.sum("weight")).first()
    assert s.where("y = 1").count() == 4000 and w == pytest.approx(196_000, rel=0.05) and n < 25_000
    b = dataset.bag(s, F.col("y") == 1, F.col("id"), 3)
    assert b.where("y = 0").groupBy("id").count().where("count > 1").count() == 0 and b.where("y = 1").count() == 12_000


def test_auc_and_contingency_against_pairs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"p": rng.integers(0, 12, 400) / 12, "y": rng.integers(0, 2, 400), "w": 1})
    df = spark.createDataFrame(pdf)
    a, b = pdf.p[pdf.y == 1].to_numpy()[:, None], pdf.p[pdf.y == 0].to_numpy()[None]
    assert verify.exact_auc(df).first()["auc"] == pytest.approx(((a > b) + 0.5 * (a == b)).mean())
    r = verify.contingency(df, [0.5]).first()
    hit = ((pdf.p >= 0.5) & (pdf.y == 1)).sum()
    assert r.pod == pytest.approx(hit / pdf.y.sum()) and r.csi == pytest.approx(hit / ((pdf.p >= 0.5) | (pdf.y == 1)).sum())
    assert len(verify.dense_low_edges()) == 11


def test_category_lookup_and_masks(spark):
    p = spark.createDataFrame([("tor", 1, 1, 0.3, [0.0, 0.0, 1.0, 1.0, 1.0]), ("tor", 1, 1, 0.1, [1.0, 0.0, 0.0, 0.0, 0.0])], "hazard string, iy int, ix int, p double, dist array<double>")
    r = products.day_max(p).first()
    assert (r.cig, r.category) == (3, 5)  # the class comes from one hour, the probability from its own maximum


def lift_one(p0, t0, td0, axis):
    """A parcel by scalars, written out again."""
    e = lambda t: 6.112 * np.exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5))
    w = lambda e_, p: C.EPS * e_ / max(p - e_, 1e-6)
    lcl = p0 * ((56 + 1 / (1 / (td0 - 56) + np.log(t0 / td0) / 800)) / t0) ** (C.CP / C.RD)
    out, t, last = [], None, None
    for p in axis:
        dry = t0 * (p / p0) ** (C.RD / C.CP)
        if t is None or p >= lcl:
            t = dry
        else:
            ws = w(e(t), last)
            t = t + (C.RD * t + C.LV * ws) / last / (C.CP + C.LV**2 * ws * C.EPS / (C.RD * t**2)) * (p - last)
        last = p
        out.append(t * (1 + 0.608 * (w(e(td0), p0) if p >= lcl else w(e(t), p))) if p <= p0 else np.nan)
    return np.array(out)


def test_parcel_against_scalars():
    axis = soundings.pressure_axis(1000.0)
    env = soundings.Environment(axis, np.array([995.0]), np.zeros((1, len(axis))), np.zeros((1, len(axis))), np.zeros(len(axis)))
    got = soundings.rising(env, np.array([995.0]), np.array([303.0]), np.array([296.0]))[0]
    assert np.allclose(got, lift_one(995.0, 303.0, 296.0, axis), equal_nan=True)


def test_physical_anchors(spark):
    levels = np.array([C.FETCH_LEVELS], float)
    z = 44330.8 * (1 - (levels / 1013.25) ** 0.190263)
    t = np.maximum(303 - 0.0072 * z, 208.0)
    f = {"tmp": t, "dpt": t - 1 - 0.002 * z, "ugrd": 3 + 0.004 * z, "vgrd": 0 * z + 5, "hgt": z, "vvel": 0 * z}
    s = {"psfc": np.array([1000.0]), "zsfc": np.array([110.0]), "t2m": np.array([304.0]), "td2m": np.array([298.0]), "u10": np.array([3.0]), "v10": np.array([5.0])}
    got = soundings.column_features(levels, f, s, 1000.0)
    assert got["sbcape"][0] > 500 and got["sbcin"][0] <= 0 and got["mlcape"][0] > 0 and got["dcape"][0] >= 0
    assert got["sbcape_0_90"][0] <= got["sbcape"][0] + 1e-9
    assert got["lapse_1_3km"][0] == pytest.approx(7.2, abs=0.2)
    r, m = np.array([got["motion_bunkers_rm_u"][0], got["motion_bunkers_rm_v"][0]]), np.array([got["motion_mean_0_6km_u"][0], got["motion_mean_0_6km_v"][0]])
    assert np.hypot(*(r - m)) == pytest.approx(7.5, rel=1e-6)
    u, v = soundings.turned(np.array([3.0]), np.array([4.0]), np.array([[3.0], [4.0]]))
    assert (u[0], v[0]) == pytest.approx((5.0, 0.0))


def test_wet_bulb_inverts_theta_e():
    t, p = np.array([285.0, 270.0]), np.array([900.0, 600.0])
    te = soundings.theta_e(t, soundings.saturated(t, p), p)
    assert soundings.wet_bulb(te, p) == pytest.approx(t, abs=1e-9)


def test_feature_catalogue():
    raw = physics.raw_names()
    assert sum(map(len, raw.values())) == 440 and len(physics.catalogue()) == len({*physics.catalogue()}) == 6560
    assert len(physics.fire_catalogue()) == len({*physics.fire_catalogue()}) == 2573


def test_column_features_of_incomplete_rows(spark):
    from tesserae.plans.models import soundings as made

    df = made(spark, "/root/testdata/sf0.001").limit(3).withColumn("t2m", F.when(F.col("vec_id") != 1, F.col("t2m")))
    got = physics.column_features(df, ["vec_id"], "scene").toPandas().set_index("vec_id")
    assert got.loc[1].isna().all() and got.drop(1).notna().all().all()


def test_paged_source(spark, tmp_path):
    for k in range(0, 5, 2):
        (tmp_path / f"page-{k}.json").write_text(json.dumps([{"a": k + i, "b": "x"} for i in range(min(2, 5 - k))]))
    spark.dataSource.register(tables.PagedSource)
    df = spark.read.format("paged").schema("a long, b string").option("path", str(tmp_path / "page-{offset}.json")).option("total", "5").option("page", "2").load()
    assert sorted(r.a for r in df.collect()) == [0, 1, 2, 3, 4]


def test_retry_only_what_passes():
    calls = []

    def fail(message):
        calls.append(message)
        raise OSError(message)

    with pytest.raises(OSError):
        tables.with_retry(lambda: fail("503 busy"), 3, wait=0)
    assert len(calls) == 3
    with pytest.raises(OSError):
        tables.with_retry(lambda: fail("404"), 3, wait=0)
    assert len(calls) == 4


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time,lat,lon,size\n2024-01-01 10:00,35.1,-97.2,1.5\nbad,1,2,3\n2024-01-02 10:00,x,-97,2\n")
    assert [(r.lat, r["size"]) for r in tables.csv_reports(spark, str(tmp_path / "r.csv")).collect()] == [(35.1, 1.5)]
    (tmp_path / "d.json").write_text(json.dumps({"points": [{"lat": 1.0, "lon": 2.0, "mph": 90.0, "ef": 1, "hazard": "tor"}, {"lat": 1.0, "lon": 2.0, "mph": 9.0, "ef": -1, "hazard": None}], "tracks": [{"path": [[1.0, 2.0], [1.1, 2.1]], "maxwind": 100.0, "ef": 2}]}))
    points, tracks = tables.damage_days(spark, str(tmp_path / "d.json"))
    assert points.count() == 1 and tracks.first().path[1].lat == 1.1
    raster = spark.createDataFrame([(y, x, float("nan") if y == x == 0 else 1.0 * (y < 2)) for y in range(10) for x in range(10)], "y int, x int, value double")
    got = {(r.iy, r.ix): r.value for r in tables.grid_rows(raster).collect()}
    assert got[(0, 0)] == pytest.approx(9 / 24) and got[(1, 1)] == 0
    assert tables.class_fractions(raster.withColumn("value", (F.col("x") % 2).cast("int")), {"odd": [1]}, 10).first().odd == 0.5


def test_sinks_resume_and_augment(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01", 1.0), (2, "2024-01-02", 2.0)], "k int, valid_date string, x double")
    path = str(tmp_path / "parts")
    sinks.append_parts(rows, path)
    done = spark.read.parquet(path)
    assert sinks.not_done(spark.createDataFrame([(1,), (3,)], "k int"), done, ["k"]).collect()[0].k == 3
    added = spark.createDataFrame([(1, 5.0)], "k int, y double")
    once = sinks.augmented(rows, added, ["k"])
    same(sinks.augmented(once, added, ["k"]).toPandas(), once.toPandas())
    assert sinks.aligned(rows, ["x", "z"]).columns == ["x", "z"]
    assert json.loads(sinks.contract(rows, ["x"])) == [{"name": "x", "type": "double"}]
    sinks.overwrite(rows.where("k = 2").withColumn("x", F.lit(9.0)), path, "valid_date")
    assert {r.k: r.x for r in spark.read.parquet(path).collect()} == {1: 1.0, 2: 9.0}
    assert {r.flag for r in sinks.relabelled(rows, spark.createDataFrame([(1, 1)], "k int, flag int"), ["k"]).collect()} == {0, 1}


def test_scans(spark):
    r = views.reports(spark, "/root/testdata/sf0.001")
    assert tables.final_days(r, F.lit("1999-01-01").cast("timestamp_ntz")).count() == 0
    t = views.tracks(spark, "/root/testdata/sf0.001").withColumn("ef", F.lit(9))
    assert {x.ef for x in tables.tracks_in_window(t, F.lit("2024-01-15").cast("timestamp_ntz"), 60 * 24 * 30).collect()} == {-1}
    rows = spark.range(1000).select("id", F.lit("train").alias("split"))
    a = tables.capped_split(rows, "train", ["id"], bag=0, bags=3).select("id")
    b = tables.capped_split(rows, "train", ["id"], bag=1, bags=3).select("id")
    assert a.intersect(b).count() == 0 and tables.capped_split(rows, "train", ["id"], cap=10).count() == 10


def test_plans_stay_in_the_engine(spark):
    """Pushed filter, pruned columns, no nested-loop join and no Python where none is needed."""
    from tesserae.plans.catalogue import QUERIES

    plan = lambda n: QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan("dataset_scan") and "o_orderpriority" not in plan("dataset_scan")
    for n in ("label_stamp", "nearest_anchor", "dedup_anti", "active_intervals", "neighborhood_mean", "directional_gradient"):
        p = plan(n)
        assert "NestedLoop" not in p and "Cartesian" not in p and "Python" not in p and "Arrow" not in p, n


def test_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    pdf = pd.DataFrame({"key": range(600), "a": x, "b": rng.normal(size=600), "y": (x + 0.3 * rng.normal(size=600) > 0).astype(int), "split": np.where(np.arange(600) % 3 == 0, "validation", "train"), "weight": 1.0})
    df = spark.createDataFrame(pdf)
    band = models.train_band(df, ["a", "b"], "y", bags=1, maxIter=5, calibrator="logistic")
    out = models.predict({"x": band}, df.where("split = 'validation'"), ["a", "b"])
    assert verify.exact_auc(out).first()["auc"] > 0.9
    with pytest.raises(ValueError):
        models.calibrate(df, "spline")


def test_stream_resume(spark, tmp_path):
    from tesserae.streaming import streams

    write = streams.resume_writer(str(tmp_path / "out"), ["k"])
    batch = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    write(batch, 0)
    write(batch, 1)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_stream_deduplication_and_active_intervals(spark, tmp_path):
    from tesserae.streaming import streams

    t = lambda x: f"timestamp'2024-01-01 {x}:00'"
    spark.sql(f"SELECT * FROM VALUES (1, {t('10:00')}), (1, {t('11:00')}), (2, {t('12:00')}) v(key, ts)").coalesce(1).write.parquet(str(tmp_path / "r"))
    spark.sql(f"SELECT * FROM VALUES (1, {t('09:00')}, {t('10:30')}), (2, {t('13:00')}, {t('14:00')}) v(key, start, end)").coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    table = lambda s, n: streams.drain(s, str(tmp_path / n), str(tmp_path / f"{n}-state"))
    once = table(streams.deduplicated(stream("r"), ["key"]), "once")
    assert sorted(r.key for r in once.collect()) == [1, 2]
    pairs = streams.active(stream("f"), stream("r")).select("r.key", "r.ts")
    assert [(r.key, r.ts.hour) for r in table(pairs, "active").collect()] == [(1, 10)]


def test_resample_and_member_state(spark):
    rows = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 3.0).otherwise(1.0))
    got = dataset.weighted_resample(rows, "w", F.col("id"), 1000)
    heavy = got.where("id < 1000").count()
    assert got.columns == ["id", "w"] and got.count() == pytest.approx(1000, rel=0.1) and heavy == pytest.approx(750, rel=0.1)
    from tesserae.plans import jobs

    raw = spark.createDataFrame([(0, 1, y, x, float(x), float("nan") if x == 4 else float(y)) for y in range(5) for x in range(5)], "run int, fxx int, iy int, ix int, t2m double, refc double")
    r = jobs.member_state(raw, ["t2m", "gone"], ["refc"]).first()
    assert (r.iy, r.ix, r.t2m, r.refc) == (0, 0, 2.0, 4.0)


def test_jobs_end_to_end(spark, tmp_path):
    from tesserae import cli
    from tesserae.plans import jobs
    from tesserae.plans.catalogue import QUERIES

    m = QUERIES["training_matrix"](spark, "/root/testdata/sf0.01").withColumn("key", F.xxhash64("valid", "iy", "ix", "fxx")).fillna(0.0)
    m = m.withColumn("split", F.when(F.col("key") % 3 == 0, "validation").otherwise("train"))
    bands = jobs.train(m, ["v", "iy", "ix"], "flag", pooled=True, maxIter=2, calibrator="logistic")
    p = jobs.predict(bands, m.select("fxx", "iy", "ix", "v").limit(50), ["v", "iy", "ix"], "tor")
    assert p.count() == 50 and p.where("p < 0 OR p > 1").count() == 0
    cached = p.withColumn("fxx", F.lit(6)).limit(3)
    assert jobs.predict(bands, m, ["v"], "tor", cached, [6]).count() == 3
    assert cli.parser().parse_args(["train", "--matrix", "a", "--cells", "b", "--out", "c", "--features", "v"]).fmax == 36


def test_feature_rows_as_the_table_operators(spark):
    from tesserae import constants as C
    from tesserae.operators import features
    from tesserae.plans import models as plans

    from tesserae.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["feature_rows"](spark, sf).where("scene = 0")
    names = ["tmp_d0", "elev_mean50", "sbcape_mean25_right_forward", "mb250_absvort", "diffdiv_250_850", "bnd_def10", "bnd_t2m_gradmag", "sbcape", "elev", "motion_mean_u"]
    catalogue = physics.catalogue()
    names = [n for n in names if n in catalogue]
    own = next(n for n in catalogue if n.startswith("sbcape_mean100_") and n.endswith("_leftward"))
    motion = own.removeprefix("sbcape_mean100_").removesuffix("_leftward")
    got = features.named(rows, [*names, own, "sbcape_mean100", f"motion_{motion}_u", f"motion_{motion}_v"], ["iy", "ix"]).toPandas().astype(float).sort_values(["iy", "ix"])
    assert len(got) == 192 and all(len(r.features) == len(catalogue) for r in rows.limit(3).collect())
    # Means and gradients as the operators on rows make them.
    cells = spark.createDataFrame(got[["iy", "ix", "sbcape", f"motion_{motion}_u", f"motion_{motion}_v"]].astype({"iy": int, "ix": int}))
    want = physics.expanded(cells, "sbcape", {motion: (f"motion_{motion}_u", f"motion_{motion}_v")}, plans.SCENE_NY, plans.SCENE_NX).toPandas().sort_values(["iy", "ix"])
    assert got["sbcape_mean100"].to_numpy() == pytest.approx(want["sbcape_mean100"].to_numpy(), rel=1e-5)
    assert got[own].to_numpy() == pytest.approx(want[own].to_numpy(), rel=1e-3, abs=1e-2 * np.abs(want["sbcape_mean100"]).max() / 100)
    # Boundaries and kinematics by the definition.
    s = plans.soundings(spark, sf).where("vec_id < 192").orderBy("vec_id").toPandas()
    t2m = s.t2m.to_numpy().reshape(12, 16)
    gy, gx = np.gradient(t2m, C.DX)
    assert got["bnd_t2m_gradmag"].to_numpy().reshape(12, 16) == pytest.approx(1e5 * np.hypot(gx, gy), abs=5e-4)  # features are single floats
    assert got["elev"].to_numpy() == pytest.approx(s.zsfc.to_numpy(), rel=1e-6)


def test_only_wanted_cells_leave(spark):
    from tesserae.operators import features
    from tesserae.plans import models as plans

    s = plans.soundings(spark, "/root/testdata/sf0.001").where("vec_id < 64").drop("scene").withColumns({"scene": F.lit("a"), "iy": (F.col("vec_id") / 8).cast("int"), "ix": (F.col("vec_id") % 8).cast("int"), "lat": F.lit(40.0)})
    got = features.scene_features(s, "scene", 8, 8, wanted=F.col("vec_id") % 16 == 3).collect()
    assert sorted((r.iy, r.ix) for r in got) == [(0, 3), (2, 3), (4, 3), (6, 3)]
    assert features.scene_features(s.limit(0), "scene", 8, 8).count() == 0


def test_terrain_of_a_plane(spark):
    from tesserae.operators import features

    got = features.terrain(spark.createDataFrame([(y, x, 3.0 * x + 4.0 * y) for y in range(6) for x in range(7)], "iy int, ix int, elev double"), step=1.0, radius=1.0).toPandas()
    assert set(got.columns) == {"iy", "ix", *physics.TERRAIN}
    assert got.slope.to_numpy() == pytest.approx(5.0) and got.slope_std.to_numpy() == pytest.approx(0.0, abs=1e-6)
    assert got[(got.iy == 2) & (got.ix == 2)].tpi.iloc[0] == pytest.approx(0.0, abs=1e-9)


def test_paged_source_without_a_total(spark, tmp_path):
    for k in (0, 2, 4):
        rows = [{"a": k + i, "b": "x"} for i in range(min(2, 5 - k))]
        (tmp_path / f"page-{k}.json").write_text(json.dumps(rows))
        (tmp_path / f"geo-{k}.json").write_text(json.dumps({"features": [{"properties": r, "geometry": {"x": 1}} for r in rows], "exceededTransferLimit": k < 4}))
    (tmp_path / "page-6.json").write_text("[]")
    spark.dataSource.register(tables.PagedSource)
    read = lambda name, **kw: spark.read.format("paged").schema("a long, b string, geometry string").options(path=str(tmp_path / f"{name}-{{offset}}.json"), page="2", **kw).load()
    assert sorted(r.a for r in read("page").collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.a for r in read("page", lanes="2").collect()) == [0, 1, 2, 3, 4]
    geo = read("geo").collect()
    assert sorted(r.a for r in geo) == [0, 1, 2, 3, 4] and json.loads(geo[0].geometry) == {"x": 1}
    for broken in ("[", None, '{"error": "busy"}', json.dumps([{"a": 1}] * 3)):
        (tmp_path / "page-2.json").unlink(missing_ok=True)
        if broken is not None:
            (tmp_path / "page-2.json").write_text(broken)
        with pytest.raises(Exception, match="page-2|Expecting value|No such file|busy"):
            read("page").collect()


def test_overwrite_of_what_is_read(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, d string, x double").write.partitionBy("d").parquet(path)
    sinks.overwrite(sinks.augmented(spark.read.parquet(path), spark.createDataFrame([(1, 5.0)], "k int, y double"), ["k"]), path)
    assert sorted((r.k, r.y) for r in spark.read.parquet(path).collect()) == [(1, 5.0), (2, None)]
    sinks.overwrite(spark.read.parquet(path).where("k = 1").withColumn("x", F.lit(9.0)), path)
    assert [(r.k, r.x) for r in spark.read.parquet(path).collect()] == [(1, 9.0)]
    # A run that died between the renames: the old rows come back.
    (tmp_path / "m").rename(tmp_path / "m.old")
    sinks.overwrite(spark.createDataFrame([(7, "b", 0.0, 0.0)], "k int, d string, x double, y double"), path)
    assert [r.k for r in spark.read.parquet(path).collect()] == [7] and not (tmp_path / "m.old").exists()


def test_commands_from_build_to_predict(spark, tmp_path):
    from tesserae import cli

    at = lambda n: str(tmp_path / n)
    r = views.reports(spark, "/root/testdata/sf0.01")
    r.write.parquet(at("reports"))
    grid_cells = views.grid(spark, "/root/testdata/sf0.01").select("iy", "ix", F.round("v", 6).alias("v")).na.fill(0.0)
    hours = r.select(F.date_trunc("HOUR", "time").cast("timestamp_ntz").alias("valid")).groupBy("valid").count().where("count >= 12").select("valid").where("weekday(valid) IN (0, 5, 6)")
    hours.crossJoin(grid_cells).write.parquet(at("features"))
    i = F.col("event_id")
    from tesserae.plans import jobs

    jobs.label_flags(r, ((i % 24).cast("int"), (i * 7 % 32).cast("int"))).write.parquet(at("labels"))
    cli.main(["build-data", "--reports", at("reports"), "--features", at("features"), "--labels", at("labels"), "--out", at("matrix"), "--bands", "6", "--min-reports", "12", "--neg-keep", "0.05", "--temporal", "v"])
    m = spark.read.parquet(at("matrix"))
    n = m.count()
    assert {"key", "v_before", "v_after", "split"} <= set(m.columns) and {x.split for x in m.select("split").distinct().collect()} >= {"train", "validation"}
    m.select("valid", "iy", "ix").distinct().withColumn("extra", F.col("iy") * 1.0).write.parquet(at("extra"))
    cli.main(["augment-data", "--matrix", at("matrix"), "--columns", at("extra")])
    assert spark.read.parquet(at("matrix")).where("extra = iy").count() == n
    cli.main(["augment-labels", "--matrix", at("matrix"), "--labels", at("labels")])
    # Two hazards into one store, then their products, nothing touched between.
    with_bins = spark.read.parquet(at("matrix")).withColumns({"bin": (F.col("iy") % 3).cast("int"), "pib": (F.col("ix") % 7 - 1).cast("int")})
    with_bins.write.parquet(at("binned"))
    common = ["--matrix", at("binned"), "--features", "v,extra", "--pooled", "--trees", "2", "--cap", "4000", "--val-cap", "4000", "--dist", "bin", "--leaves", "4"]
    cli.main(["train", *common, "--hazard", "tor", "--models", at("models"), "--depth", "2", "--pib", "pib"])
    cli.main(["train", *common, "--hazard", "hail", "--models", at("models-hail"), "--learner", "leafwise", "--l2", "3"])
    assert {x.name for x in spark.read.parquet(at("models/metrics")).collect()} == {"rows", "auc", "ap"}
    n = grid_cells.count()
    cells = grid_cells.withColumns({"run": F.to_timestamp(F.lit("2024-01-06 12:00:00")), "extra": F.col("iy") * 1.0}).withColumn("fxx", F.explode(F.array(F.lit(6), F.lit(7))))
    cells.write.parquet(at("cells"))
    cells.where("fxx = 7").withColumn("fxx", F.lit(8)).write.parquet(at("later"))
    cells.where("fxx = 7").withColumn("run", F.col("run") + F.expr("INTERVAL 6 HOURS")).write.parquet(at("next"))
    read = lambda: {(r.hazard, r.run.hour, r.fxx): r["count"] for r in spark.read.parquet(at("p")).groupBy("hazard", "run", "fxx").count().collect()}
    cli.main(["predict", "--models", at("models"), "--cells", at("cells"), "--out", at("p")])
    cli.main(["predict", "--models", at("models-hail"), "--cells", at("cells"), "--out", at("p")])
    want = {(h, 12, f): n for h in ("tor", "hail") for f in (6, 7)}
    assert read() == want
    before = {f.name for f in (tmp_path / "p").rglob("*.parquet")}
    cli.main(["predict", "--models", at("models"), "--cells", at("cells"), "--out", at("p")])  # all there: nothing is written
    assert {f.name for f in (tmp_path / "p").rglob("*.parquet")} == before
    cli.main(["predict", "--models", at("models"), "--cells", at("later"), "--out", at("p")])  # fewer hours lose no others
    cli.main(["predict", "--models", at("models"), "--cells", at("next"), "--out", at("p"), "--no-cache"])
    want |= {("tor", 12, 8): n, ("tor", 18, 7): n}
    assert read() == want
    p = spark.read.parquet(at("p"))
    assert p.where("p IS NULL OR p < 0 OR p > 1").count() == 0
    sizes = {r.hazard: (r.d, r.b, r.s) for r in p.groupBy("hazard").agg(F.max(F.size("dist")).alias("d"), F.max(F.size("pib")).alias("b"), F.min(F.aggregate("dist", F.lit(0.0), lambda s, v: s + v)).alias("s")).collect()}
    assert sizes["tor"][:2] == (5, 7) and sizes["hail"][:2] == (4, 7) and all(s == pytest.approx(1) for *_, s in sizes.values())
    cli.main(["products", "--predictions", at("p"), "--out", at("products")])
    assert spark.read.parquet(at("products/combined")).count() == 2 * n and "modal_bin" in spark.read.parquet(at("products/hourly")).columns
    assert spark.read.parquet(at("products/hourly")).count() == 6 * n and spark.read.parquet(at("products/day")).count() == 3 * n


def test_hindcast_and_fire_matrices(spark):
    from tesserae.plans import jobs

    hour = "TIMESTAMP_NTZ '2024-01-06 10:00:00'"
    cells = spark.range(20).select(F.expr(hour).alias("valid"), (F.col("id") / 5).cast("int").alias("iy"), (F.col("id") % 5).cast("int").alias("ix"), F.lit(1.0).alias("v"))
    labels = spark.createDataFrame([(1, 2, 1)], "iy int, ix int, flag int").withColumn("valid", F.expr(hour))
    got = jobs.build_hindcast(cells.select("valid"), cells, labels, ["flag"], 1.0).toPandas()
    assert len(got) == 20 and got.flag.sum() == 1 and "fxx" not in got and set(got.split) == {"validation"}
    runs = cells.select((F.col("valid") - F.expr("INTERVAL 3 HOURS")).alias("run")).distinct()
    state = cells.drop("valid").crossJoin(runs).withColumn("fxx", F.explode(F.sequence(F.lit(1), F.lit(4))))
    fires = spark.sql("SELECT 'a' AS irwin, TIMESTAMP_NTZ '2024-01-05 09:30:00' AS start, TIMESTAMP_NTZ '2024-01-06 09:30:00' AS end, 3 AS iy, 4 AS ix")
    got = jobs.build_fire_matrix(runs, state, fires, 1.0, [1, 2, 3, 4]).toPandas()
    assert set(got.fxx) == {1, 2} and got.flag.sum() == 2 and len(got) == 40


def test_static_fields_that_lack(spark, caplog):
    from tesserae.plans import jobs

    rows = spark.createDataFrame([(0, 0), (0, 1)], "iy int, ix int")
    static = spark.createDataFrame([(0, 0, 7.0)], "iy int, ix int, elev double")
    assert sorted(r.elev for r in jobs.with_static(rows, static, ["elev", "popdens"], 0.0).collect()) == [0.0, 7.0]
    assert "popdens" in caplog.text and jobs.with_static(rows, None, ["elev"]).first().elev is None


def test_reports_merge_and_order(spark):
    a = spark.createDataFrame([("t2", 1.0, 2.0, "hail", 5.0), ("t1", 1.0, 2.0, "wind", -999.0)], "time string, lat double, lon double, hazard string, magnitude double")
    b = spark.createDataFrame([("t2", 1.0, 2.0, "hail", 9.0), ("t0", 1.0, 2.0, "hail", 1.0)], a.schema)
    got = events.in_time_order(events.merged(a, b, unknown_wind=-999.0)).collect()
    assert [(r.time, r.magnitude) for r in got] == [("t0", 1.0), ("t1", None), ("t2", 5.0)]


def test_caps_take_the_first_by_hash(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 4 == 0, "validation").otherwise("train").alias("split"))
    got = tables.capped_splits(rows, ["id"], {"train": 1234, "validation": 99_999}, seed=3)
    train = {r.id for r in got.where("split = 'train'").collect()}
    first = {r.id for r in rows.where("split = 'train'").orderBy(F.xxhash64(F.lit(3), "id")).limit(1234).collect()}
    assert train == first and got.where("split = 'validation'").count() == 1250


def test_auc_with_ties_weights_and_keys(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 4000), "p": np.round(rng.random(4000), 2), "w": rng.integers(1, 4, 4000).astype(float)})
    pdf["y"] = (rng.random(4000) < pdf.p).astype(int)
    got = {r.k: r for r in verify.exact_auc(spark.createDataFrame(pdf), "p", "y", "w", ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        a, b = part[part.y == 1], part[part.y == 0]
        better = (a.p.to_numpy()[:, None] > b.p.to_numpy()) + 0.5 * (a.p.to_numpy()[:, None] == b.p.to_numpy())
        assert got[k].auc == pytest.approx((better * a.w.to_numpy()[:, None] * b.w.to_numpy()).sum() / (a.w.sum() * b.w.sum()))
