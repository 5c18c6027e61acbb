"""Decoded fields as columns and state, rasters by area, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesserae.operators import reproject
from tesserae.sources import fields

SHAPE = "run int, fxx int, field string, level double, y int, x int, value double"
LEVELS = [1000.0, 925.0, 850.0, 500.0]


def scene(rng, run, ny=4, nx=6, drop=None):
    cubes = {f: rng.normal(size=(len(LEVELS), ny, nx)) for f in fields.ISOBARIC}
    rows = [(run, 1, f, lv, y, x, float(c[k, y, x])) for f, c in cubes.items() for k, lv in enumerate(LEVELS) for y in range(ny) for x in range(nx) if not (drop and drop(f, lv, y, x))]
    return cubes, rows


def test_columns_of_levels_and_damaged_scenes(spark):
    rng = np.random.default_rng(1)
    cubes, rows = scene(rng, 1)
    cubes["tmp"][2, 1, 3] = np.nan
    rows = [(*r[:6], float(cubes[r[2]][LEVELS.index(r[3]), r[4], r[5]])) for r in rows]
    ragged, short, gone = (scene(rng, k, drop=d)[1] for k, d in ((2, lambda f, lv, y, x: f == "dpt" and lv == 500), (3, lambda f, lv, y, x: f == "hgt" and lv == 850 and y == 3), (4, lambda f, lv, y, x: f == "vvel")))
    df = spark.createDataFrame([*rows, *ragged, *short, *gone, (1, 1, "t2m", None, 0, 0, 5.0)], SHAPE).repartition(5)
    cols, bad = fields.columns_of_levels(df, 24)
    assert sorted(map(tuple, bad.collect())) == [(2, 1, "dpt", 3, 24), (3, 1, "hgt", 4, 18), (4, 1, "vvel", 0, 0)]
    got = cols.collect()
    assert len(got) == 24 and all(r.run == 1 and r.level == LEVELS for r in got)
    for r in got:
        for f, c in cubes.items():
            want = [None if np.isnan(v) else v for v in c[:, r.iy, r.ix]]
            assert getattr(r, f) == want
    # Regridding first: the mean of a block, level by level, missing values left out.
    blocks = {(r.iy, r.ix): r.tmp for r in fields.columns_of_levels(df, 24, fields.block_mean(2))[0].collect()}
    want = np.nanmean(cubes["tmp"].reshape(4, 2, 2, 3, 2), axis=(2, 4))
    assert len(blocks) == 6 and all(np.allclose(v, want[:, y, x]) for (y, x), v in blocks.items())


@pytest.mark.parametrize("n", [9, 10])
def test_surface_units_and_required_fields(spark, n):
    rng = np.random.default_rng(n)
    rows, want = [], {}
    for run in range(8):
        p = rng.uniform(900, 1030, n) * (100 if run % 2 else 1)
        if run == 4:  # as many on either side: the middle decides
            p = np.where(np.arange(n) % 2, 1500.0, 2600.0)
        if run == 5:
            p = np.where(np.arange(n) % 2, 1300.0, 2600.0)
        want[run] = p / 100 if np.median(p) > 2000 else p
        for f in fields.REQUIRED:
            rows += [(run, 0, f, None, 0, x, float(p[x]) if f == "psfc" else float(x)) for x in range(n) if not (run == 6 and f == "u10") and not (run == 7 and f == "t2m" and x == 2)]
        rows += [(run, 0, "refc", None, 0, x, 1.0) for x in range(n)] if run == 0 else []
    df = spark.createDataFrame(rows, SHAPE)
    state, bad = fields.surface(df, n, [*fields.REQUIRED, "refc"])
    assert sorted(map(tuple, bad.collect())) == [(6, 0, "u10", 0), (7, 0, "t2m", n - 1)]
    got = state.toPandas()
    assert sorted(got.run.unique()) == [0, 1, 2, 3, 4, 5] and got[got.run == 0].refc.eq(1).all() and got[got.run == 1].refc.isna().all()
    for run, part in got.groupby("run"):
        assert np.allclose(part.sort_values("ix").psfc.to_numpy(), want[run])
    assert fields.probability_fields(df).where("run = 0").agg(F.sum("refc")).first()[0] == n
    assert fields.one_field(df, "refc").count() == n


def plain_pieces(quad, cells):
    """Areas of a convex polygon in cells, by clipping point lists."""
    def clip(poly, axis, bound, above):
        out = []
        for p, q in zip(poly, [*poly[1:], poly[0]], strict=True) if poly else []:
            a, b = (p[axis] >= bound, q[axis] >= bound) if above else (p[axis] <= bound, q[axis] <= bound)
            if a:
                out.append(p)
            if a != b:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(bound if k == axis else p[k] + t * (q[k] - p[k]) for k in (0, 1)))
        return out

    got = {}
    for iy, ix in cells:
        poly = quad
        for axis, bound, above in ((0, ix, True), (0, ix + 1, False), (1, iy, True), (1, iy + 1, False)):
            poly = clip(poly, axis, bound, above)
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, [*poly[1:], poly[0]], strict=True))) / 2 if len(poly) > 2 else 0.0
        if area > 1e-14:
            got[iy, ix] = area
    return got


@pytest.mark.parametrize(("angle", "scale"), [(0.0, 0.37), (0.3, 0.61), (0.9, 1.7)])
def test_area_weights_on_rotated_grids(spark, angle, scale):
    rng = np.random.default_rng(3)
    ny, nx = 7, 9
    v = rng.normal(size=(ny, nx)) + 5
    v[2, 3] = np.nan
    c, s = float(np.cos(angle) * scale), float(np.sin(angle) * scale)
    place = lambda x, y: (c * x - s * y + 0.23, s * x + c * y - 1.4)
    df = spark.createDataFrame([(y, x, float(v[y, x])) for y in range(ny) for x in range(nx)], "y int, x int, value double").repartition(3)
    got = {(r.iy, r.ix): (r.value, r.mass, r.area) for r in reproject.by_area(reproject.pieces(df, place)).collect()}
    cells = [(iy, ix) for iy in range(-20, 30) for ix in range(-20, 30)]
    mass, area = {}, {}
    for y in range(ny):
        for x in range(nx):
            if not np.isnan(v[y, x]):
                quad = [place(x + dx, y + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]
                for k, a in plain_pieces(quad, cells).items():
                    mass[k], area[k] = mass.get(k, 0) + a * v[y, x], area.get(k, 0) + a
    assert set(got) == set(area)
    for k in area:
        assert np.allclose(got[k], (mass[k] / area[k], mass[k], area[k]), rtol=1e-9, atol=1e-12)
    # Nothing is lost: the mass of all cells is that of all pixels.
    assert sum(m for _, m, _ in got.values()) == pytest.approx(np.nansum(v) * scale**2, rel=1e-9)
    shares = reproject.class_shares(reproject.pieces(df.withColumn("value", (F.col("x") % 3).cast("double")), place), {"a": [0, 1], "b": [2]}).collect()
    assert all(r.a + r.b == pytest.approx(1) for r in shares)


def test_overlapping_tiles_and_fallback(spark):
    tiles = spark.createDataFrame([("a", 0, 0, 2.0, 1.0), ("b", 0, 0, 4.0, 1.0), ("a", 0, 1, 6.0, 1.0), ("b", 0, 1, 99.0, 0.01)], "tile string, iy int, ix int, value double, area double")
    cells = spark.range(4).select(F.lit(0).alias("iy"), F.col("id").cast("int").alias("ix"))
    low = spark.createDataFrame([(0, 0, -1.0), (0, 2, 7.0), (0, 3, float("nan"))], "iy int, ix int, value double")
    got = {r.ix: (r.value, r.tiles) for r in reproject.mosaic(tiles, cells, fallback=low, least_share=0.1).collect()}
    assert got == {0: (3.0, 2), 1: (6.0, 1), 2: (7.0, 0), 3: (0.0, 0)}
    assert [r.v for r in spark.createDataFrame([(0.0,), (-5.0,), (float("nan"),), (None,), (9.0,)], "d double").select(reproject.log_population(F.col("d")).alias("v")).collect()] == [0, 0, 0, 0, pytest.approx(np.log(10))]
