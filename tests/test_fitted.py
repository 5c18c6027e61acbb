"""The queries that SQL cannot express, against plain numpy on whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesserae import constants as C
from tesserae.operators import models
from tesserae.plans import models as plans
from tesserae.plans.catalogue import QUERIES
from tesserae.plans.outlooks import EDGES
from tesserae.sources import views

from .conftest import SF


@pytest.fixture(scope="module")
def scores(spark):
    return views.scores(spark, SF).withColumn("hash", F.xxhash64("doc_id")).toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = plans.training_rows(spark, SF)
    return rows, models.gbt(rows.where("split = 'train'"), plans.FEATURES, "y", "weight", maxIter=3)


def pooled(x, y, w):
    """Weighted means of the least non-decreasing steps over distinct x, by pooling neighbours that fall."""
    places, own = np.unique(x, return_inverse=True)
    weight, total = np.bincount(own, w), np.bincount(own, w * y)
    blocks = []
    for k in range(len(places)):
        blocks.append([total[k], weight[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, u, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + u, blocks[-1][2] + n]
    return np.concatenate([[t / u] * n for t, u, n in blocks])[own]


def test_calibrations(spark, scores):
    got = QUERIES["calibrate_isotonic"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    p, y, w = (scores[c].to_numpy(float) for c in ("p", "y", "w"))
    assert np.allclose(got["isotonic"], pooled(p, y, w), atol=2e-6)
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.column_stack([np.log(q / (1 - q)), np.ones(len(q))])
    line = np.zeros(2)
    for _ in range(50):  # Newton steps of the weighted likelihood
        s = 1 / (1 + np.exp(-x @ line))
        line += np.linalg.solve(x.T @ (x * (w * s * (1 - s))[:, None]), x.T @ (w * (y - s)))
    assert np.allclose(got["logistic"], 1 / (1 + np.exp(-x @ line)), atol=1e-3)


def test_bootstrap_bands(spark, scores):
    got = QUERIES["reliability_bootstrap"](spark, SF).toPandas().set_index("bin")
    p, y, w = (scores[c].to_numpy(float) for c in ("p", "y", "w"))
    own = np.clip(np.searchsorted(EDGES, p, side="right") - 1, 0, len(EDGES) - 2)
    draws = np.stack([np.random.default_rng([0, int(k) & 0x7FFFFFFF]).poisson(1.0, 300) for k in scores["hash"]]) * w[:, None]
    kept = [b for b in np.unique(own) if y[own == b].sum() >= 1]
    assert sorted(got.index) == kept
    for b in kept:
        at = own == b
        total = draws[at].sum(0)
        rate = (draws[at] * y[at][:, None]).sum(0)[total > 0] / total[total > 0]
        want = [np.average(p[at], weights=w[at]), np.average(y[at], weights=w[at]), *np.percentile(rate, [5, 95])]
        assert np.allclose(got.loc[b, ["mean_p", "mean_y", "low", "high"]].to_numpy(float), want, atol=1e-9), b


def test_importance_of_shuffled_columns(fitted):
    rows, model = fitted
    held = rows.where("split <> 'train'").select("key", *plans.FEATURES, "y")

    def area(df):
        s = models.scored(model, df, plans.FEATURES).select("p", "y").toPandas()
        good, bad = s.p[s.y == 1].to_numpy()[:, None], s.p[s.y == 0].to_numpy()[None]
        return (good > bad).mean() + (good == bad).mean() / 2

    plain = held.toPandas().set_index("key").sort_index()
    drops, base = {}, area(held)
    for i, f in enumerate(plans.FEATURES):
        mixed = models.shuffled(held, f, "key", 5 + 10 * i)
        moved = mixed.toPandas().set_index("key").sort_index()
        assert moved.drop(columns=f).equals(plain.drop(columns=f)[moved.drop(columns=f).columns])
        assert sorted(moved[f]) == sorted(plain[f])
        drops[f] = base - area(mixed)
    got = models.permutation_importance(model, held, plans.FEATURES, "y", "key").collect()
    assert {r.feature for r in got} == set(drops) and all(abs(r["drop"] - drops[r.feature]) < 1e-9 for r in got)
    assert [r["drop"] for r in got] == sorted((r["drop"] for r in got), reverse=True)


def test_partial_dependence_by_value(fitted):
    rows, model = fitted
    held = rows.where("split = 'test'")
    got = models.partial_dependence(model, held, plans.FEATURES, "upper", points=3).collect()
    assert len(got) == len({r.value for r in got}) > 0
    for r in got:
        each = models.scored(model, held.withColumn("upper", F.lit(r.value)), plans.FEATURES).toPandas()
        assert abs(r.p - each["p"].mean()) < 1e-9


def test_band_is_the_calibrated_mean_of_its_bags(fitted):
    rows, _ = fitted
    band = models.train_band(rows, plans.FEATURES, "y", bags=2, maxIter=2)
    test, check = rows.where("split = 'test'"), rows.where("split = 'validation'")
    bags = lambda df: np.mean([models.scored(m, df, plans.FEATURES).orderBy("key").toPandas()["p"] for m in band.bags], axis=0)
    known = check.orderBy("key").toPandas()
    raw = bags(check)
    steps = pooled(raw, known["y"].to_numpy(float), known["weight"].to_numpy(float))
    order = np.argsort(raw, kind="stable")
    want = np.interp(bags(test), raw[order], steps[order])
    got = models.predict({"all": band}, test, plans.FEATURES).orderBy("key").toPandas()["p"]
    assert np.allclose(got, want, atol=1e-6)


def test_classes_by_softmax(fitted):
    rows, _ = fitted
    known = rows.withColumn("bin", (F.col("lines") % 3).cast("int")).withColumn("flag", F.lit(1))
    m = models.multiclass(known.where("split = 'train'"), plans.FEATURES, "bin", 4, rounds=6, leaves=8, least_rows=4)
    own = known.where("split = 'train'").toPandas()
    got = m.shares_of(own[plans.FEATURES].to_numpy(float))
    assert np.allclose(got.sum(1), 1) and (got[:, 3] == 0).all()
    # Likelier than by the classes' shares alone, on the rows it was fitted on.
    base = np.log(np.bincount(own["bin"], minlength=3)[own["bin"]] / len(own)).mean()
    assert np.log(got[np.arange(len(own)), own["bin"]]).mean() > base + 0.05
    assert models.multiclass(known.where("bin = 1"), plans.FEATURES, "bin", 4, rounds=2) is None
    assert models.conditional({}, known.select("key"), "dist", 4).first().dist == [0.0] * 4


def disc_mean(f, radius):
    ny, nx = f.shape
    out = np.full(f.shape, np.nan)
    for iy in range(ny):
        for ix in range(nx):
            y, x = np.ogrid[:ny, :nx]
            near = f[(y - iy) ** 2 + (x - ix) ** 2 <= radius * radius]
            if np.isfinite(near).any():
                out[iy, ix] = np.nanmean(near)
    return out


def sample(f, y, x):
    """Bilinear, with the edge's values beyond the edge; a corner that is missing makes the sample missing."""
    y, x = np.clip(y, 0, f.shape[0] - 1), np.clip(x, 0, f.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, f.shape[0] - 1), np.minimum(x0 + 1, f.shape[1] - 1)
    low, high = ((1 - (x - x0)) * f[r, x0] + (x - x0) * f[r, x1] for r in (y0, y1))
    return (1 - (y - y0)) * low + (y - y0) * high


def test_expansion_of_a_field(spark):
    grid = views.grid(spark, SF).toPandas()
    dense = {c: np.full((views.NY, views.NX), np.nan) for c in ("v", "u2", "v2")}
    for c, a in dense.items():
        a[grid["iy"], grid["ix"]] = grid[c]
    got = QUERIES["spatial_expansion"](spark, SF).toPandas()
    assert len(got) == views.NY * views.NX and np.isnan(dense["u2"]).any()
    iy, ix = got["iy"].to_numpy(), got["ix"].to_numpy()
    u, v = dense["u2"][iy, ix], dense["v2"][iy, ix]
    length = np.maximum(np.hypot(u, v), 1e-3)
    u, v = u / length, v / length
    for miles in C.RADII_MI:
        r, name = C.cells(miles), f"v_mean{miles:g}"
        mean = disc_mean(dense["v"], r)
        assert np.allclose(got[name].to_numpy(float), mean[iy, ix], equal_nan=True), name
        moves = np.isfinite(u)
        y, x, du, dv = (k[moves] for k in (iy, ix, u, v))
        ahead, behind, left, right = (sample(mean, y + r * dy, x + r * dx) for dy, dx in ((dv, du), (-dv, -du), (du, -dv), (-du, dv)))
        for kind, value in (("forward", ahead - behind), ("leftward", left - right), ("straddling", ahead + behind - left - right)):
            want = np.full(len(got), np.nan)
            want[moves] = value
            assert np.allclose(got[f"{name}_own_{kind}"].to_numpy(float), want, equal_nan=True, atol=1e-6), (name, kind)
