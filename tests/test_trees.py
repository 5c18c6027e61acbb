"""Trees grown best leaf first against an exhaustive search on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesserae.operators import trees


def plain_boost(x, y, w, classes, rounds, leaves, rate, l2, least_rows, edges):
    """One split at a time, every cut of every feature tried on every leaf."""
    n, out = len(x), []
    share = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
    m = np.tile(np.log(share), (n, 1))
    for _ in range(rounds):
        e = np.exp(m)
        p = e / e.sum(1, keepdims=True)
        step = np.zeros_like(m)
        shapes = []
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            parts, cuts = [np.ones(n, bool)], []
            while len(parts) < leaves:
                best = None
                for i, rows in enumerate(parts):
                    for f in range(x.shape[1]):
                        for c in edges[f]:
                            left = rows & ~(x[:, f] > c)
                            right = rows & (x[:, f] > c)
                            if min(left.sum(), right.sum()) < least_rows:
                                continue
                            gain = sum(g[r].sum() ** 2 / (h[r].sum() + l2) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, i, f, c, left, right)
                if best is None:
                    break
                _, i, f, c, left, right = best
                parts[i : i + 1] = [left, right]
                cuts.append((f, c))
            for rows in parts:
                step[rows, k] = -rate * g[rows].sum() / (h[rows].sum() + l2)
            shapes.append(sorted(cuts))
        m = m + step
        out.append(shapes)
    e = np.exp(m)
    return out, e / e.sum(1, keepdims=True)


def cuts_of(model, t):
    return sorted((t.feature[n], model.edges[t.feature[n]][t.cut[n] - 1] if t.cut[n] else -np.inf) for n in range(len(t.left)) if t.left[n] >= 0)


@pytest.mark.parametrize(("seed", "leaves"), [(1, 2), (2, 6), (3, 12)])
def test_splits_equal_exhaustive_search(spark, seed, leaves):
    rng = np.random.default_rng(seed)
    n = 240
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(1), rng.integers(0, 3, n)]).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 0.3) + x[:, 2] + rng.integers(0, 3, n)).astype(int) % 3
    w = rng.uniform(0.5, 3, n).round(3)
    x[rng.random(n) < 0.05, 1] = np.nan
    df = spark.createDataFrame([(*map(float, r), int(k), float(v)) for r, k, v in zip(x, y, w, strict=True)], "y double, u double, bins double, label int, v double").repartition(3)
    s = {"rounds": 3, "leaves": leaves, "rate": 0.3, "l2": 2.0, "least_rows": 5}
    model = trees.fit(df, ["y", "u", "bins"], "label", 3, "v", bins=255, **s)
    # Missing goes left in both: a cut below all values has missing ones alone on the left.
    edges = [[-np.inf, *e] if f == 1 else e for f, e in enumerate(model.edges)]
    assert [len(e) for e in model.edges] == [len(np.unique(c[~np.isnan(c)])) - 1 for c in x.T]
    want, p = plain_boost(np.nan_to_num(x, nan=-np.inf), y, w, 3, edges=edges, **s)
    assert [[cuts_of(model, t) for t in trees_] for trees_ in model.rounds] == want
    got = {(r.y, r.u, r.bins, r.label, r.v): r.dist for r in model.scored(df).collect()}
    assert np.allclose([v for v in model.shares_of(x)], p, atol=1e-9)
    assert len(got) and all(abs(sum(v) - 1) < 1e-9 for v in got.values())


def test_model_is_kept_and_margins_are_written(spark, tmp_path, monkeypatch):
    df = spark.range(600).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).alias("b"), F.when(F.col("id") % 37 > 18, 2).when(F.col("id") % 11 > 7, 4).otherwise(1).alias("k"), F.lit("x").alias("margin"))
    s = {"rounds": 5, "leaves": 4, "least_rows": 10}
    model = trees.fit(df, ["a", "b"], "k", 6, **s)
    assert model.seen == [1, 2, 4] and all(len(t.left) <= 7 for ts in model.rounds for t in ts)
    monkeypatch.setattr(trees, "UNWRITTEN", 2)
    again = trees.fit(df, ["a", "b"], "k", 6, **s)
    x = np.array([[0.0, 0.0], [30.0, 0.0], [3.0, 9.0], [np.nan, 9.0]])
    assert np.allclose(model.shares_of(x), again.shares_of(x))
    assert model.shares_of(x).argmax(1).tolist()[:3] == [1, 2, 4] and (model.shares_of(x)[:, [0, 3, 5]] == 0).all()
    model.save(str(tmp_path / "m"))
    assert np.array_equal(trees.Boosted.load(str(tmp_path / "m")).shares_of(x), model.shares_of(x))
    sampled = trees.fit(df, ["a", "b"], "k", 6, row_share=0.7, feature_share=0.5, **s)
    assert sampled.shares_of(x).argmax(1).tolist()[:2] == [1, 2]


def test_logistic_and_odd_inputs(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("a"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).alias("b"), (F.col("id") % 20 > 12).cast("int").alias("y"))
    m = trees.fit(df, ["a", "b"], "y", 1, rounds=8, leaves=3, rate=0.5)
    p = m.scored(df, "p").groupBy("y").agg(F.min("p").alias("a"), F.max("p").alias("b")).orderBy("y").collect()
    assert p[0].b < 0.2 and p[1].a > 0.8
    none = trees.fit(df.limit(0), ["a", "b"], "y", 3, rounds=2)
    assert none.rounds == [] and [r.dist for r in none.scored(df.limit(3)).collect()] == [[0.0] * 3] * 3
    one = trees.fit(df.where("y = 1"), ["a"], "y", 2, rounds=2)
    assert one.shares_of(np.array([[1.0]])).tolist() == [[0.0, 1.0]]
    with pytest.raises(TypeError):
        trees.fit(df, ["a"], "y", 2, depth=3)
