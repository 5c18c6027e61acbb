"""Boosted trees grown best leaf first, with second-order steps and L2: softmax over classes, or one logistic class.

A round grows a tree for each class. Rows stay where they are: tasks sum the gradients of their rows by (node, feature, bin), Spark adds
these sums up and finds the best cut of each node, and only a row for each node comes to the driver. What a task holds depends on
nodes, features and bins, not on rows. To grow best leaf first without a job for each split, a job also sums up the nodes below the leaves that
may be split next; the trees are those that one split at a time would give.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sinks

#: Rounds, leaves of a tree, step, L2 of leaf values, bins of a feature, rows of a leaf and its second derivatives at least, share of the rows and of the features of a round.
SETTINGS = {"rounds": 40, "leaves": 31, "rate": 0.1, "l2": 1.0, "bins": 64, "least_rows": 20, "least_weight": 1e-3, "row_share": 1.0, "feature_share": 1.0, "seed": 7}
#: Numbers of a block of rows x features that a task works on at once.
BLOCK = 1 << 21
#: Rounds whose trees are applied anew in each job, before the margins are written.
UNWRITTEN = 8
#: Features whose quantiles one job finds.
AT_ONCE = 200


@dataclass
class Tree:
    """Nodes as lists: rows whose bin of the feature is at most the cut go left; leaves have left -1."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.left)
        self.right[node] = self.left[node] + 1
        for _ in range(2):
            for x, v in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                x.append(v)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows, features)."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := left[at] >= 0).any():
            at = np.where(inner, np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at]), at)
        return at


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bins (uint8) of values (rows, features): 0 where a value is missing, else 1 and up, by the edges that it is above."""
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        v = x[:, f]
        out[:, f] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(e), v, "left"))
    return out


def shares(margins: np.ndarray) -> np.ndarray:
    """Softmax of each row; of one column, the logistic function."""
    if margins.shape[1] == 1:
        return 1 / (1 + np.exp(-margins))
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Boosted:
    """A fitted model: features, their edges, the classes that were seen (of so many), the start and the trees by round and class."""

    features: list[str]
    edges: list[list[float]]
    classes: int
    seen: list[int]
    start: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from round first on add up to."""
        out = np.zeros((len(bins), len(self.start)))
        for trees in self.rounds[first:]:
            for k, t in enumerate(trees):
                out[:, k] += np.array(t.value)[t.nodes(bins)]
        return out

    def shares_of(self, x: np.ndarray) -> np.ndarray:
        """A share for each of classes (those not seen: 0); of a logistic model one column, the probability."""
        m = np.array(self.start) + self.margins(binned(x, self.edges))
        if self.classes == 1:
            return shares(m)
        out = np.zeros((len(x), self.classes))
        if len(self.seen) == 1:
            out[:, self.seen] = 1.0
        elif self.seen:
            out[:, self.seen] = shares(m)
        return out

    def scored(self, rows: DataFrame, name: str = "dist") -> DataFrame:
        """rows with an array of shares, or the probability of a logistic model; null and NaN features are missing."""
        one = self.classes == 1

        @F.pandas_udf("double" if one else "array<double>")
        def score(*columns: pd.Series) -> pd.Series:
            p = self.shares_of(np.column_stack([c.to_numpy(np.float64) for c in columns]))
            return pd.Series(p[:, 0] if one else list(p))

        return rows.withColumn(name, score(*(F.col(f).cast("double") for f in self.features)))

    def save(self, path: str) -> None:
        body = json.dumps(self.__dict__ | {"rounds": [[t.__dict__ for t in trees] for trees in self.rounds]})
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> Boosted:
        body = json.loads(SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0])
        return Boosted(**body | {"rounds": [[Tree(**t) for t in trees] for trees in body["rounds"]]})


def feature_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Of each feature, quantiles of its values that cut it into so many bins at most: the largest value of each bin but the last."""
    out = []
    cuts = [k / (bins - 1) for k in range(1, bins - 1)]
    for a in range(0, len(features), AT_ONCE):
        known = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features[a : a + AT_ONCE]]
        found = rows.agg(*(F.percentile_approx(c, cuts, 10_000).alias(f"q{k}") for k, c in enumerate(known)), *(F.max(c).alias(f"m{k}") for k, c in enumerate(known))).first()
        for k in range(len(known)):
            q = sorted(set(found[f"q{k}"] or []))
            out.append([v for v in q if v < found[f"m{k}"]])
    return out


class _Growth:
    """A tree of one class while it grows: its nodes with their sums, the best cut of each node as far as it is known, and which nodes really are leaves."""

    def __init__(self) -> None:
        self.tree, self.leaves = Tree(), {0}
        self.best: dict[int, tuple | None] = {}
        self.sums: dict[int, tuple[float, float]] = {}
        self.done: set[int] = set()

    def advance(self, most: int) -> list[int]:
        """Splits best leaf first as far as gains are known; gives the nodes whose sums are needed to go on, and those that may be next."""
        while len(self.leaves) < most:
            if any(n not in self.best for n in self.leaves):
                break
            able = [n for n in self.leaves if self.best[n]]
            if not able:
                break
            n = max(able, key=lambda n: (self.best[n][0], -n))
            self.leaves = self.leaves - {n} | set(self._below(n))
            self.done.add(n)
        else:
            return []
        unknown = [n for n in self.leaves if n not in self.best]
        if not unknown:
            return []
        able = sorted((n for n in self.leaves if self.best.get(n)), key=lambda n: -self.best[n][0])
        return unknown + [c for n in able[: most - len(self.leaves)] for c in self._below(n) if c not in self.best]

    def _below(self, n: int) -> tuple[int, int]:
        if self.tree.left[n] < 0:
            _, feature, cut, gl, hl, gr, hr = self.best[n]
            a, b = self.tree.split(n, feature, cut)
            self.sums[a], self.sums[b] = (gl, hl), (gr, hr)
        return self.tree.left[n], self.tree.right[n]

    def finished(self, rate: float, l2: float) -> Tree:
        """The tree of the nodes that were split, numbered anew from the root."""
        out, at = Tree(), [(0, 0)]
        while at:
            n, new = at.pop()
            if n in self.done:
                a, b = out.split(new, self.tree.feature[n], self.tree.cut[n])
                at += [(self.tree.left[n], a), (self.tree.right[n], b)]
            else:
                g, h = self.sums[n]
                out.value[new] = -rate * g / (h + l2)
        return out


def _gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = shares(margins)
    own = y[:, None] == (np.arange(p.shape[1]) if p.shape[1] > 1 else np.ones(1))
    return w[:, None] * (p - own), w[:, None] * p * (1 - p)


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    """x (bins), y, w, margins, u of pieces of bounded size."""
    size = max(256, BLOCK // max(1, features))
    for whole in batches:
        for a in range(0, len(whole), size):
            b = whole.slice(a, size)
            x = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(b), features)
            m = np.array(b.column("margin").to_pylist(), np.float64).reshape(len(b), -1)
            yield x, b.column("y").to_numpy(), b.column("w").to_numpy(), m, b.column("u").to_numpy()


def _histograms(model: Boosted, first: int, trees: list[Tree], wanted: list[list[int]], rows: tuple[float, float], bins: int):
    """For mapInArrow: sums of a task's rows by wanted node, feature and bin. rows: the range of u that this round takes."""
    spots = [np.full(len(t.left), -1) for t in trees]
    count = 0
    for k, nodes in enumerate(wanted):
        for n in nodes:
            spots[k][n] = count
            count += 1
    width = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, count * width * bins))
        for x, y, w, m, u in _blocks(batches, width):
            turn = (u - rows[0]) % 1.0 < rows[1]
            x, y, w, m = x[turn], y[turn], w[turn], m[turn]
            g, h = _gradients(m + model.margins(x, first), y, w)
            for k, t in enumerate(trees):
                spot = spots[k][t.nodes(x)] if wanted[k] else np.full(len(x), -1)
                here = spot >= 0
                at = ((spot[here, None] * width + np.arange(width)) * bins + x[here]).ravel()
                for i, v in enumerate((g[here, k], h[here, k], np.ones(here.sum()))):
                    sums[i] += np.bincount(at, np.repeat(v, width), count * width * bins)
        full = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(full // bins // width, pa.int32()), pa.array(full // bins % width, pa.int32()), pa.array(full % bins, pa.int32()), *(pa.array(s[full]) for s in sums)], ["node", "feature", "bin", "g", "h", "n"])

    return run


def best_cuts(sums: DataFrame, l2: float, least_rows: float, least_weight: float, allowed: DataFrame | None = None) -> DataFrame:
    """Of each node: the cut with the greatest gain (ties: smallest feature, then bin), the sums on both sides, and the node's own; no cut is null.

    sums: node, feature, bin, g, h, n, in parts that are added up. allowed (node, feature): the features that a node may use.
    """
    whole = sums.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))
    if allowed is not None:
        whole = whole.join(F.broadcast(allowed), ["node", "feature"], "left_semi")  # a round's nodes times features
    each = Window.partitionBy("node", "feature")
    up = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = whole.select("node", "feature", "bin", *(F.sum(x).over(up).alias(f"{x}l") for x in "ghn"), *(F.sum(x).over(each).alias(x) for x in "ghn"))
    gain = F.expr(f"gl * gl / (hl + {l2!r}D) + (g - gl) * (g - gl) / (h - hl + {l2!r}D) - g * g / (h + {l2!r}D)")
    fits = F.expr(f"nl >= {least_rows} AND n - nl >= {least_rows} AND hl >= {least_weight!r}D AND h - hl >= {least_weight!r}D")
    c = c.withColumn("gain", F.when(fits & (gain > 1e-9), gain))
    return c.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", (F.col("g") - F.col("gl")).alias("gr"), (F.col("h") - F.col("hl")).alias("hr"))).alias("best"), F.max_by("g", "feature").alias("g"), F.max_by("h", "feature").alias("h"))


def fit(rows: DataFrame, features: list[str], label: str, classes: int, weight: str | None = None, **settings) -> Boosted:
    """A softmax model of classes 0 to classes - 1, of which those without a row have no share; or, with classes 1, a logistic model of a 0/1 label.

    Rows without a label, or with no positive weight, are left out; no rows give a model without trees. Missing features go left. A row's share in the sample of a round (row_share) is fixed by its values.
    """
    s = SETTINGS | settings
    if unknown := set(settings) - set(SETTINGS):
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    spark = rows.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    # Only these columns are read, under names of their own, whatever rows calls them.
    values = F.array(*(F.col(f).cast("double") for f in features))
    known = rows.where(F.col(label).isNotNull() & (w > 0)).select(values.alias("x"), F.col(label).cast("int").alias("y"), w.alias("w"))
    totals = {r.y: r.s for r in known.groupBy("y").agg(F.sum("w").alias("s")).where(F.col("y").between(0, max(1, classes - 1))).collect()}
    edges = feature_edges(rows, features, min(s["bins"], 255))
    whole = sum(totals.values()) or 1.0
    if classes == 1:
        p = min(1 - 1e-6, max(1e-6, totals.get(1, 0.0) / whole))
        model = Boosted(features, edges, 1, [1], [float(np.log(p / (1 - p)))])
    else:
        seen = sorted(totals)
        model = Boosted(features, edges, classes, seen, [float(np.log(totals[k] / whole)) for k in seen])
    if len(totals) < 2:
        return model
    place = {k: k if classes == 1 else i for i, k in enumerate(sorted(totals))}

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = binned(np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], np.float64).reshape(len(b), len(features)), edges)
            y = pa.array([place.get(v, -1) for v in b.column("y").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), y, b.column("w"), b.column("u")], ["bins", "y", "w", "u"])

    table = known.withColumn("u", F.shiftrightunsigned(F.xxhash64("x", "y"), 11) / F.lit(float(1 << 53))).mapInArrow(prepare, "bins binary, y int, w double, u double").where("y >= 0")
    table = _written(table.withColumn("margin", F.array(*map(F.lit, model.start))), "boost-rows")
    rng, written = np.random.default_rng(s["seed"]), 0
    for r in range(s["rounds"]):
        if r - written >= UNWRITTEN:
            table, written = _moved_on(table, model, written), r
        model.rounds.append(_round(spark, table, model, written, s, rng))
    table.tesserae_drop()
    return model


def _written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = sinks.shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tesserae_drop = lambda: sinks.remove(spark, path)
    return out


def _moved_on(table: DataFrame, model: Boosted, first: int) -> DataFrame:
    """The table with the margins of the rounds from first on added."""
    width, names = len(model.features), ["bins", "y", "w", "u", "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [old + model.margins(x, first) for x, _, _, old, _ in _blocks([b], width)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), pa.array([list(v) for part in m for v in part], pa.list_(pa.float64()))], names)

    out = _written(table.select(*names).mapInArrow(run, "bins binary, y int, w double, u double, margin array<double>"), "boost-rows")
    table.tesserae_drop()
    return out


def _round(spark: SparkSession, table: DataFrame, model: Boosted, written: int, s: dict, rng: np.random.Generator) -> list[Tree]:
    growing = [_Growth() for _ in model.start]
    width = len(model.features)
    columns = [sorted(rng.choice(width, max(1, round(s["feature_share"] * width)), replace=False).tolist()) for _ in growing] if s["feature_share"] < 1 else None
    rows = (float(rng.random()), s["row_share"]) if s["row_share"] < 1 else (0.0, 1.0)
    while any(wanted := [g.advance(s["leaves"]) for g in growing]):
        of = [(k, n) for k, nodes in enumerate(wanted) for n in nodes]
        sums = table.mapInArrow(_histograms(model, written, [g.tree for g in growing], wanted, rows, 256), "node int, feature int, bin int, g double, h double, n double")
        allowed = spark.createDataFrame([(i, f) for i, (k, _) in enumerate(of) for f in columns[k]], "node int, feature int") if columns else None
        found = {r.node: r for r in best_cuts(sums, float(s["l2"]), s["least_rows"], float(s["least_weight"]), allowed).collect()}  # one for each node
        for i, (k, n) in enumerate(of):
            r = found.get(i)
            if r is not None and n == 0:
                growing[k].sums[0] = (r.g, r.h)
            b = r and r.best
            growing[k].best[n] = (b.gain, -b.f, -b.b, b.gl, b.hl, b.gr, b.hr) if b and b.gain is not None else None
    for g in growing:
        g.sums.setdefault(0, (0.0, 0.0))
    return [g.finished(s["rate"], s["l2"]) for g in growing]
