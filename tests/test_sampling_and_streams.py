"""Samples as even as random ones, last versions of late reports, tables whose days are replaced."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tesserae.operators import dataset
from tesserae.plans import jobs
from tesserae.plans.catalogue import QUERIES
from tesserae.sources import sinks
from tesserae.streaming import streams

from .conftest import SF


def test_kept_cells_are_as_if_drawn(spark):
    ny, nx, keep = 211, 359, 0.025
    cells = spark.range(ny * nx).select(F.expr(f"CAST(id DIV {nx} AS INT)").alias("iy"), F.expr(f"CAST(id % {nx} AS INT)").alias("ix"))
    key = dataset.row_key(F.lit("2024-05-01 18:00:00").cast("timestamp"), F.lit(6), F.col("iy"), F.col("ix"))
    kept = dataset.subsample(cells, F.lit(False), key, keep).toPandas()
    at = np.sort(kept.iy.to_numpy() * nx + kept.ix.to_numpy())
    n = len(at)
    assert n == pytest.approx(keep * ny * nx, abs=5 * (keep * ny * nx) ** 0.5)
    # Gaps between kept cells: geometric, so that their mean is 1 / keep, their spread as large, and short ones as frequent as they should be.
    gaps = np.diff(at)
    assert gaps.std() == pytest.approx((1 - keep) ** 0.5 / keep, rel=0.12)
    for most in (1, 5, 20, 80):
        p = 1 - (1 - keep) ** most
        assert (gaps <= most).mean() == pytest.approx(p, abs=5 * (p * (1 - p) / n) ** 0.5)
    for side, size in ((kept.iy, ny), (kept.ix, nx)):
        counts = np.bincount(side, minlength=size)
        assert counts.var() == pytest.approx(n / size, rel=0.35)
    # Bags don't follow from what was kept.
    bags = dataset.bag(spark.createDataFrame(kept[["iy", "ix"]]).withColumn("weight", F.lit(1.0)), F.lit(False), key, 4).groupBy("bag").count().toPandas()
    assert len(bags) == 4 and bags["count"].min() > 0.8 * n / 4


def test_row_keys_are_distinct(spark):
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-02', INTERVAL 6 HOURS)) AS valid")
    rows = hours.crossJoin(spark.range(1, 49).toDF("fxx")).crossJoin(spark.range(3).toDF("iy")).crossJoin(spark.range(359).toDF("ix"))
    key = dataset.row_key(F.col("valid"), F.col("fxx"), F.col("iy"), F.col("ix"))
    n, different = rows.agg(F.count("*"), F.countDistinct(key)).first()
    assert n == different == 5 * 48 * 3 * 359
    m = jobs.build_matrix(rows.select("valid", "fxx", F.col("valid").alias("run")).distinct(), rows.select("valid", "iy", "ix").distinct(), rows.limit(0).select("valid", "iy", "ix", F.lit(1).alias("flag")), ["flag"], 1.0)
    assert m.count() == n and m.select("key").distinct().count() == n


def test_guard_of_sized_positives_by_key(spark):
    rows = spark.createDataFrame([(h, b, f) for h, n, k in (("tor", 60, 3), ("wind", 60, 1), ("hail", 10, 3), (None, 55, 2)) for i in range(n) for b, f in [(i % k, 1), (0, 0)]] + [("tor", -1, 1)], "hazard string, bin int, flag int")
    assert {r.hazard: r["count"] for r in dataset.sized_positives(rows, "flag", "bin", keys=["hazard"]).groupBy("hazard").count().collect()} == {"tor": 60, None: 55}
    assert dataset.sized_positives(rows, "flag", "bin").count() == 185
    assert dataset.sized_positives(rows, "flag", "bin", least_rows=1000).columns == rows.columns


T0 = dt.datetime(2024, 3, 1)
SHAPE = "key int, version int, ts timestamp, what string"


def delivered(spark, path, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(path)


def last_of(rows):
    best = {}
    for r in rows:
        if r[0] not in best or r[1] > best[r[0]][1]:
            best[r[0]] = r
    return sorted((r[2].date(), *r[:2], r[3]) for r in best.values())


def table_rows(spark, path):
    return sorted((r.day, r.key, r.version, r.what) for r in spark.read.parquet(path).collect())


def test_last_versions_over_restarts(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    rng = random.Random(1)
    hours = lambda lo, hi: T0 + dt.timedelta(hours=rng.uniform(lo, hi))
    first = [(k, 2 * v, hours(0, 48), f"a{k}.{v}") for k in range(60) for v in rng.sample(range(4), 2)]
    second = [(k, 2 * v + 3, hours(40, 80), f"b{k}.{v}") for k in range(30, 90) for v in rng.sample(range(4), 2)]  # keys whose day changes, old versions that come late
    too_late = [(5, 99, T0 + dt.timedelta(hours=1), "dropped"), (200, 1, T0 + dt.timedelta(hours=2), "dropped")]
    third = [(k, 50, hours(70, 90), f"c{k}") for k in (1, 40, 300)]
    seen = []
    for rows, late in ((first, []), (second, []), (third, too_late)):  # each run goes on from the last one's checkpoint
        delivered(spark, source, rows + late)
        stream = streams.last_versions(spark.readStream.schema(SHAPE).parquet(source), ["key"], "version")
        streams.drain(stream, path, state, streams.upsert_writer(path, ["key"], "version", reach=10))
        seen += rows
        assert table_rows(spark, path) == last_of(seen)
    days = {n for n in (p.name for p in (tmp_path / "table").iterdir()) if n.startswith("day=")}
    assert days == {f"day={d}" for d, *_ in last_of(seen)}


def test_upsert_repeats_without_change_and_clears_days(spark, tmp_path):
    path = str(tmp_path / "t")
    write = streams.upsert_writer(path, ["key"], "version")
    day = lambda d, *rows: spark.createDataFrame([(dt.date(2024, 1, d), *r) for r in rows], "day date, key int, version int, what string")
    write(day(1, (1, 1, "x")), 0)
    write(day(2, (2, 1, "y"), (3, 1, "z")), 1)
    moved = day(3, (1, 2, "moved"), (3, None, "older"))
    for _ in range(2):
        write(moved, 2)
        assert table_rows(spark, path) == [(dt.date(2024, 1, 2), 2, 1, "y"), (dt.date(2024, 1, 2), 3, 1, "z"), (dt.date(2024, 1, 3), 1, 2, "moved")]
    assert not (tmp_path / "t" / "day=2024-01-01").exists()
    write(moved.limit(0), 3)
    assert len(table_rows(spark, path)) == 3


def test_nested_partitions_are_replaced_alone_and_put_back(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda *r: spark.createDataFrame(r, "hazard string, run timestamp, p double")
    a, b = dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 1, 12)
    sinks.overwrite(rows(("tor", a, 0.1), ("tor", b, 0.2), ("wind", a, 0.3)), path, ["hazard", "run"])
    sinks.overwrite(rows(("tor", b, 0.9)), path, ["hazard", "run"])
    read = lambda: sorted((r.hazard, r.run, r.p) for r in spark.read.parquet(path).collect())
    assert read() == [("tor", a, 0.1), ("tor", b, 0.9), ("wind", a, 0.3)]
    # A run that has died between two renames.
    part = next((tmp_path / "p" / "hazard=tor").iterdir())
    part.rename(str(part) + ".old")
    sinks.overwrite(rows(("hail", a, 0.5)), path, ["hazard", "run"])
    assert read() == [("hail", a, 0.5), ("tor", a, 0.1), ("tor", b, 0.9), ("wind", a, 0.3)]


def test_sessions_that_are_still_open_are_there(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    hour = lambda h: T0 + dt.timedelta(hours=h)
    read = lambda: sorted((r.user_id, r.start, r.end, r.n) for r in spark.read.parquet(path).collect())
    shape = "user_id int, ts timestamp"
    want = (
        [(1, hour(0), hour(34), 2), (2, hour(100), hour(124), 1)],
        [(1, hour(0), hour(34), 2), (2, hour(100), hour(134), 2), (3, hour(101), hour(125), 1)],
    )
    for rows, sessions in zip(([(1, hour(0)), (1, hour(10)), (2, hour(100))], [(2, hour(110)), (3, hour(101))]), want, strict=True):  # the second run goes on from the first one's checkpoint
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        streams.drain(streams.sessions(spark.readStream.schema(shape).parquet(source)), path, state, streams.whole_writer(path), "complete")
        assert read() == sessions
    assert QUERIES["stream_session"](spark, SF).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
