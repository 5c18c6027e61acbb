"""Builds that flush by day, resume and stop; members and static fields in the matrix."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tesserae import cli
from tesserae.operators import events
from tesserae.plans import jobs
from tesserae.sources import sinks

T = dt.datetime(2024, 3, 2, 18)
HOURS = [T + dt.timedelta(days=d) for d in range(6)]


@pytest.fixture
def tables(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    hours = spark.createDataFrame([(h,) for h in HOURS], "valid timestamp_ntz")
    cells = spark.range(30).select((F.col("id") / 6).cast("int").alias("iy"), (F.col("id") % 6).cast("int").alias("ix"))
    spark.createDataFrame([(i, h + dt.timedelta(minutes=i), 35.0, -97.0, "tor", 1.0, 1) for i, h in enumerate(HOURS)], "event_id long, time timestamp_ntz, lat double, lon double, hazard string, magnitude double, ef int").write.parquet(at("reports"))
    hours.crossJoin(cells).withColumn("v", F.col("iy") * 1.0).write.parquet(at("features"))
    hours.select("valid", F.lit(2).alias("iy"), F.lit(3).alias("ix"), F.lit(1).alias("flag")).write.parquet(at("labels"))
    cells.select("iy", "ix", (F.col("ix") * 10.0).alias("elev")).write.parquet(at("static"))
    runs = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-03-01 00:00:00', TIMESTAMP_NTZ '2024-03-08 00:00:00', INTERVAL 1 HOUR)) AS run")
    runs = runs.withColumn("fxx", F.explode(F.sequence(F.lit(1), F.lit(20))))
    value = F.when(F.hour("run") % 5 == 0, float("nan")).otherwise((F.hour("run") * 3 + F.col("iy")).cast("double"))
    runs.where("hour(run) <> 11").crossJoin(cells).withColumns({"refc": value, "uh25": value * 4}).write.parquet(at("members"))
    return at


def test_build_flushes_resumes_and_stops(spark, tables, monkeypatch):
    args = ["build-data", "--reports", tables("reports"), "--features", tables("features"), "--labels", tables("labels"), "--out", tables("m"), "--bands", "6", "--neg-keep", "0.5", "--flush-days", "2"]
    room = iter([90.0, 90.0, 10.0])
    monkeypatch.setattr(sinks, "free_gb", lambda *a: next(room, 90.0))
    with pytest.raises(SystemExit, match="2 days are left"):
        cli.main([*args, "--min-free-gb", "50"])
    first = spark.read.parquet(tables("m"))
    assert first.select("valid").distinct().count() == 4
    before = {r.key: r.weight for r in first.collect()}
    cli.main([*args, "--resume"])
    whole = spark.read.parquet(tables("m"))
    rows = [r.key for r in whole.collect()]
    assert len(rows) == len(set(rows)) and set(before) <= set(rows) and whole.select("valid").distinct().count() == 6
    # Another lead time joins the days that are there; nothing comes twice.
    cli.main([*args, "--resume", "--bands", "6,12"])
    more = spark.read.parquet(tables("m"))
    assert {r.fxx: r["count"] for r in more.groupBy("fxx").count().collect()}[6] == len(rows) and more.select("key").distinct().count() == more.count()
    # The same build in one go has the same rows.
    cli.main([*args[:8], tables("one"), *args[9:], "--bands", "6,12", "--flush-days", "30"])
    assert {r.key for r in spark.read.parquet(tables("one")).collect()} == {r.key for r in more.collect()}


def test_a_job_that_dies_in_a_flush_leaves_whole_days(spark, tables, monkeypatch):
    make = lambda some: jobs.build_matrix(some, spark.read.parquet(tables("features")), spark.read.parquet(tables("labels")), ["flag"], 1.0)
    samples = jobs.plan_samples(spark.read.parquet(tables("reports")), [6])
    swap, calls = sinks._Folders.swap, []

    def dies(self, new, path):
        calls.append(path)
        if len(calls) == 4:
            raise OSError("killed")
        swap(self, new, path)

    monkeypatch.setattr(sinks._Folders, "swap", dies)
    with pytest.raises(OSError, match="killed"):
        jobs.flush(samples, make, tables("d"), days=3)
    monkeypatch.setattr(sinks._Folders, "swap", swap)
    there = spark.read.parquet(tables("d"))
    assert {r["count"] for r in there.groupBy("valid").count().collect()} == {30} and there.count() == 90
    left = sinks.not_done(samples, there, ["run", "fxx"])
    assert jobs.flush(left, make, tables("d"), days=3) == 0
    assert spark.read.parquet(tables("d")).count() == 180


def test_members_and_static_fields(spark, tables):
    cli.main(["build-data", "--reports", tables("reports"), "--features", tables("features"), "--labels", tables("labels"), "--out", tables("m"), "--bands", "6", "--neg-keep", "0.4", "--members", "4", "--member-fields", tables("members"), "--static", tables("static")])
    got = spark.read.parquet(tables("m"))
    assert got.where("elev <> ix * 10").count() == 0 and {"prob_refc_ge50", "prob_uh25_ge300"} <= set(got.columns) and "prob_refd_ge30" not in got.columns
    r = got.where("flag = 1").orderBy("valid").first()
    runs = [x.run for x in events.recent_runs(spark.createDataFrame([(r.valid, r.run)], "t timestamp_ntz, as_of timestamp_ntz"), 4).collect()]
    assert len(runs) == 4 and max(runs) == r.run
    hours = [x.hour for x in runs if x.hour != 11]
    want = sum(h % 5 != 0 and h * 3 + r.iy >= 30 for h in hours) / len(hours)
    assert r.prob_refc_ge30 == pytest.approx(want)


def test_fire_categories_are_masked(spark, tmp_path):
    run = dt.datetime(2024, 7, 1, 12)
    tail = [0.0] * 5 + [1.0, 1.0]
    rows = [(run, f, 0, ix, "wildfire", p, d) for ix, hours in enumerate([((0.01, tail), (0.015, tail)), ((0.01, tail), (0.03, [1.0] + [0.0] * 6)), ((0.4, [1.0] + [0.0] * 6), (0.6, tail))]) for f, (p, d) in enumerate(hours, 1)]
    rows += [(run, 1, 0, 0, "tor", 0.3, [0.0, 0.0, 1.0, 0.0, 0.0])]
    p = spark.createDataFrame(rows, "run timestamp, fxx int, iy int, ix int, hazard string, p double, dist array<double>")
    jobs.render(p, str(tmp_path / "products"))
    day = {(r.hazard, r.ix): (r.p, r.cig, r.category) for r in spark.read.parquet(str(tmp_path / "products" / "day")).collect()}
    # Below the lowest contour the class doesn't count; above it the class may come from another hour.
    assert day["wildfire", 0] == (0.015, 0, -1) and day["wildfire", 1] == (0.03, 3, 2) and day["wildfire", 2] == (0.6, 3, 3)
    combined = spark.read.parquet(str(tmp_path / "products" / "combined")).collect()
    assert [(r.ix, r.category) for r in combined] == [(0, day["tor", 0][2])]
    assert spark.read.parquet(str(tmp_path / "products" / "hourly")).where("hazard = 'wildfire'").count() == 6


def test_report_days_are_fetched_until_they_are_final(spark, tmp_path):
    path, asked = str(tmp_path / "reports"), []
    shape = "time timestamp, lat double, lon double, hazard string, magnitude double, source string"
    day = lambda k: dt.date(2024, 5, k)
    state = {"a": [], "b": []}

    def fetch(days):
        asked.append(days)
        return [spark.createDataFrame([r for r in rows if r[0].date() in days], shape) for rows in (state["a"], state["b"])]

    at = lambda k, h: dt.datetime(2024, 5, k, h)
    state["a"] = [(at(1, 3), 35.0, -97.0, "hail", 1.0, "a"), (at(2, 5), 35.0, -97.0, "wind", -9.0, "a")]
    state["b"] = [(at(1, 3), 35.0, -97.0, "hail", 2.0, "b"), (at(1, 4), 36.0, -97.0, "tor", 1.0, "b")]
    run = lambda days, now, **k: jobs.refresh_reports(spark, path, days, fetch, now, unknown_wind=-9.0, **k)
    rows = lambda: sorted((r.day, r.hazard, r.magnitude, r.source) for r in spark.read.parquet(path).collect())
    assert run([day(1), day(2), day(3)], at(2, 13)) == [day(1), day(2), day(3)]
    assert rows() == [(day(1), "hail", 1.0, "a"), (day(1), "tor", 1.0, "b"), (day(2), "wind", None, "a")]
    # Day 1 was final when it was fetched; the others weren't, and one of them was empty.
    state["a"] = [(at(1, 9), 35.0, -97.0, "hail", 9.0, "never asked for"), (at(3, 5), 35.0, -97.0, "hail", 3.0, "a")]
    assert run([day(1), day(2), day(3)], at(3, 11)) == [day(2), day(3)]
    assert rows() == [(day(1), "hail", 1.0, "a"), (day(1), "tor", 1.0, "b"), (day(3), "hail", 3.0, "a")]
    assert run([day(1), day(2), day(3)], at(3, 12)) == [day(2), day(3)]  # just final for day 2
    assert run([day(1), day(2), day(3)], at(9, 0)) == [day(3)] and run([day(1), day(2), day(3)], at(9, 1)) == []
    assert run([day(1)], at(9, 2), force=True) == [day(1)] and asked[-1] == [day(1)]
    assert jobs.reports_of(spark, path, [day(1)]).count() == 3 and not list((tmp_path / "reports").glob("day=2024-05-02*"))
