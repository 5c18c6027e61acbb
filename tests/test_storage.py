"""Tables that meet without a shuffle, and stores of which only the runs asked for are read."""

import datetime as dt

from pyspark.sql import functions as F
from tesserae import cli
from tesserae.plans import jobs
from tesserae.sources import sinks, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrix_of_clustered_tables_has_no_shuffle(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-02 00:00:00', INTERVAL 1 HOUR)) AS valid")
    cells = spark.range(300).select((F.col("id") / 20).cast("int").alias("iy"), (F.col("id") % 20).cast("int").alias("ix"))
    hours.crossJoin(cells).withColumn("v", F.col("iy") * 1.0).write.parquet(at("f"))
    hours.select("valid", F.lit(3).alias("iy"), F.lit(4).alias("ix"), F.lit(1).alias("flag")).write.parquet(at("l"))
    cli.main(["cluster", "--input", at("f"), "--name", "tess_features", "--out", at("fc"), "--buckets", "6"])
    sinks.clustered(spark.read.parquet(at("l")), "tess_labels", at("lc"), ["valid", "iy", "ix"], 6)
    try:
        samples = hours.where("hour(valid) = 18").withColumns({"fxx": F.lit(6), "run": F.col("valid") - F.expr("INTERVAL 6 HOURS")})
        plain = jobs.build_matrix(samples, spark.read.parquet(at("f")), spark.read.parquet(at("l")), ["flag"], 0.5)
        # No table is small enough to be broadcast but the samples: what is left are shuffles, of plain tables, and none of clustered ones.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = jobs.build_matrix(F.broadcast(samples), tables.dataset(spark, "table:tess_features"), tables.dataset(spark, "table:tess_labels"), ["flag"], 0.5)
        shuffles = lambda p: p.count("Exchange hashpartitioning")
        assert shuffles(plan_of(made)) == 0 and "SortMergeJoin" in plan_of(made)
        assert shuffles(plan_of(jobs.build_matrix(F.broadcast(samples), spark.read.parquet(at("f")), spark.read.parquet(at("l")), ["flag"], 0.5))) == 2
        rows = lambda df: sorted((r.valid, r.iy, r.ix, r.flag, r.weight) for r in df.collect())
        assert rows(made) == rows(plain) and len(rows(made)) > 100
        # A bucket is a file.
        assert len([f for f in (tmp_path / "fc").iterdir() if f.suffix == ".parquet"]) <= 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("tess_features", "tess_labels"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_only_the_runs_asked_for_are_read(spark, tmp_path):
    path, t = str(tmp_path / "store"), dt.datetime(2024, 1, 1)
    rows = [(h, t + dt.timedelta(hours=6 * r), f, 0, 0, 0.5) for h in ("tor", "hail") for r in range(5) for f in (1, 2)]
    df = spark.createDataFrame(rows, "hazard string, run timestamp, fxx int, iy int, ix int, p double")
    for h in ("tor", "hail"):
        jobs.store(df.where(F.col("hazard") == h), path)
    have = jobs.stored(spark, path, df)
    one = have.where((F.col("hazard") == "tor") & (F.col("run") == F.lit(t + dt.timedelta(hours=12))))
    assert one.count() == 2 and "PartitionFilters: [isnotnull(hazard" in plan_of(one)
    scanned = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" in scanned
    folders = {f.rsplit("/", 1)[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(folders) == 1 and len({f.rsplit("/", 1)[0] for f in have.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) == 10
    # Cells that are stored already are told apart by run and lead time.
    cells = df.drop("hazard", "p").withColumn("fxx", F.col("fxx") + 1)
    assert {r.fxx for r in jobs.lacking(cells, have, "tor").collect()} == {3} and jobs.lacking(cells, have, "wind").count() == cells.count()
