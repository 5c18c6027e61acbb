"""Domain views over the general tables: what stands in for reports, tracks, grids, members, predictions, fires and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

NY, NX = 24, 32


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hazard = F.when(F.col("event_type") == "error", "tor").when(F.col("event_type") == "purchase", "wind").when(F.col("event_type") == "click", "hail")
    e = e.withColumn("hazard", hazard).where(F.col("hazard").isNotNull())
    ef = F.when((F.col("hazard") != "tor") | (F.col("event_id") % 11 == 0), -1).otherwise(F.floor(F.col("value") / 100).cast("int"))
    e = e.withColumn("ef", ef)
    magnitude = F.when(F.col("hazard") == "tor", F.col("ef").cast("double")).when(F.col("hazard") == "wind", 20 + F.col("value") / 4).otherwise(F.col("value") / 100)
    e = e.withColumn("magnitude", magnitude)
    return e.select("event_id", F.col("ts").alias("time"), (F.lit(25.0) + F.pmod(F.col("event_id") * 37, F.lit(2400)) / F.lit(100.0)).alias("lat"), (F.lit(-120.0) + F.pmod(F.col("user_id") * 53, F.lit(5000)) / F.lit(100.0)).alias("lon"), "hazard", "magnitude", "ef", F.when(F.col("hazard") == "wind", F.col("magnitude") * F.lit(1.15077945)).alias("wind_mph"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("hazard = 'tor'")
    return r.select("event_id", "time", F.col("lat").alias("slat"), F.col("lon").alias("slon"), (F.col("lat") + (F.col("event_id") % 7) * F.lit(0.05)).alias("elat"), (F.col("lon") + (F.col("event_id") % 5) * F.lit(0.08)).alias("elon"), "ef")


def spine(spark: SparkSession, ny: int = NY, nx: int = NX) -> DataFrame:
    """Every cell of a grid, dense."""
    return spark.range(ny * nx).select((F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iy, ix, v, u2, v2 on the dense grid; v has holes where (31 * iy + ix) % 17 = 0."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy((F.col("o_custkey") % NY).cast("int").alias("iy"), (F.col("o_orderkey") % NX).cast("int").alias("ix")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / F.lit(100.0) / F.count("*")).alias("v"), F.avg(F.col("o_orderkey") % 101).alias("u2"), F.avg(F.col("o_custkey") % 89).alias("v2"))
    hole = (31 * F.col("iy") + F.col("ix")) % 17 == 0
    return spine(spark).join(g, ["iy", "ix"], "left").withColumn("v", F.when(~hole, F.col("v")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_linenumber").alias("member"), (F.col("l_partkey") % NY).cast("int").alias("iy"), (F.col("l_suppkey") % NX).cast("int").alias("ix")).agg(F.max("l_quantity").cast("double").alias("x"))


def bins(hazard: str) -> int:
    return 4 if hazard == "hail" else 5


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fxx, iy, ix, hazard, p, dist (4 bins for hail, else 5), pib (7 bins)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    hazard = F.element_at(F.array(F.lit("tor"), F.lit("wind"), F.lit("hail")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    weight = [F.sum(1 + F.pmod(F.col("l_partkey") * (i + 1), F.lit(17))).cast("double").alias(f"w{i}") for i in range(7)]
    g = l.groupBy((1 + F.col("l_orderkey") % 12).cast("int").alias("fxx"), (F.col("l_partkey") % NY).cast("int").alias("iy"), (F.col("l_suppkey") % NX).cast("int").alias("ix"), hazard.alias("hazard")).agg((F.avg(F.round(F.col("l_discount") * 100).cast("int")) * F.lit(0.06)).alias("p"), *weight)
    dist = F.array(*(F.col(f"w{i}") for i in range(5)))
    return g.select("fxx", "iy", "ix", "hazard", "p", F.when(F.col("hazard") == "hail", F.slice(dist, 1, 4)).otherwise(dist).alias("dist"), F.array(*(F.col(f"w{i}") for i in range(7))).alias("pib"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("irwin"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_custkey") % 10).cast("int"))).alias("end"), F.when(F.col("o_custkey") % 13 != 0, F.col("o_totalprice") / 50).alias("final_size"), F.col("o_custkey").alias("custkey"))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("irwin"), F.col("l_shipdate").alias("time"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v: a column of 64 values; level i is at 100 * i metres and 1000 - 10 * i mb."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return d.select("doc_id", "n_chars").join(l, "doc_id").select("doc_id", (F.col("n_chars") % 50 / F.lit(50.0)).alias("p"), F.col("quality").alias("y"), (1 + F.col("doc_id") % 3).alias("w"))


#: The same views for DuckDB, as the leading parts of a WITH clause.
SQL = {
    "v_reports": """v_reports AS (
  SELECT *, CASE WHEN hazard = 'wind' THEN magnitude * 1.15077945::DOUBLE END AS wind_mph FROM (
    SELECT event_id, time, lat, lon, hazard, ef, CASE hazard WHEN 'tor' THEN ef::DOUBLE WHEN 'wind' THEN 20 + value / 4 ELSE value / 100 END AS magnitude FROM (
      SELECT event_id, ts AS time, value, 25::DOUBLE + (event_id * 37 % 2400)::DOUBLE / 100::DOUBLE AS lat, -120::DOUBLE + (user_id * 53 % 5000)::DOUBLE / 100::DOUBLE AS lon,
        CASE event_type WHEN 'error' THEN 'tor' WHEN 'purchase' THEN 'wind' ELSE 'hail' END AS hazard,
        CASE WHEN event_type <> 'error' OR event_id % 11 = 0 THEN -1 ELSE floor(value / 100)::INT END AS ef
      FROM events WHERE event_type IN ('error', 'purchase', 'click'))))""",
    "v_tracks": """v_tracks AS (SELECT event_id, time, lat AS slat, lon AS slon, lat + (event_id % 7) * 0.05::DOUBLE AS elat, lon + (event_id % 5) * 0.08::DOUBLE AS elon, ef FROM v_reports WHERE hazard = 'tor')""",
    "v_grid": """v_grid AS (
  SELECT iy, ix, CASE WHEN (31 * iy + ix) % 17 <> 0 THEN v END AS v, u2, v2
  FROM (SELECT y::INT AS iy, x::INT AS ix FROM range(24) a(y), range(32) b(x)) LEFT JOIN (
    SELECT (o_custkey % 24)::INT AS iy, (o_orderkey % 32)::INT AS ix, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100::DOUBLE / count(*) AS v, avg(o_orderkey % 101) AS u2, avg(o_custkey % 89) AS v2
    FROM orders GROUP BY 1, 2) USING (iy, ix))""",
    "v_members": """v_members AS (SELECT l_linenumber AS member, (l_partkey % 24)::INT AS iy, (l_suppkey % 32)::INT AS ix, max(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2, 3)""",
    "v_preds": """v_preds AS (
  SELECT fxx, iy, ix, hazard, p, CASE WHEN hazard = 'hail' THEN w[1:4] ELSE w[1:5] END AS dist, w AS pib FROM (
    SELECT (1 + l_orderkey % 12)::INT AS fxx, (l_partkey % 24)::INT AS iy, (l_suppkey % 32)::INT AS ix, ['tor', 'wind', 'hail'][l_linenumber % 3 + 1] AS hazard, avg(round(l_discount * 100)::INT) * 0.06::DOUBLE AS p,
      [sum(1 + l_partkey * 1 % 17)::DOUBLE, sum(1 + l_partkey * 2 % 17)::DOUBLE, sum(1 + l_partkey * 3 % 17)::DOUBLE, sum(1 + l_partkey * 4 % 17)::DOUBLE, sum(1 + l_partkey * 5 % 17)::DOUBLE, sum(1 + l_partkey * 6 % 17)::DOUBLE, sum(1 + l_partkey * 7 % 17)::DOUBLE] AS w
    FROM lineitem GROUP BY 1, 2, 3, 4))""",
    "v_fires": """v_fires AS (SELECT o_orderkey AS irwin, o_orderdate AS start, o_orderdate + to_days((o_custkey % 10)::INT) AS "end", CASE WHEN o_custkey % 13 <> 0 THEN o_totalprice / 50 END AS final_size, o_custkey AS custkey FROM orders)""",
    "v_footprints": """v_footprints AS (SELECT l_orderkey AS irwin, l_shipdate AS time, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)""",
    "v_columns": """v_columns AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "v_scores": """v_scores AS (SELECT doc_id, (n_chars % 50) / 50::DOUBLE AS p, quality AS y, 1 + doc_id % 3 AS w FROM documents JOIN labels USING (doc_id))""",
}
