"""Streaming queries, run over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.tables import table
from ..streaming import streams
from .registry import query


def _upserted(stream: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table of a stream whose rows replace one another."""
    spark = stream.sparkSession
    path = sinks.shared_path(spark, "stream-table")
    return streams.drain(stream, path, sinks.shared_path(spark, "stream-state"), streams.upsert_writer(path, keys, version))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.hourly(streams.event_stream(spark, sf_dir)).withColumn("day", F.to_date("hour"))
    return _upserted(s, ["hour", "event_type"], "n").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT t AS valid_time, count(*) AS n FROM events, LATERAL (SELECT unnest(CASE WHEN date_trunc('hour', ts + INTERVAL 30 MINUTE) = ts + INTERVAL 30 MINUTE THEN [date_trunc('hour', ts + INTERVAL 30 MINUTE), date_trunc('hour', ts - INTERVAL 30 MINUTE)] ELSE [date_trunc('hour', ts + INTERVAL 30 MINUTE)] END) AS t) z GROUP BY 1")
def stream_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.centred(streams.event_stream(spark, sf_dir)).withColumn("day", F.to_date("valid_time"))
    return _upserted(s, ["valid_time"], "n").select(F.col("valid_time").cast("timestamp_ntz").alias("valid_time"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 24 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions, those that the watermark hasn't closed yet as they are so far."""
    path = sinks.shared_path(spark, "sessions")
    s = streams.drain(streams.sessions(streams.event_stream(spark, sf_dir)), path, sinks.shared_path(spark, "stream-state"), streams.whole_writer(path), "complete")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


#: Days of a delivery, and deliveries.
DELIVERY, DELIVERIES = 12, 3

#: A report is what three events say one after another, the later ones correcting the earlier; each fifth is delivered four days late. A delivery's watermark is that of those before it.
VERSIONS_SQL = f""", a AS (SELECT event_id // 3 AS report, event_id AS version, ts, event_type, user_id, ts + to_days((CASE WHEN event_id % 5 = 0 THEN 4 ELSE 0 END)::INT) AS arrival FROM events),
d AS (SELECT *, least({DELIVERIES - 1}, datediff('day', (SELECT min(arrival) FROM a), arrival) // {DELIVERY}) AS delivery FROM a),
m AS (SELECT delivery, max(ts) AS top FROM d GROUP BY 1),
k AS (SELECT d.* FROM d WHERE coalesce(CAST(ts AS DATE) + INTERVAL 1 DAY > (SELECT date_trunc('milliseconds', max(top)) - INTERVAL 12 HOUR FROM m WHERE m.delivery < d.delivery), true)),
v AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY version DESC) AS r FROM k)
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, report, version, event_type, user_id FROM v WHERE r = 1"""


@query(VERSIONS_SQL.removeprefix(", ").join(["WITH ", ""]))
def stream_last_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each report that comes before its day is final. Each delivery is a run of its own that goes on from the last one's checkpoint."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 5 == 0, F.make_dt_interval(days=F.lit(4))).otherwise(F.make_dt_interval(days=F.lit(0)))
    rows = e.select(F.floor(F.col("event_id") / 3).alias("report"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", (F.col("ts") + late).alias("arrival"))
    first = rows.agg(F.min("arrival")).first()[0]
    rows = rows.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.floor(F.datediff("arrival", F.lit(first)) / DELIVERY)).cast("int")).drop("arrival")
    source, path, state = (sinks.shared_path(spark, n) for n in ("deliveries", "stream-table", "stream-state"))
    out = rows.limit(0)
    for k in range(DELIVERIES):
        rows.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(source)
        stream = streams.last_versions(spark.readStream.schema(rows.drop("delivery").schema).parquet(source), ["report"], "version")
        out = streams.drain(stream, path, state, streams.upsert_writer(path, ["report"], "version", reach=30))
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "report", "version", "event_type", "user_id")
