"""Structured Streaming over reports: hourly counts, centred windows, sessions, deduplication, last versions; sinks that resume and replace.

Results are tables in files: closed windows are appended by Spark's own file sink, windows and reports that still change
are put into a table partitioned by day, of which a batch replaces just the days it touches. Sessions, whose ends move, are replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

GRACE = "12 hours"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The events table as a stream, its time as a UTC timestamp, so that it can carry a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, grace: str = GRACE) -> DataFrame:
    """hour, event_type, n: a day isn't final before the grace."""
    w = F.window("ts", "1 hour")
    return stream.withWatermark("ts", grace).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def centred(stream: DataFrame, grace: str = GRACE) -> DataFrame:
    """valid_time, n: closed windows of half an hour to either side; an event at the very half hour counts in both."""
    half = F.expr("INTERVAL 30 MINUTES")
    start = F.date_trunc("HOUR", F.col("ts") + half)
    both = F.when(start == F.col("ts") + half, F.array(start, start - F.expr("INTERVAL 1 HOUR"))).otherwise(F.array(start))
    each = stream.withWatermark("ts", grace).select("ts", F.explode(both).alias("valid_time"))
    return each.groupBy("valid_time").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "24 hours", grace: str = GRACE) -> DataFrame:
    """user_id, start, end, n: activity without a longer gap."""
    s = stream.withWatermark("ts", grace).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], within: str = "24 hours") -> DataFrame:
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def active(fires: DataFrame, reports: DataFrame, grace: str = GRACE) -> DataFrame:
    """Pairs of a report and a fire of its key that was active then: an interval join of two streams."""
    f = fires.withWatermark("start", grace).alias("f")
    r = reports.withWatermark("ts", grace).alias("r")
    return r.join(f, F.expr("r.key = f.key AND r.ts >= f.start AND r.ts <= f.start + INTERVAL 10 DAYS AND r.ts <= f.end"))


def resume_writer(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows of a batch whose keys the table lacks, so a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return write


def last_versions(stream: DataFrame, keys: list[str], version: str, grace: str = GRACE) -> DataFrame:
    """day, keys and the other columns of each key's last version, for reports (ts, keys, version) that come in any order and more than once.

    A day takes replacements until the grace after its end has passed by the watermark; what comes later is dropped, and the day's state with it. In update mode
    only keys that have changed come out. A null version comes before all others.
    """
    rest = [c for c in stream.columns if c not in (*keys, version)]
    own = F.max(F.struct(version, *rest)).alias("last")
    w = stream.withWatermark("ts", grace).groupBy(F.window("ts", "1 day"), *keys).agg(own)
    return w.select(F.to_date("window.start").alias("day"), *keys, f"last.{version}", *(f"last.{c}" for c in rest))


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row of each key: that with the greatest version; partial sums before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("last"))
    return last.select(*(F.col("last").getField(c).alias(c) if c in (version, *rest) else F.col(c) for c in rows.columns))


def upsert_writer(path: str, keys: list[str], version: str, by: str = "day", reach: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table at path, partitioned by a date, that has of each key the row with the greatest version of all batches.

    A batch replaces the days that it has rows for, and those from which one of its keys moves away; other days aren't read, but for their keys, and of these only days
    within reach of the batch's own, if that is given. Days change places by renaming, so a reader sees a day before or after a batch, and a batch that is run again
    changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = newest(batch, keys, version).persist()
        try:
            days = fresh.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
            if days.a is None:
                return
            try:
                old = spark.read.schema(fresh.schema).parquet(path)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                sinks.overwrite(fresh.repartition(by), path, by)
                return
            near = old if reach is None else old.where(F.col(by).between(F.date_sub(F.lit(days.a), reach), F.date_add(F.lit(days.b), reach)))
            left = near.join(fresh.select(*keys), keys, "left_semi").select(by)
            touched = [r[0] for r in fresh.select(by).union(left).distinct().collect()]  # days
            both = old.where(F.col(by).isin(touched)).unionByName(fresh)
            sinks.overwrite(newest(both, keys, version).repartition(by), path, by, [{by: str(d)} for d in touched])
        finally:
            fresh.unpersist()

    return write


def whole_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in complete mode: the table at path is the last batch, so that a batch that is run again changes nothing. It changes place by renaming."""
    return lambda batch, _: sinks.overwrite(batch, path)


def drain(stream: DataFrame, path: str, state: str, write: Callable[[DataFrame, int], None] | None = None, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is available now, from where its checkpoint (state) ended, and gives the table at path.

    Without write, rows that are final are appended by the file sink; with it, rows that have changed (or all rows, if mode is complete) go to write, batch by batch.
    """
    out = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    q = out.outputMode("append").format("parquet").start(path) if write is None else out.outputMode(mode).foreachBatch(write).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
