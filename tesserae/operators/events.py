"""Reports, tracks, fires and runs: windows, joins in space and time, selections. Range joins go through buckets, so that each is an equi-join with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import bins, geo


def normalize(reports: DataFrame, hazards: dict[str, str] | None = None, wind_in_mph: bool = False) -> DataFrame:
    """Known hazards by their short name; wind without a number goes; mph turned to knots if so given; ratings below 0 are -1."""
    r = reports
    if hazards:
        names = F.create_map(*(F.lit(x) for kv in hazards.items() for x in kv))
        r = r.withColumn("hazard", names[F.col("hazard")])
    r = r.where(F.col("hazard").isin(*C.HAZARDS))
    if wind_in_mph:
        r = r.withColumn("magnitude", F.when(F.col("hazard") == "wind", F.col("magnitude") / F.lit(C.KT_TO_MPH)).otherwise(F.col("magnitude")))
    r = r.where((F.col("hazard") != "wind") | (F.col("magnitude").isNotNull() & ~F.isnan("magnitude")))
    return r.withColumn("ef", F.when((F.col("hazard") == "tor") & (F.col("ef") >= 0), F.col("ef")).otherwise(-1))


def in_time_order(reports: DataFrame) -> DataFrame:
    """Reports sorted by time over all partitions; ties by place and hazard."""
    return reports.orderBy("time", "lat", "lon", "hazard")


def merged(*sources: DataFrame, unknown_wind: float | None = None) -> DataFrame:
    """Reports of several sources, of equal ones (time, place, hazard) that of the first source; wind of the value that stands for unknown has none."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("__from", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    if unknown_wind is not None:
        known = ~((F.col("hazard") == "wind") & (F.col("magnitude") == unknown_wind))
        out = out.withColumn("magnitude", F.when(known, F.col("magnitude")))
    cols = [c for c in out.columns if c != "__from"]
    best = out.groupBy("time", "lat", "lon", "hazard").agg(F.min_by(F.struct(*cols), "__from").alias("r"))
    return best.select("r.*")


def with_severity(reports: DataFrame) -> DataFrame:
    """severe, significant, bin and pib of each report."""
    h, m = F.col("hazard"), F.col("magnitude")
    bin_ = bins.by_hazard(h, {x: bins.intensity_bin(x, m) for x in C.HAZARDS})
    pib = bins.by_hazard(h, {x: bins.pib_bin(x, F.col("wind_mph") if x != "hail" else m) for x in C.HAZARDS})
    return reports.withColumns({"severe": bins.is_severe(h, m), "significant": bins.is_significant(h, m, F.col("ef")), "bin": bin_, "pib": pib})


def window_hours(time: Column, minutes: int = C.NEIGHBOURHOOD_MINUTES) -> Column:
    """The whole hours whose closed window of so many minutes (30 at most) to either side holds a time: one, or two at the very edge."""
    half = F.expr(f"INTERVAL {minutes} MINUTES")
    last = F.date_trunc("HOUR", time + half)
    first = F.date_trunc("HOUR", time - half + F.expr("INTERVAL 3599999999 MICROSECONDS"))
    return F.filter(F.array_distinct(F.array(first, last)), lambda t: (time >= t - half) & (time <= t + half))


def in_windows(reports: DataFrame) -> DataFrame:
    """A row for each hour that a report counts in: valid_time."""
    return reports.withColumn("valid_time", F.explode(window_hours(F.col("time"))))


def busy_hours(reports: DataFrame, least: int) -> DataFrame:
    """Hours with so many reports at least: hour, n."""
    return reports.groupBy(F.date_trunc("HOUR", "time").alias("hour")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _tiles(lat: Column, lon: Column, size: float, spread: int) -> Column:
    """The tile of a point, or with spread 1 also those around it."""
    y, x = F.floor(lat / F.lit(size)), F.floor(lon / F.lit(size))
    around = [F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy in range(-spread, spread + 1) for dx in range(-spread, spread + 1)]
    return F.array(*around)


def near_pairs(points: DataFrame, anchors: DataFrame, miles: float, tile: float = 1.0) -> DataFrame:
    """Pairs of rows of points (as p) and anchors (as a), each with lat and lon, within so many miles; d: the distance.

    Tiles must be wider than the radius at the latitudes in question: 1 degree holds 25 miles up to 68 degrees.
    Each has a column day, which must agree.
    """
    p = points.select("day", F.explode(_tiles(F.col("lat"), F.col("lon"), tile, 0)).alias("tile"), F.struct(*points.columns).alias("p"))
    a = anchors.select("day", F.explode(_tiles(F.col("lat"), F.col("lon"), tile, 1)).alias("tile"), F.struct(*anchors.columns).alias("a"))
    d = geo.haversine(F.col("p.lat"), F.col("p.lon"), F.col("a.lat"), F.col("a.lon"))
    return p.join(a, ["day", "tile"]).select("p", "a", d.alias("d")).where(F.col("d") <= miles)


def nearest_anchor(points: DataFrame, anchors: DataFrame, id_col: str, miles: float = 25.0) -> DataFrame:
    """id_col, anchor_id, d: of each point the nearest anchor of its day, the last (by seq) of equals; points without one go.

    A running maximum per point, so partial results combine before the shuffle.
    """
    pairs = near_pairs(points, anchors, miles)
    best = pairs.groupBy(F.col(f"p.{id_col}").alias(id_col)).agg(F.max(F.struct((-F.col("d")).alias("near"), F.col("a.seq").alias("seq"), F.col(f"a.{id_col}").alias("anchor_id"))).alias("b"))
    return best.select(id_col, "b.anchor_id", (-F.col("b.near")).alias("d"))


def without_near(points: DataFrame, anchors: DataFrame, id_col: str, miles: float = 10.0, hours: int = 24) -> DataFrame:
    """points without those that have an anchor within so many hours (24 at most) and miles."""
    day = lambda t: F.date_trunc("DAY", t).cast("date")
    a = anchors.withColumn("day", F.explode(F.array(*(F.date_add(day(F.col("time")), k) for k in (-1, 0, 1)))))
    pairs = near_pairs(points.withColumn("day", day(F.col("time"))), a, miles)
    gap = F.abs(F.unix_micros(F.col("p.time").cast("timestamp")) - F.unix_micros(F.col("a.time").cast("timestamp")))
    hit = pairs.where(gap <= hours * 3_600_000_000).select(F.col(f"p.{id_col}").alias(id_col)).distinct()
    return points.join(hit, id_col, "left_anti")


def active_at(intervals: DataFrame, times: DataFrame, time: str = "t") -> DataFrame:
    """Rows of times with each interval (start, end, both included) that holds them; a bucket a day."""
    span = intervals.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    at = times.withColumn("day", F.to_date(time))
    return at.join(span, "day").where(F.col(time).between(F.col("start"), F.col("end"))).drop("day")


def as_of(points: DataFrame, versions: DataFrame, key: str, at: str, time: str, order: list[str], value: list[str]) -> DataFrame:
    """points with the values of the latest version of their key at or before at; of equal times the largest by order; nulls without one."""
    asked = points.select(key, F.col(at).alias("__at")).distinct()
    latest = versions.join(asked, key).where(F.col(time) <= F.col("__at")).groupBy(key, "__at").agg(F.max(F.struct(time, *order, *[v for v in value if v not in order])).alias("__v"))
    return points.join(latest.withColumnRenamed("__at", at), [key, at], "left").select(*points.columns, *(F.col(f"__v.{v}").alias(v) for v in value))


def recent_runs(valid: DataFrame, n: int = C.MEMBERS, as_of_col: str | None = "as_of") -> DataFrame:
    """valid (t and, if limited, as_of) with run, lag, member (from 1) of the n newest runs that reach it: the lag is within the cycle's length, the run not after as_of."""
    runs = valid.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(C.LONG_HOURS)))).withColumn("run", F.col("t") - F.make_dt_interval(hours=F.col("lag")))
    length = F.when(F.hour("run").isin(*C.LONG_CYCLES), C.LONG_HOURS).otherwise(C.SHORT_HOURS)
    runs = runs.where(length >= F.col("lag"))
    if as_of_col:
        runs = runs.where(F.col("run") <= F.col(as_of_col))
    return runs.withColumn("member", F.row_number().over(Window.partitionBy(*valid.columns).orderBy("lag"))).where(F.col("member") <= n)


def neighbours_in_time(rows: DataFrame, keys: list[str], time: str, values: list[str], hours: int = 1) -> DataFrame:
    """rows with the values of the same keys an hour before and after (_prev, _next); by equality of time, as hours may be missing."""
    out = rows
    for name, shift in (("_prev", hours), ("_next", -hours)):
        other = rows.select(*keys, (F.col(time) + F.make_dt_interval(hours=F.lit(shift))).alias(time), *(F.col(v).alias(v + name) for v in values))
        out = out.join(other, [*keys, time], "left")
    return out


def first_of(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def outlook_at(outlooks: DataFrame, t: Column) -> DataFrame:
    """Of the outlooks that haven't expired at t, those of the issuance closest to it; none if none is valid."""
    valid = outlooks.where((F.col("issue") <= t) & (F.col("expire") > t))
    gap = F.abs(F.unix_micros(F.col("issue").cast("timestamp")) - F.unix_micros(t.cast("timestamp")))
    closest = valid.groupBy("category").agg(F.min(F.struct(gap.alias("gap"), "issue")).alias("c")).select("category", F.col("c.issue").alias("issue"))
    return valid.join(closest, ["category", "issue"], "left_semi")
