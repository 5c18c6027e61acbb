"""Queries over grids and vertical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns, solar
from ..operators import grid, labels
from ..sources import views

from .registry import query

NY, NX, STEP = views.NY, views.NX, 15.0


@query("SELECT iy // 5 AS by, ix // 5 AS bx, round(avg(v), 6) AS mean, count(v) AS n FROM v_grid WHERE iy < 20 AND ix < 30 GROUP BY 1, 2", ["v_grid"])
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.blocks(views.grid(spark, sf_dir), [F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n")], 5, NY, NX)


@query("SELECT iy // 5 AS by, ix // 5 AS bx, round(max(v), 6) AS largest FROM v_grid WHERE iy < 20 AND ix < 30 GROUP BY 1, 2", ["v_grid"])
def block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.blocks(views.grid(spark, sf_dir), [F.round(F.max("v"), 6).alias("largest")], 5, NY, NX)


def disc_sql(r: float) -> str:
    n = int(r)
    return f"SELECT a.iy, a.ix, avg(b.v) AS m, avg(b.v * b.v) AS q FROM v_grid a JOIN (SELECT dy, dx FROM range(-{n}, {n + 1}) p(dy), range(-{n}, {n + 1}) q(dx) WHERE dy * dy + dx * dx <= {r * r!r}::DOUBLE) o ON true LEFT JOIN v_grid b ON b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY 1, 2"


@query(f"SELECT a.iy, a.ix, a.m::FLOAT AS mean25, b.m::FLOAT AS mean50, c.m::FLOAT AS mean100 FROM ({disc_sql(C.cells(25))}) a JOIN ({disc_sql(C.cells(50))}) b USING (iy, ix) JOIN ({disc_sql(C.cells(100))}) c USING (iy, ix)", ["v_grid"])
def neighborhood_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.grid(spark, sf_dir)
    out = None
    for r in C.RADII_MI:
        m = grid.neighbourhood(g, ["v"], C.cells(r)).select("iy", "ix", F.col("v_mean").cast("float").alias(f"mean{int(r)}"))
        out = m if out is None else out.join(m, ["iy", "ix"])
    return out


@query(f"SELECT iy, ix, round(sqrt(greatest(q - m * m, 0)), 2) AS std, (v - m)::FLOAT AS tpi FROM ({disc_sql(C.cells(25))}) JOIN v_grid USING (iy, ix)", ["v_grid"])
def texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.grid(spark, sf_dir)
    t = grid.neighbourhood(g, ["v"], C.cells(25.0)).join(g.select("iy", "ix", "v"), ["iy", "ix"])
    return t.select("iy", "ix", F.round("v_std", 2).alias("std"), (F.col("v") - F.col("v_mean")).cast("float").alias("tpi"))


@query("SELECT iy, ix, " + ", ".join(f"round(avg((coalesce(x, -1) >= {t})::INT::DOUBLE), 6) AS p{t}" for t in C.EXCEEDANCE["refc"]) + ", count(*) AS members FROM v_members GROUP BY 1, 2", ["v_members"])
def exceedance_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A member without a row lacks the variable and doesn't count; NaN and null count as not exceeding.
    x = F.nanvl(F.col("x"), F.lit(None).cast("double"))
    return views.members(spark, sf_dir).groupBy("iy", "ix").agg(*(F.round(F.avg(F.when(x >= t, 1.0).otherwise(0.0)), 6).alias(f"p{t}") for t in C.EXCEEDANCE["refc"]), F.count("*").alias("members"))


GRAD_SQL = """, g AS (SELECT c.iy, c.ix,
  (coalesce(e.u2, CASE WHEN e.ix IS NULL THEN c.u2 END) - coalesce(w.u2, CASE WHEN w.ix IS NULL THEN c.u2 END)) / ((coalesce(e.ix, c.ix) - coalesce(w.ix, c.ix)) * 15) AS ux,
  (coalesce(e.v2, CASE WHEN e.ix IS NULL THEN c.v2 END) - coalesce(w.v2, CASE WHEN w.ix IS NULL THEN c.v2 END)) / ((coalesce(e.ix, c.ix) - coalesce(w.ix, c.ix)) * 15) AS vx,
  (coalesce(n.u2, CASE WHEN n.ix IS NULL THEN c.u2 END) - coalesce(s.u2, CASE WHEN s.ix IS NULL THEN c.u2 END)) / ((coalesce(n.iy, c.iy) - coalesce(s.iy, c.iy)) * 15) AS uy,
  (coalesce(n.v2, CASE WHEN n.ix IS NULL THEN c.v2 END) - coalesce(s.v2, CASE WHEN s.ix IS NULL THEN c.v2 END)) / ((coalesce(n.iy, c.iy) - coalesce(s.iy, c.iy)) * 15) AS vy
  FROM v_grid c LEFT JOIN v_grid e ON e.iy = c.iy AND e.ix = c.ix + 1 LEFT JOIN v_grid w ON w.iy = c.iy AND w.ix = c.ix - 1 LEFT JOIN v_grid n ON n.ix = c.ix AND n.iy = c.iy + 1 LEFT JOIN v_grid s ON s.ix = c.ix AND s.iy = c.iy - 1)"""


@query(GRAD_SQL + " SELECT iy, ix, round(ux + vy, 6) + 0.0 AS div, round(CASE WHEN ux + vy IS NOT NULL THEN greatest(-(ux + vy), 0) END, 6) + 0.0 AS conv, round(vx - uy, 6) + 0.0 AS vort, round(ux - vy, 6) + 0.0 AS stretch, round(vx + uy, 6) + 0.0 AS shear, round(sqrt(pow(ux - vy, 2) + pow(vx + uy, 2)), 6) AS deformation FROM g", ["v_grid"])
def gradient_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.wind_fields(views.grid(spark, sf_dir), "u2", "v2", STEP)
    conv = F.when(F.col("div").isNotNull(), F.col("conv"))
    r = lambda c, n: (F.round(c, 6) + F.lit(0.0)).alias(n)
    return g.select("iy", "ix", r(F.col("div"), "div"), r(conv, "conv"), *(r(F.col(c), c) for c in ("vort", "stretch", "shear", "deformation")))


@query(GRAD_SQL.replace("u2", "v").replace("v2", "u2") + " SELECT iy, ix, (ux + 0.0)::FLOAT AS dx, (uy + 0.0)::FLOAT AS dy, sqrt(ux * ux + uy * uy)::FLOAT AS slope, round(sin(atan2(-uy, -ux)), 6) + 0.0 AS aspect_sin, round(cos(atan2(-uy, -ux)), 6) + 0.0 AS aspect_cos FROM g", ["v_grid"])
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.slope_aspect(views.grid(spark, sf_dir), "v", STEP)
    r = lambda c, n: (F.col(c) + F.lit(0.0)).cast("float").alias(n)
    return g.select("iy", "ix", r("v_dx", "dx"), r("v_dy", "dy"), r("slope", "slope"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("aspect_sin", "aspect_cos")))


R25 = C.cells(25.0)


@query(f""", m AS (SELECT *, u2 / greatest(sqrt(u2 * u2 + v2 * v2), 0.001) AS du, v2 / greatest(sqrt(u2 * u2 + v2 * v2), 0.001) AS dv FROM v_grid WHERE u2 IS NOT NULL),
s AS (SELECT iy, ix, 'a' AS side, iy + {R25!r}::DOUBLE * dv AS y, ix + {R25!r}::DOUBLE * du AS x FROM m UNION ALL SELECT iy, ix, 'b', iy - {R25!r}::DOUBLE * dv, ix - {R25!r}::DOUBLE * du FROM m
  UNION ALL SELECT iy, ix, 'l', iy + {R25!r}::DOUBLE * du, ix - {R25!r}::DOUBLE * dv FROM m UNION ALL SELECT iy, ix, 'r', iy - {R25!r}::DOUBLE * du, ix + {R25!r}::DOUBLE * dv FROM m),
c AS (SELECT iy, ix, side, greatest(0, least(23, y)) AS y, greatest(0, least(31, x)) AS x FROM s),
f AS (SELECT c.iy, c.ix, side, CASE WHEN count(g.v) = 4 THEN sum((CASE WHEN ky = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN kx = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * g.v) END AS z
  FROM c JOIN (SELECT ky, kx FROM range(2) p(ky), range(2) q(kx)) k ON true JOIN v_grid g ON g.iy = least(floor(y)::INT + ky, 23) AND g.ix = least(floor(x)::INT + kx, 31) GROUP BY 1, 2, 3),
w AS (SELECT iy, ix, max(z) FILTER (side = 'a') AS a, max(z) FILTER (side = 'b') AS b, max(z) FILTER (side = 'l') AS l, max(z) FILTER (side = 'r') AS r FROM f GROUP BY 1, 2)
SELECT iy, ix, round(a - b, 4) + 0.0 AS forward, round(l - r, 4) + 0.0 AS leftward, round((a + b) - (l + r), 4) + 0.0 AS straddling FROM w""", ["v_grid"])
def directional_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grid.directional(views.grid(spark, sf_dir).where("u2 IS NOT NULL"), "v", "u2", "v2", R25, NY, NX)
    return d.select("iy", "ix", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("forward", "leftward", "straddling")))


def smooth_sql(source: str, sigma: float, to: str, edge: str = "nearest") -> str:
    n = int(4 * sigma + 0.5)
    clamp = (lambda c, m: f"least({m}, greatest(0, {c} + k))") if edge == "nearest" else (lambda c, m: f"{c} + k")
    ker = f"(SELECT k, exp(-0.5 * pow(k / {sigma!r}::DOUBLE, 2)) / sum(exp(-0.5 * pow(k / {sigma!r}::DOUBLE, 2))) OVER () AS w FROM range(-{n}, {n + 1}) r(k))"
    join = "JOIN" if edge == "nearest" else "LEFT JOIN"
    one = f"(SELECT a.iy, a.ix, sum(w * coalesce(b.v, 0)) AS v FROM {source} a JOIN {ker} ON true {join} {source} b ON b.iy = a.iy AND b.ix = {clamp('a.ix', NX - 1)} GROUP BY 1, 2)"
    return f"{to}_x AS {one}, {to} AS (SELECT a.iy, a.ix, sum(w * coalesce(b.v, 0)) AS v FROM {to}_x a JOIN {ker} ON true {join} {to}_x b ON b.ix = a.ix AND b.iy = {clamp('a.iy', NY - 1)} GROUP BY 1, 2)"


@query(f", z AS (SELECT iy, ix, coalesce(v, 0) / 1000 AS v FROM v_grid), {smooth_sql('z', C.cells(25), 's25')}, {smooth_sql('z', C.cells(50), 's50')} SELECT iy, ix, round(list_sort([z.v, s25.v, s50.v])[2], 6) AS v FROM z JOIN s25 USING (iy, ix) JOIN s50 USING (iy, ix)", ["v_grid"])
def gaussian_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = views.grid(spark, sf_dir).select("iy", "ix", (F.coalesce("v", F.lit(0.0)) / 1000).alias("v"))
    return grid.median_of_smooths(z, "v").select("iy", "ix", F.round("v", 6).alias("v"))


SIGMA_PPF = 120.0 / STEP


@query(f", o AS (SELECT iy, ix, ((event_id * 7919 + 104729) % 97)::DOUBLE AS h FROM (SELECT event_id, (floor((lat - 25) * 23.99 / 24))::INT AS iy, (floor((lon + 120) * 31.99 / 50))::INT AS ix FROM v_reports)), z AS (SELECT iy, ix, coalesce(max((h < 9)::INT), 0)::DOUBLE AS v FROM (SELECT y::INT AS iy, x::INT AS ix FROM range({NY}) a(y), range({NX}) b(x)) LEFT JOIN o USING (iy, ix) GROUP BY 1, 2), {smooth_sql('z', SIGMA_PPF, 's', 'zero')} SELECT iy, ix, round(v, 6) AS v FROM s", ["v_reports"])
def ppf(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reports(spark, sf_dir)
    iy, ix = F.floor((F.col("lat") - 25) * F.lit(23.99) / 24).cast("int"), F.floor((F.col("lon") + 120) * F.lit(31.99) / 50).cast("int")
    hit = (F.pmod(F.col("event_id") * 7919 + 104729, F.lit(97)) < 9).cast("int")
    day = labels.practically_perfect(r.select(F.lit("any").alias("hazard"), iy.alias("iy"), ix.alias("ix"), hit.alias("flag")))
    dense = views.spine(spark).join(day, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("flag", F.lit(0)).cast("double").alias("v"))
    return grid.gaussian(dense, ["v"], SIGMA_PPF, edge="zero").select("iy", "ix", F.round("v", 6).alias("v"))


def pressures():
    """Pressures of the 64 levels; made when asked for, as expressions need a session."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(1000.0) - 10 * i)


def heights():
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(100.0) * i)


def bracket_sql(coord: str, target: str) -> str:
    """SQL for v interpolated at a target, from rows (i, c, v) per column; c rises."""
    return f"""(SELECT vec_id, CASE WHEN hi_c > lo_c THEN lo_v + greatest(0, least(1, ({target} - lo_c) / (hi_c - lo_c))) * (hi_v - lo_v) ELSE lo_v END AS z FROM (
      SELECT vec_id, max(c) FILTER (i = k - 1) AS lo_c, max(v) FILTER (i = k - 1) AS lo_v, max(c) FILTER (i = k) AS hi_c, max(v) FILTER (i = k) AS hi_v
      FROM (SELECT *, greatest(1, least(63, sum((c < {target})::INT) OVER (PARTITION BY vec_id)))::INT AS k FROM (SELECT vec_id, i, v, {coord} AS c FROM lv)) GROUP BY 1))"""


LEVELS_SQL = ", lv AS (SELECT vec_id, i, v[i + 1] AS v FROM v_columns, range(64) r(i))"


@query(LEVELS_SQL + " SELECT a.vec_id, " + ", ".join(f"round({x}.z, 6) + 0.0 AS p{p}" for x, p in zip("abc", (925, 850, 300), strict=True)) + " FROM " + " JOIN ".join(f"{bracket_sql('-ln(1000 - 10 * i)', f'-ln({p})')} {x}" + (" USING (vec_id)" if x != "a" else "") for x, p in zip("abc", (925, 850, 300), strict=True)), ["v_columns"])
def interp_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.columns(spark, sf_dir)
    return v.select("vec_id", *((F.round(columns.interpolate_logp(pressures(), F.col("v"), F.lit(float(p))), 6) + F.lit(0.0)).alias(f"p{p}") for p in (925, 850, 300)))


@query(LEVELS_SQL + " SELECT a.vec_id, " + ", ".join(f"round({x}.z, 6) + 0.0 AS z{z}" for x, z in zip("abc", (250, 1525, 9000), strict=True)) + " FROM " + " JOIN ".join(f"{bracket_sql('100 * i', str(z))} {x}" + (" USING (vec_id)" if x != "a" else "") for x, z in zip("abc", (250, 1525, 9000), strict=True)), ["v_columns"])
def interp_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.columns(spark, sf_dir)
    return v.select("vec_id", *((F.round(columns.interpolate(heights(), F.col("v"), F.lit(float(z))), 6) + F.lit(0.0)).alias(f"z{z}") for z in (250, 1525, 9000)))


@query(LEVELS_SQL + ", m AS (SELECT vec_id, i, v, max(v) OVER (PARTITION BY vec_id ORDER BY i) AS m FROM lv) SELECT vec_id, round(sum(m), 6) + 0.0 AS total, round(max(m) FILTER (i = 10), 6) + 0.0 AS at10 FROM m GROUP BY 1", ["v_columns"])
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.columns(spark, sf_dir).withColumn("m", columns.running_max(F.col("v")))
    return v.select("vec_id", (F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"), (F.round(F.col("m")[10], 6) + F.lit(0.0)).alias("at10"))


@query(LEVELS_SQL + ", t AS (SELECT *, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM lv) SELECT vec_id, round(sum((v + n) / 2 * 100) FILTER (i < 30), 5) + 0.0 AS area, round(avg(v) FILTER (i BETWEEN 10 AND 30), 6) + 0.0 AS layer_mean FROM t GROUP BY 1", ["v_columns"])
def trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.columns(spark, sf_dir)
    return v.select("vec_id", (F.round(columns.trapezoid(F.slice("v", 1, 31), 100.0), 5) + F.lit(0.0)).alias("area"), (F.round(columns.mean(F.slice("v", 11, 21)), 6) + F.lit(0.0)).alias("layer_mean"))


@query(LEVELS_SQL + """, c AS (SELECT *, sum(v) OVER (PARTITION BY vec_id ORDER BY i) AS cum FROM lv), f AS (SELECT vec_id, min(i) FILTER (cum > 0) AS k FROM c GROUP BY 1)
SELECT vec_id, coalesce(k, -1)::INT AS lfc, round(coalesce(sum(v) FILTER (i >= k AND v > 0), 0), 6) + 0.0 AS cape, round(coalesce(sum(v) FILTER (i < k AND v < 0), 0), 6) + 0.0 AS cin FROM c JOIN f USING (vec_id) GROUP BY vec_id, k""", ["v_columns"])
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.columns(spark, sf_dir).withColumn("c", columns.first_crossing(F.col("v")))
    return v.select("vec_id", F.col("c.index").alias("lfc"), (F.round("c.positive", 6) + F.lit(0.0)).alias("cape"), (F.round("c.negative", 6) + F.lit(0.0)).alias("cin"))


@query(", r AS (SELECT vec_id, v, 1 AS i, 300 + v[1] AS t FROM v_columns UNION ALL SELECT vec_id, v, i + 1, t - 0.5::DOUBLE * (t - 280) / 40 + v[i + 1] FROM r WHERE i < 64) SELECT vec_id, round(max(t) FILTER (i = 64), 6) AS top, round(sum(t), 4) AS total FROM r GROUP BY 1", ["v_columns"], recursive=True)
def parcel_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    steps = columns.recurrence(F.slice(v, 2, 63), F.lit(300.0) + v[0], lambda t, x: t - F.lit(0.5) * (t - 280) / 40 + x)
    s = views.columns(spark, sf_dir).select("vec_id", F.concat(F.array(F.lit(300.0) + v[0]), steps).alias("t"))
    return s.select("vec_id", F.round(F.col("t")[63], 6).alias("top"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


SOLAR_SQL = f""", g AS (SELECT event_id, lat, lon, hour(time) * 60 + minute(time) + second(time) / 60::DOUBLE AS m, dayofyear(time) AS doy, 2 * pi() / 365 * (dayofyear(time) - 1 + (hour(time) - 12) / 24::DOUBLE) AS y FROM v_reports),
d AS (SELECT *, 0.006918::DOUBLE - 0.399912::DOUBLE * cos(y) + 0.070257::DOUBLE * sin(y) - 0.006758::DOUBLE * cos(2 * y) + 0.000907::DOUBLE * sin(2 * y) - 0.002697::DOUBLE * cos(3 * y) + 0.00148::DOUBLE * sin(3 * y) AS decl,
  229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(y) - 0.032077::DOUBLE * sin(y) - 0.014615::DOUBLE * cos(2 * y) - 0.040849::DOUBLE * sin(2 * y)) AS eq FROM g),
h AS (SELECT *, radians(((m + eq + 4 * lon) - 1440 * floor((m + eq + 4 * lon) / 1440)) / 4 - 180) AS ha FROM d),
z AS (SELECT *, greatest(-1, least(1, sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(ha))) AS cz FROM h)
SELECT event_id, round(greatest(cz, 0), 6) AS cos_zen, round(degrees(asin(cz)), 5) AS altitude, round({C.SOLAR!r}::DOUBLE * (1 + 0.033::DOUBLE * cos(2 * pi() * doy / 365)) * greatest(cz, 0), 4) AS toa, round(CASE WHEN cz > 0 THEN 1098 * cz * exp(-0.059::DOUBLE / cz) ELSE 0 END, 4) AS ghi FROM z"""


@query(SOLAR_SQL, ["v_reports"])
def solar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reports(spark, sf_dir)
    s = solar.position(F.col("time"), F.col("lat"), F.col("lon"))
    return r.select("event_id", F.round(s["cos_zen"], 6).alias("cos_zen"), F.round(s["altitude"], 5).alias("altitude"), F.round(s["toa"], 4).alias("toa"), F.round(s["ghi"], 4).alias("ghi"))
