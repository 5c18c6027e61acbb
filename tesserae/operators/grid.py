"""Grids as rows (iy, ix, values): block statistics, circular neighbourhoods, gradients, displaced samples, Gaussian smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def missing_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def blocks(rows: DataFrame, aggs: list[Column], size: int = C.BLOCK, ny: int | None = None, nx: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Aggregates over size x size blocks: keys, by, bx; with ny and nx, cells beyond the last whole block are dropped."""
    if ny is not None and nx is not None:
        rows = rows.where((F.col("iy") < ny // size * size) & (F.col("ix") < nx // size * size))
    return rows.groupBy(*(keys or []), F.floor(F.col("iy") / size).cast("int").alias("by"), F.floor(F.col("ix") / size).cast("int").alias("bx")).agg(*aggs)


def neighbourhood(rows: DataFrame, values: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """keys, iy, ix and for each of values <v>_mean and <v>_std over the cells within radius (in cells); nulls don't count, none is null.

    rows must be dense. A disc is a stack of row intervals: sums over intervals of a row are running windows, one for
    each width, and only 2 * radius + 1 rows of partial sums per cell are then added, whatever the disc's area.
    """
    keys = keys or []
    n = int(radius)
    width = {dy: int(math.sqrt(radius * radius - dy * dy)) for dy in range(-n, n + 1)}
    w = Window.partitionBy(*keys, "iy").orderBy("ix")
    parts = {}
    for half in sorted(set(width.values())):
        over = w.rangeBetween(-half, half)
        fields = [x for v in values for x in (F.coalesce(F.sum(v).over(over), F.lit(0.0)).alias(f"{v}_s"), F.coalesce(F.sum(F.col(v) * F.col(v)).over(over), F.lit(0.0)).alias(f"{v}_q"), F.count(v).over(over).alias(f"{v}_n"))]
        parts[half] = F.struct(*fields)
    wide = rows.select(*keys, "iy", "ix", *(c.alias(f"w{h}") for h, c in parts.items()))
    each = F.array(*(F.struct(F.lit(dy).alias("dy"), F.col(f"w{h}").alias("w")) for dy, h in width.items()))
    spread = wide.select(*keys, "iy", "ix", F.explode(each).alias("e")).select(*keys, (F.col("iy") - F.col("e.dy")).alias("iy"), "ix", "e.w.*")
    sums = spread.groupBy(*keys, "iy", "ix").agg(*(F.sum(f"{v}_{k}").alias(f"{v}_{k}") for v in values for k in "sqn"))
    out = []
    for v in values:
        count = F.col(f"{v}_n")
        mean = F.when(count > 0, F.col(f"{v}_s") / count)
        out += [mean.alias(f"{v}_mean"), F.when(count > 0, F.sqrt(F.greatest(F.col(f"{v}_q") / count - mean * mean, F.lit(0.0)))).alias(f"{v}_std")]
    return rows.select(*keys, "iy", "ix").join(sums, [*keys, "iy", "ix"]).select(*keys, "iy", "ix", *out)


def _difference(v: str, along: str, keys: list[str], step: float) -> Column:
    across = "iy" if along == "ix" else "ix"
    w = Window.partitionBy(*keys, across).orderBy(along)
    before, after = F.lag(along).over(w), F.lead(along).over(w)
    lo = F.when(before.isNull(), F.col(v)).otherwise(F.lag(v).over(w))
    hi = F.when(after.isNull(), F.col(v)).otherwise(F.lead(v).over(w))
    span = (F.coalesce(after, F.col(along)) - F.coalesce(before, F.col(along))) * F.lit(step)
    return (hi - lo) / span


def gradients(rows: DataFrame, values: list[str], step: float, keys: list[str] | None = None) -> DataFrame:
    """rows with <v>_dx (along ix) and <v>_dy (along iy): central differences, one-sided at the edges of the dense grid."""
    keys = keys or []
    return rows.select("*", *(_difference(v, "ix", keys, step).alias(f"{v}_dx") for v in values)).select("*", *(_difference(v, "iy", keys, step).alias(f"{v}_dy") for v in values))


def wind_fields(rows: DataFrame, u: str, v: str, step: float, keys: list[str] | None = None, coriolis: Column | None = None) -> DataFrame:
    """rows with div, conv (its negative part), vort (absolute if coriolis is given), stretch, shear and deformation of a wind."""
    g = gradients(rows, [u, v], step, keys)
    ux, uy, vx, vy = (F.col(c) for c in (f"{u}_dx", f"{u}_dy", f"{v}_dx", f"{v}_dy"))
    vort = vx - uy if coriolis is None else vx - uy + coriolis
    return g.withColumns({"div": ux + vy, "conv": F.greatest(-(ux + vy), F.lit(0.0)), "vort": vort, "stretch": ux - vy, "shear": vx + uy, "deformation": F.sqrt(F.pow(ux - vy, 2) + F.pow(vx + uy, 2))})


def slope_aspect(rows: DataFrame, elevation: str, step: float) -> DataFrame:
    """rows with the terrain's slope and the sine and cosine of the direction it faces."""
    g = gradients(rows, [elevation], step)
    gx, gy = F.col(f"{elevation}_dx"), F.col(f"{elevation}_dy")
    aspect = F.atan2(-gy, -gx)
    return g.withColumns({"slope": F.sqrt(gx * gx + gy * gy), "aspect_sin": F.sin(aspect), "aspect_cos": F.cos(aspect)})


def unit(u: Column, v: Column) -> tuple[Column, Column]:
    """Direction of a motion; a length below 1e-3 counts as 1e-3."""
    length = F.greatest(F.sqrt(u * u + v * v), F.lit(1e-3))
    return u / length, v / length


def directional(rows: DataFrame, field: str, u: str, v: str, radius: float, ny: int, nx: int, keys: list[str] | None = None) -> DataFrame:
    """keys, iy, ix, forward, leftward, straddling: differences of bilinear samples ahead, behind, left and right of a cell's motion, radius cells away.

    Samples beyond the edge take the edge's value; one that touches a null is null. A cell without a motion has no row. The 16 corners of a cell meet the grid in one equi-join.
    """
    keys = keys or []
    du, dv = unit(F.col(u), F.col(v))
    r = F.lit(radius)
    sides = {"ahead": (r * dv, r * du), "behind": (-r * dv, -r * du), "left": (r * du, -r * dv), "right": (-r * du, r * dv)}
    clamp = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))
    places = F.array(*(F.struct(F.lit(name).alias("side"), clamp(F.col("iy") + dy, ny).alias("y"), clamp(F.col("ix") + dx, nx).alias("x")) for name, (dy, dx) in sides.items()))
    # greatest and least pass over nulls: without a motion they would name a place.
    samples = rows.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(*keys, "iy", "ix", F.explode(places).alias("p")).select(*keys, "iy", "ix", "p.*")
    samples = samples.withColumns({"y0": F.floor("y"), "x0": F.floor("x"), "fy": F.col("y") - F.floor("y"), "fx": F.col("x") - F.floor("x")})
    corner = F.explode(F.array(*(F.struct(F.lit(ky).alias("ky"), F.lit(kx).alias("kx")) for ky in (0, 1) for kx in (0, 1)))).alias("k")
    part = lambda k, f: F.when(F.col(k) == 1, F.col(f)).otherwise(1 - F.col(f))
    asked = samples.select(*keys, "iy", "ix", "side", "y0", "x0", "fy", "fx", corner)
    asked = asked.select(*keys, "iy", "ix", "side", F.least(F.col("y0") + F.col("k.ky"), F.lit(ny - 1)).cast("int").alias("sy"), F.least(F.col("x0") + F.col("k.kx"), F.lit(nx - 1)).cast("int").alias("sx"), (part("k.ky", "fy") * part("k.kx", "fx")).alias("weight"))
    source = rows.select(*keys, F.col("iy").alias("sy"), F.col("ix").alias("sx"), F.col(field).alias("__f"))
    hit = asked.join(source, [*keys, "sy", "sx"])
    one = lambda s: F.when(F.count(F.when((F.col("side") == s) & F.col("__f").isNotNull(), 1)) == 4, F.sum(F.when(F.col("side") == s, F.col("weight") * F.col("__f")))).alias(s)
    s = hit.groupBy(*keys, "iy", "ix").agg(*map(one, sides))
    a, b, l, t = (F.col(c) for c in sides)  # noqa: E741
    return s.select(*keys, "iy", "ix", (a - b).alias("forward"), (l - t).alias("leftward"), ((a + b) - (l + t)).alias("straddling"))


def kernel(sigma: float) -> list[float]:
    """Gaussian weights to 4 sigma, which sum to 1."""
    n = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    return [x / sum(raw) for x in raw]


def _pass(rows: DataFrame, values: list[str], sigma: float, along: str, keys: list[str], edge: str) -> DataFrame:
    """One direction of the smoothing: a line of the grid is one row with an array, so the kernel needs no join."""
    across = "iy" if along == "ix" else "ix"
    n = int(4 * sigma + 0.5)
    lines = rows.groupBy(*keys, across).agg(F.array_sort(F.collect_list(F.struct(along, *values))).alias("line"))
    ker = F.array(*map(F.lit, kernel(sigma)))
    size = F.size("line")

    def smooth(v: str) -> Column:
        def at(i: Column, k: Column) -> Column:
            j = i + k - n
            if edge == "nearest":
                return F.col("line")[F.greatest(F.lit(0), F.least(size - 1, j))][v]
            return F.when(j.between(0, size - 1), F.col("line")[F.greatest(F.lit(0), F.least(size - 1, j))][v]).otherwise(F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * n)), F.lit(0.0), lambda s, k: s + ker[k] * at(i, k)))

    done = lines.select(*keys, across, F.transform("line", lambda s: s[along]).alias("__at"), *(smooth(v).alias(v) for v in values))
    return done.select(*keys, across, F.explode(F.arrays_zip(F.col("__at").alias(along), *values)).alias("z")).select(*keys, across, f"z.{along}", *(f"z.{v}" for v in values))


def gaussian(rows: DataFrame, values: list[str], sigma: float, keys: list[str] | None = None, edge: str = "nearest") -> DataFrame:
    """keys, iy, ix and values smoothed; edge: 'nearest' repeats the edge, 'zero' has zeros beyond. rows must be dense and without nulls."""
    keys = keys or []
    if sigma <= 0:
        return rows.select(*keys, "iy", "ix", *values)
    return _pass(_pass(rows, values, sigma, "ix", keys, edge), values, sigma, "iy", keys, edge)


def median_of_smooths(rows: DataFrame, value: str, keys: list[str] | None = None, radii: tuple[float, ...] = C.SMOOTH_RADII_MI) -> DataFrame:
    """keys, iy, ix, value: the median of the field as it is and smoothed at each radius."""
    keys = keys or []
    out = rows.select(*keys, "iy", "ix", F.col(value).alias("__0"))
    for k, r in enumerate(radii[1:], 1):
        out = out.join(gaussian(rows.select(*keys, "iy", "ix", value), [value], C.cells(r), keys).withColumnRenamed(value, f"__{k}"), [*keys, "iy", "ix"])
    ordered = F.array_sort(F.array(*(F.col(f"__{k}") for k in range(len(radii)))))
    return out.select(*keys, "iy", "ix", ordered[len(radii) // 2].alias(value))


def renormalised(dist: Column) -> Column:
    """A distribution divided by its sum, if that is above zero."""
    total = F.aggregate(dist, F.lit(0.0), lambda s, v: s + v)
    return F.transform(dist, lambda v: F.when(total > 0, v / total).otherwise(v))
