"""The whole feature row of a storm sample: columns of air, the fields around them, and means and motion-relative gradients of both.

The columns' own features need no neighbour and are made where the rows are. All that needs neighbours is made scene by
scene: one shuffle brings a scene's cells together, whose number is that of the grid, and leaves as one array of floats a
cell in the order of the catalogue. So a training matrix that keeps one cell in forty makes only that cell's thousands of values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import grid, physics

#: Metres of the length that surface gradients are given for. Fixed value.
PER = 1e5
#: Radius of the terrain's texture, and levels of the differential divergence. Fixed values.
TEXTURE_MI, DIFFERENTIAL = 25.0, (250, 850)
#: Fields that are worked on at once, and cells whose rows leave together.
FIELDS_AT_ONCE, CELLS_AT_ONCE = 32, 2048


def terrain(elevation: DataFrame, step: float = C.DX, radius: float | None = None) -> DataFrame:
    """iy, ix and the terrain fields of a dense grid of elevations (iy, ix, elev): gradients, slope, aspect, place above and texture of the surroundings."""
    r = C.cells(TEXTURE_MI) if radius is None else radius
    base = grid.slope_aspect(elevation.select("iy", "ix", F.col("elev").cast("double").alias("elev")), "elev", step).withColumnsRenamed({"elev_dx": "elev_gradx", "elev_dy": "elev_grady"})
    near = grid.neighbourhood(base.select("iy", "ix", "elev", "slope"), ["elev", "slope"], r)
    out = base.join(near, ["iy", "ix"]).withColumns({"tpi": F.col("elev") - F.col("elev_mean"), "tri": F.col("elev_std")})
    return out.select("iy", "ix", *physics.TERRAIN)


def kinematics(winds: dict[int, tuple[np.ndarray, np.ndarray]], lat: np.ndarray, step: float) -> dict[str, np.ndarray]:
    """Divergence, convergence and absolute vorticity of the wind (2-D) of each level, and divergence above less that below."""
    out = {}
    spin = 2 * C.OMEGA * np.sin(np.radians(lat))
    for mb, (u, v) in winds.items():
        (uy, ux), (vy, vx) = np.gradient(u, step), np.gradient(v, step)
        out |= {f"mb{mb}_div": ux + vy, f"mb{mb}_conv": np.maximum(-(ux + vy), 0), f"mb{mb}_absvort": vx - uy + spin}
    above, below = DIFFERENTIAL
    return out | {f"diffdiv_{above}_{below}": out[f"mb{above}_div"] - out[f"mb{below}_div"]}


def boundaries(surface: dict[str, np.ndarray], step: float) -> dict[str, np.ndarray]:
    """Gradients of the surface fields (2-D), for 100 km, and convergence, vorticity and deformation of the surface wind."""
    out = {}
    for name, field in surface.items():
        gy, gx = (g * PER for g in np.gradient(field, step))
        out |= {f"bnd_{name}_gradx": gx, f"bnd_{name}_grady": gy}
        if name in ("t2m", "td2m"):
            out[f"bnd_{name}_gradmag"] = np.hypot(gx, gy)
    ux, uy, vx, vy = (out[f"bnd_{c}_grad{d}"] for c in ("u10", "v10") for d in "xy")
    stretch, shear = ux - vy, vx + uy
    return out | {"bnd_conv10": np.maximum(-(ux + vy), 0), "bnd_vort10": vx - uy, "bnd_def_stretch": stretch, "bnd_def_shear": shear, "bnd_def10": np.hypot(stretch, shear)}


def disc_means(fields: np.ndarray, radius: float) -> np.ndarray:
    """Means (f, ny, nx) over the cells within radius that have a value; NaN where none has. A disc is a stack of row intervals of running sums."""
    f, ny, nx = fields.shape
    there = np.isfinite(fields)
    run = np.zeros((2, f, ny, nx + 1))
    np.cumsum(np.where(there, fields, 0), 2, out=run[0, :, :, 1:])
    np.cumsum(there, 2, out=run[1, :, :, 1:])
    total, x = np.zeros((2, f, ny, nx)), np.arange(nx)
    for dy in range(-int(radius), int(radius) + 1):
        if abs(dy) >= ny:
            continue
        half = int(np.sqrt(radius * radius - dy * dy))
        own, other = slice(max(0, -dy), ny - max(0, dy)), slice(max(0, dy), ny - max(0, -dy))
        total[:, :, own] += run[:, :, other, np.minimum(x + half + 1, nx)] - run[:, :, other, np.maximum(x - half, 0)]
    return np.divide(total[0], total[1], out=np.full((f, ny, nx), np.nan), where=total[1] > 0)


def _samples(y: np.ndarray, x: np.ndarray, ny: int, nx: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (4, k) in the flat grid and weights of bilinear samples; beyond the edge counts the edge."""
    y, x = np.clip(y, 0, ny - 1), np.clip(x, 0, nx - 1)
    y0, x0 = np.nan_to_num(np.floor(y)).astype(int), np.nan_to_num(np.floor(x)).astype(int)
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    return np.stack([y0 * nx + x0, y0 * nx + x1, y1 * nx + x0, y1 * nx + x1]), np.stack([(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx])


def motion_gradients(means: np.ndarray, iy: np.ndarray, ix: np.ndarray, u: np.ndarray, v: np.ndarray, radius: float) -> dict[str, np.ndarray]:
    """Forward, leftward and straddling differences (f, k) of means (f, ny, nx) at cells (k) that move with u, v, radius cells away."""
    f, ny, nx = means.shape
    length = np.maximum(np.hypot(u, v), 1e-3)
    du, dv, flat = radius * u / length, radius * v / length, means.reshape(f, -1)

    def at(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
        place, weight = _samples(iy + dy, ix + dx, ny, nx)
        return np.einsum("fck,ck->fk", flat[:, place], weight)

    ahead, behind, left, right = at(dv, du), at(-dv, -du), at(du, -dv), at(-du, dv)
    return {"forward": ahead - behind, "leftward": left - right, "straddling": ahead + behind - left - right}


def _scene(get: dict[str, np.ndarray], iy: np.ndarray, ix: np.ndarray, wanted: np.ndarray, lat: np.ndarray, ny: int, nx: int, step: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of wanted cells, their feature rows) of one scene's cells."""
    place = iy * nx + ix

    def on_grid(x: np.ndarray) -> np.ndarray:
        out = np.full(ny * nx, np.nan)
        out[place] = x
        return out.reshape(ny, nx)

    own = kinematics({mb: (on_grid(get[f"u_{mb}mb"]), on_grid(get[f"v_{mb}mb"])) for mb in map(int, C.KINEMATIC_LEVELS)}, on_grid(lat), step)
    own |= boundaries({k: on_grid(get[f"sfc_{k}"]) for k in ("t2m", "td2m", "u10", "v10")}, step)
    raw = lambda n: own[n] if n in own else on_grid(get[n])
    index = {n: i for i, n in enumerate(physics.catalogue())}
    first, by_motion = physics.tiers()
    moves = [*[(n, C.MOTIONS) for n in first], *[(n, (m,)) for m, names in by_motion.items() for n in names]]
    chosen = np.flatnonzero(wanted)
    out = np.full((len(chosen), len(index)), np.nan, np.float32)
    cy, cx = iy[chosen], ix[chosen]
    for n in (n for family in physics.raw_names().values() for n in family):
        out[:, index[n]] = own[n][cy, cx] if n in own else get[n][chosen]
    for a in range(0, len(moves), FIELDS_AT_ONCE):
        part = moves[a : a + FIELDS_AT_ONCE]
        fields = np.stack([raw(n) for n, _ in part])
        for r in C.RADII_MI:
            means = disc_means(fields, C.cells(r))
            for k, (n, _) in enumerate(part):
                out[:, index[f"{n}_mean{r:g}"]] = means[k, cy, cx]
            for m in C.MOTIONS:
                mine = [k for k, (_, ms) in enumerate(part) if m in ms]
                for b in range(0, len(chosen) if mine else 0, CELLS_AT_ONCE):
                    s = slice(b, b + CELLS_AT_ONCE)
                    found = motion_gradients(means[mine], cy[s], cx[s], get[f"motion_{m}_u"][chosen[s]], get[f"motion_{m}_v"][chosen[s]], C.cells(r))
                    for g, x in found.items():
                        for j, k in enumerate(mine):
                            out[s, index[f"{part[k][0]}_mean{r:g}_{m}_{g}"]] = x[j]
    for b in range(0, len(chosen), CELLS_AT_ONCE):
        yield chosen[b : b + CELLS_AT_ONCE], out[b : b + CELLS_AT_ONCE]


def scene_features(cells: DataFrame, scene: str, ny: int = C.NY, nx: int = C.NX, step: float = C.DX, wanted: Column | None = None) -> DataFrame:
    """scene, iy, ix, features (array of floats in the order of physics.catalogue()) of the cells for which wanted holds, or all.

    cells: a row for each cell of a scene with scene, iy, ix, lat, the arrays and surface values of physics.column_features, and those of the
    surface scalars, exceedance probabilities, terrain and solar fields that there are; others are NaN. Cells that a scene lacks count as missing
    in its means, and cells outside ny x nx take no part. Of rows of one cell the last in no stated order counts.
    """
    given = [n for f in ("surface", "probability", "terrain", "solar") for n in physics.raw_names()[f] if n in cells.columns]
    rows = cells.where(F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1))
    rows = rows.withColumn("__wanted", F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False)))
    columns = physics.column_features(rows, [scene, "iy", "ix", "lat", "__wanted", *given], scene)
    kind = dict(cells.dtypes)[scene]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([pa.field(scene, to_arrow_type(cells.schema[scene].dataType)), pa.field("iy", pa.int32()), pa.field("ix", pa.int32()), pa.field("features", pa.list_(pa.float32()))])
    families = physics.raw_names()
    lacking = {n for f in ("surface", "probability", "terrain", "solar") for n in families[f]} - set(given)

    def finished(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        get = {n: t.column(n).to_numpy().astype(np.float64) for n in t.column_names if n not in (scene, "iy", "ix", "__wanted")}
        get |= {n: np.full(len(t), np.nan) for n in lacking}
        iy, ix = (t.column(c).to_numpy().astype(np.int64) for c in ("iy", "ix"))
        name = t.column(scene)[0].as_py()
        for places, x in _scene(get, iy, ix, t.column("__wanted").to_numpy(), get["lat"], ny, nx, step):
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), schema.field(0).type), pa.array(iy[places], pa.int32()), pa.array(ix[places], pa.int32()), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            names = t.column(scene).to_pylist()
            start = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[start]:
                    if held and held[0].column(scene)[0].as_py() != names[start]:
                        yield from finished(held)
                        held = []
                    held.append(t.slice(start, i - start))
                    start = i
        if held:
            yield from finished(held)

    return columns.repartition(scene).sortWithinPartitions(scene).mapInArrow(run, f"`{scene}` {kind}, iy int, ix int, features array<float>")


def named(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """keep and the named features of rows as columns."""
    index = {n: i for i, n in enumerate(physics.catalogue())}
    return rows.select(*keep, *(F.col("features")[index[n]].alias(n) for n in names))
