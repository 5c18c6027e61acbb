"""Features of vertical columns as an operator on rows with arrays of levels, and the catalogue of feature names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import soundings

FIELDS = ("tmp", "dpt", "ugrd", "vgrd", "hgt", "vvel")
SURFACE = ("psfc", "zsfc", "t2m", "td2m", "u10", "v10")
#: Fixed names of surface scalars that pass through, of thermodynamic and kinematic fields.
SURFACE_SCALARS = ("hrrr_sbcape", "hrrr_sbcin", "hrrr_mlcape90", "hrrr_mlcin90", "hrrr_mlcape180", "hrrr_mlcin180", "soilw", "tsoil", "pwat", "lcdc", "mcdc", "hcdc", "tcdc", "crain", "cfrzr", "cicep", "csnow", "relv01", "relv02")
TERRAIN = ("elev", "slope", "elev_gradx", "elev_grady", "aspect_sin", "aspect_cos", "tpi", "tri", "elev_std", "slope_std")
SOLAR = ("solar_cos_zen", "solar_alt", "solar_toa", "solar_ghi")
GRADIENTS = ("forward", "leftward", "straddling")


def _names() -> list[str]:
    """What column_features gives, from one made-up column."""
    levels = np.array([C.FETCH_LEVELS], float)
    fields = {f: np.linspace(280, 220, levels.shape[1])[None] for f in FIELDS}
    fields["hgt"] = np.linspace(0, 16000, levels.shape[1])[None]
    surface = {s: np.array([v]) for s, v in zip(SURFACE, (1000.0, 0.0, 290.0, 285.0, 5.0, 5.0), strict=True)}
    return [*soundings.column_features(levels, fields, surface, 1000.0)]


def _values(column: pa.Array, at: np.ndarray, depth: int) -> np.ndarray:
    """Rows at of a column as numbers (n,), or of a column of lists (n, depth)."""
    taken = column.take(pa.array(at))
    if not pa.types.is_list(taken.type):
        return taken.to_numpy(zero_copy_only=False).astype(float)
    return taken.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), depth)


def column_features(columns: DataFrame, keys: list[str], scene: str, levels: str = "level") -> DataFrame:
    """keys and the features of each row's column. columns: scene, level and FIELDS (arrays, pressure falling), SURFACE (numbers).

    The pressure axis of the parcels starts at the scene's highest surface pressure, so that is summed up first. Rows with a null
    in the surface values or a null array have NaN features.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    highest = columns.groupBy(scene).agg(F.max("psfc").alias("highest"))
    rows = columns.join(highest, scene).select(*keys, "highest", levels, *FIELDS, *SURFACE)
    names = _names()
    schema = pa.schema([pa.field(k, to_arrow_type(columns.schema[k].dataType)) for k in keys] + [pa.field(n, pa.float32()) for n in names])
    kinds = dict(columns.dtypes)
    ddl = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{n}` float" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = {c: b.column(c) for c in b.schema.names}
            n = len(b)
            sound = np.ones(n, bool)
            for c in (levels, *FIELDS, *SURFACE, "highest"):
                sound &= get[c].is_valid().to_numpy(zero_copy_only=False)
            out = {k: np.full(n, np.nan, np.float32) for k in names}
            highest = get["highest"].to_numpy(zero_copy_only=False)
            depth = pc.fill_null(pc.list_value_length(get[levels]), -1).to_numpy()
            for top, k in {(t, d) for t, d, s in zip(highest, depth, sound, strict=True) if s}:
                at = np.flatnonzero(sound & (highest == top) & (depth == k))
                stack = lambda c, at=at, k=k: _values(get[c], at, int(k))
                made = soundings.column_features(stack(levels), {f: stack(f) for f in FIELDS}, {s: stack(s) for s in SURFACE}, float(top))
                for name, v in made.items():
                    out[name][at] = v
            yield pa.RecordBatch.from_arrays([*(get[k] for k in keys), *(pa.array(out[k]) for k in names)], schema=schema)

    return rows.mapInArrow(run, ddl)


def raw_names() -> dict[str, list[str]]:
    """Names of the raw features of a storm sample by family."""
    layers = [n for n, _, _ in C.SR_LAYERS]
    partial = [f"{p}{e}{d}" for p in ("sb", "ml") for e in ("cape", "cin") for d in ("", "_0_90", "_0_180")]
    return {
        "motion": [f"motion_{m}_{c}" for m in C.MOTIONS for c in ("u", "v", "spd")],
        "thermo": [*partial, "dcape"],
        "storm_relative": [f"{m}_{a}_{k}" for m in C.MOTIONS for a in layers for k in ("srh", "swv", "swfrac", "srw_u", "srw_v", "srw_spd")],
        "hodograph": [f"{m}_{c}{h:g}" for m in C.MOTIONS for h in C.HODOGRAPH_HEIGHTS for c in "uv"],
        "kinematic": [f"mb{p:g}_{k}" for p in C.KINEMATIC_LEVELS for k in ("div", "conv", "absvort")] + ["diffdiv_250_850"],
        "profile": [f"{k}_d{d:g}" for d in C.PROFILE_DEPTHS for k in ("tmp", "dpt", "tdspread", "vvel")],
        "lapse": [f"lapse_{n}" for n, _, _ in C.LAPSE_LAYERS],
        "boundary": [f"bnd_{f}_{k}" for f in ("t2m", "td2m") for k in ("gradx", "grady", "gradmag")] + [f"bnd_{f}_{k}" for f in ("u10", "v10") for k in ("gradx", "grady")] + [f"bnd_{k}" for k in ("conv10", "vort10", "def_stretch", "def_shear", "def10")],
        "height": [f"hgt_{p:g}mb" for p in C.MANDATORY_LEVELS],
        "level": [f"{k}_{p:g}mb" for p in C.KINEMATIC_LEVELS for k in ("tmp", "dpt", "tdspread")],
        "surface": [*SURFACE_SCALARS],
        "state": [f"sfc_{k}" for k in ("t2m", "td2m", "u10", "v10", "wspd10", "tdspread2m")] + [f"sfc_{c}_{m}_rot" for m in C.MOTIONS for c in "uv"],
        "probability": [f"prob_{v}_{t}" for v, ts in C.EXCEEDANCE.items() for t in ts],
        "terrain": [*TERRAIN],
        "solar": [*SOLAR],
    }


def tiers() -> tuple[list[str], dict[str, list[str]]]:
    """Names that get means and gradients along all motions; and by motion those that get them along their own."""
    raw = raw_names()
    first = raw["thermo"] + ["pwat"] + raw["kinematic"] + [n for n in raw["level"] if not n.startswith("tdspread")] + raw["lapse"] + raw["boundary"] + raw["probability"] + raw["terrain"]
    own = {m: [n for n in raw["storm_relative"] if n.startswith(f"{m}_") and n.endswith(("_srh", "_srw_spd", "_swfrac", "_swv"))] + [n for n in raw["hodograph"] if n.startswith(f"{m}_")] for m in C.MOTIONS}
    return first, own


def catalogue() -> list[str]:
    """All feature names of a storm sample, sorted: the contract of the training matrix."""
    first, own = tiers()
    out = [n for family in raw_names().values() for n in family]
    for names, moves in [(first, C.MOTIONS), *((n, (m,)) for m, n in own.items())]:
        for n in names:
            for r in C.RADII_MI:
                out.append(f"{n}_mean{r:g}")
                out += [f"{n}_mean{r:g}_{m}_{g}" for m in moves for g in GRADIENTS]
    return sorted(out)


def expanded(field_grids: DataFrame, field: str, motions: dict[str, tuple[str, str]], ny: int, nx: int, keys: list[str] | None = None) -> DataFrame:
    """keys, iy, ix, <field>_mean<r> and, for each motion (its u and v columns), the gradients of each mean along it."""
    from . import grid

    keys = keys or []
    out = field_grids.select(*keys, "iy", "ix")
    for r in C.RADII_MI:
        mean = f"{field}_mean{r:g}"
        m = grid.neighbourhood(field_grids, [field], C.cells(r), keys).select(*keys, "iy", "ix", F.col(f"{field}_mean").alias(mean))
        out = out.join(m, [*keys, "iy", "ix"])
        for name, (u, v) in motions.items():
            moved = m.join(field_grids.select(*keys, "iy", "ix", u, v), [*keys, "iy", "ix"])
            d = grid.directional(moved, mean, u, v, C.cells(r), ny, nx, keys)
            out = out.join(d.select(*keys, "iy", "ix", *(F.col(g).alias(f"{mean}_{name}_{g}") for g in GRADIENTS)), [*keys, "iy", "ix"], "left")
    return out


#: Fixed names of the fire sample's fields.
FIRE_MOTIONS = ("none", "mean_wind")
FIRE_SURFACE = (*SURFACE_SCALARS[:13], "refc", "refd", "uh03", "uh25")
FIRE_STATIC = ("elev", "slope", "elev_gradx", "elev_grady", "aspect_sin", "aspect_cos", "tri", "tpi", "slope_std", "elev_std", "lu_forest", "lu_shrub", "lu_grass", "lu_crop", "lu_urban", "lu_water", "popdens", "popdens_log")


def fire_catalogue() -> list[str]:
    """All feature names of a fire sample, sorted: the same families with two frames of motion, one of which stands still."""
    storm = raw_names()
    layers = [n for n, _, _ in C.SR_LAYERS]
    relative = {m: [f"{m}_{a}_{k}" for a in layers for k in ("srh", "swv", "swfrac", "srw_u", "srw_v", "srw_spd")] for m in FIRE_MOTIONS}
    hodographs = {m: [f"{m}_{c}{h:g}" for h in C.HODOGRAPH_HEIGHTS for c in "uv"] for m in FIRE_MOTIONS}
    state = [f"sfc_{k}" for k in ("t2m", "td2m", "u10", "v10", "wspd10", "tdspread2m")]
    raw = [f"motion_{m}_{c}" for m in FIRE_MOTIONS for c in ("u", "v", "spd")] + storm["thermo"] + storm["kinematic"] + storm["profile"] + storm["height"] + storm["level"] + [*FIRE_SURFACE, *FIRE_STATIC] + state
    raw += [n for m in FIRE_MOTIONS for n in (*relative[m], *hodographs[m], f"sfc_u_{m}_rot", f"sfc_v_{m}_rot")]
    base = storm["thermo"] + ["pwat"] + storm["kinematic"] + ["soilw", "tsoil", "lcdc", "mcdc", "hcdc", "tcdc", "sfc_t2m", "sfc_td2m", "sfc_tdspread2m", "sfc_wspd10", "refc", "refd", "uh03", "uh25"]
    first = base + [n for n in storm["level"] if not n.startswith("tdspread")] + [*FIRE_STATIC]
    own = {m: [n for n in relative[m] if n.endswith(("_srh", "_srw_spd", "_swfrac", "_swv"))] + hodographs[m] for m in FIRE_MOTIONS}
    out = [*raw]
    for names, moves in [(first, FIRE_MOTIONS), *((n, (m,)) for m, n in own.items())]:
        out += [f"{n}_mean{r:g}{s}" for n in names for r in C.RADII_MI for s in ("", *(f"_{m}_{g}" for m in moves for g in GRADIENTS))]
    return sorted(out)
