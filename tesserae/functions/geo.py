"""Geometry: projection, cells, distances, densified lines, points in polygons. Column expressions throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Projected x and y in metres."""
    rho = F.lit(C.EARTH_RADIUS * C.LCC_F) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(C.CONE))
    theta = F.lit(C.CONE) * F.radians(lon - F.lit(C.ORIGIN_LON))
    return rho * F.sin(theta), F.lit(C.RHO0) - rho * F.cos(theta)


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of projected metres."""
    dy = F.lit(C.RHO0) - y
    rho = F.sqrt(x * x + dy * dy)
    lat = F.degrees(2 * F.atan(F.pow(F.lit(C.EARTH_RADIUS * C.LCC_F) / rho, F.lit(1 / C.CONE))) - F.lit(math.pi / 2))
    return lat, F.lit(C.ORIGIN_LON) + F.degrees(F.atan2(x, dy) / F.lit(C.CONE))


def cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(iy, ix) of the nearest cell centre, half to even; not clipped."""
    x, y = project(lat, lon)
    return F.rint((y - F.lit(C.Y0)) / F.lit(C.DX)).cast("int"), F.rint((x - F.lit(C.X0)) / F.lit(C.DX)).cast("int")


def in_domain(iy: Column, ix: Column, ny: int = C.NY, nx: int = C.NX) -> Column:
    return iy.between(0, ny - 1) & ix.between(0, nx - 1)


def cell_centre(iy: Column, ix: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    return unproject(F.lit(C.X0) + ix * F.lit(C.DX), F.lit(C.Y0) + iy * F.lit(C.DX))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = C.HAVERSINE_STORM_MI) -> Column:
    """Great-circle distance in the unit of radius; storms use miles of 3958.8, fires kilometres of 6371 turned to miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def fire_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, C.HAVERSINE_FIRE_KM) / F.lit(C.MI_TO_KM)


def linspace(a: Column, b: Column, n: Column) -> Column:
    """n evenly spaced values from a to b, as an array."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: a + (b - a) * i.cast("double") / F.greatest(n - 1, F.lit(1)).cast("double"))


def segment_points(length_km: Column, step_km: float = 5.0) -> Column:
    """How many points a segment is densified to: one per step, both ends at least."""
    return F.greatest(F.lit(2), F.floor(length_km / F.lit(step_km)).cast("int") + 1)


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule; ring: array of structs x, y, with the first point not repeated."""
    n = F.size(ring)

    def crossing(acc: Column, i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % n]
        hit = ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return acc + F.coalesce(hit, F.lit(False)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crossing) % 2 == 1


def ring_sample(ring: Column, most: int) -> Column:
    """At most so many vertices of a ring, evenly strided, and their mean point."""
    step = F.greatest(F.lit(1), F.ceil(F.size(ring) / F.lit(float(most))).cast("int"))
    kept = F.filter(ring, lambda _, i: i % step == 0)
    mean = F.struct(*((F.aggregate(ring, F.lit(0.0), lambda s, p, c=c: s + p[c]) / F.size(ring)).alias(c) for c in ("x", "y")))
    return F.concat(kept, F.array(mean))


def in_view(lat: Column, lon: Column, extent: tuple[float, float, float, float]) -> Column:
    """Whether a place is in an extent (west, east, south, north, all included); one with west above east goes over the date line. Places that are unknown are in none."""
    west, east, south, north = extent
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce(across & lat.between(south, north) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))
