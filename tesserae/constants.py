"""The constants that define the semantics: grid, thresholds, bins, lookup tables."""

from __future__ import annotations

import math

# ---- Fixed values, as published with the forecasts that this engine reproduces. ----

#: Spherical Lambert conformal conic with one standard parallel; degrees and metres.
EARTH_RADIUS = 6_371_229.0
PARALLEL, ORIGIN_LAT, ORIGIN_LON = 38.5, 38.5, -97.5
SW_LAT, SW_LON = 21.138123, -122.719528
NATIVE_NX, NATIVE_NY, NATIVE_DX = 1799, 1059, 3000.0
BLOCK = 5

MI_TO_KM = 1.609344
KT_TO_MPH = 1.15077945
#: Radii of the earth in the two great-circle distances.
HAVERSINE_STORM_MI = 3958.8
HAVERSINE_FIRE_KM = 6371.0

HAZARDS = ("tor", "wind", "hail")
RADII_MI = (25.0, 50.0, 100.0)
NEIGHBOURHOOD_MI, NEIGHBOURHOOD_MINUTES = 25.0, 30
SMOOTH_RADII_MI = (0.0, 25.0, 50.0)

SEVERE = {"tor": 0.0, "wind": 50.0, "hail": 1.0}
SIGNIFICANT = {"tor": 2.0, "wind": 65.0, "hail": 2.0}
INTENSITY_EDGES = {
    "tor": (0.0, 1.0, 2.0, 3.0, 4.0),
    "wind": (50.0, 56.0, 65.0, 74.0, 83.0),
    "hail": (1.0, 1.5, 2.0, 3.5),
    "wildfire": (0.0, 50.0, 100.0, 500.0, 1000.0, 2500.0, 5000.0),
}
PIB_EDGES = {
    "tor": (85.0, 100.0, 120.0, 140.0, 155.0, 175.0),
    "wind": (55.0, 65.0, 75.0, 85.0, 95.0, 110.0),
    "hail": (1.0, 1.5, 2.0, 2.75, 3.5, 5.0),
}
CIG_NAMES = ("<CIG1", "CIG1", "CIG2", "CIG3")
CIG_REFERENCE = {
    "tor": ((61.0, 32.0, 6.0, 1.0, 0.1), (42.0, 37.0, 14.0, 5.0, 1.0), (36.0, 33.0, 18.0, 9.0, 3.0), (31.0, 28.0, 22.0, 14.0, 5.0)),
    "wind": ((74.0, 20.0, 5.0, 1.0, 0.1), (55.0, 31.0, 10.0, 2.0, 1.0), (44.0, 33.0, 17.0, 4.0, 2.0), (33.0, 34.0, 23.0, 7.0, 4.0)),
    "hail": ((65.0, 27.0, 8.0, 0.1), (51.0, 32.0, 15.0, 2.0), (40.0, 35.0, 20.0, 5.0), (29.0, 38.0, 25.0, 8.0)),
    "wildfire": ((60.0, 18.0, 12.0, 5.0, 3.0, 1.5, 0.5), (38.0, 22.0, 20.0, 10.0, 6.0, 3.0, 1.0), (18.0, 17.0, 25.0, 18.0, 12.0, 7.0, 3.0), (6.0, 9.0, 17.0, 20.0, 20.0, 16.0, 12.0)),
}
#: (least probability in percent, category for CIG 0 to 3).
CATEGORY_TABLE = {
    "tor": ((1.0, (0, 1, 1, 2)), (2.0, (1, 1, 2, 2)), (5.0, (2, 2, 3, 3)), (10.0, (2, 3, 3, 3)), (15.0, (3, 3, 4, 4)), (30.0, (3, 4, 5, 5)), (45.0, (3, 4, 5, 5)), (60.0, (3, 5, 5, 5))),
    "wind": ((2.0, (0, 1, 1, 2)), (5.0, (1, 1, 2, 2)), (15.0, (2, 2, 3, 3)), (30.0, (2, 3, 3, 4)), (45.0, (3, 3, 4, 5)), (60.0, (3, 4, 5, 5)), (75.0, (3, 4, 5, 5)), (90.0, (3, 4, 5, 5))),
    "hail": ((2.0, (0, 1, 1, 2)), (5.0, (1, 1, 2, 2)), (15.0, (2, 2, 3, 3)), (30.0, (2, 3, 3, 4)), (45.0, (3, 3, 4, 5)), (60.0, (3, 4, 4, 5))),
    "wildfire": ((2.0, (0, 1, 1, 2)), (5.0, (1, 1, 2, 2)), (10.0, (1, 2, 2, 3)), (20.0, (2, 2, 3, 3)), (35.0, (2, 3, 3, 3)), (50.0, (3, 3, 3, 3)), (75.0, (3, 3, 3, 3))),
}
CATEGORY_NAMES = ("TSTM", "MRGL", "SLGT", "ENH", "MDT", "HIGH")
FIRE_CATEGORY_NAMES = ("NONE", "ELEVATED", "CRITICAL", "EXTREME")
PROB_LEVELS = {
    "tor": (0.01, 0.02, 0.05, 0.10, 0.15, 0.30, 0.45, 0.60),
    "wind": (0.02, 0.05, 0.15, 0.30, 0.45, 0.60, 0.75, 0.90),
    "hail": (0.02, 0.05, 0.15, 0.30, 0.45, 0.60),
    "wildfire": (0.02, 0.05, 0.10, 0.20, 0.35, 0.50, 0.75),
}
EXCEEDANCE = {"refc": (10, 20, 30, 40, 50), "refd": (30, 40, 50), "uh03": (25, 75, 150), "uh25": (25, 75, 150, 300)}
MEMBERS, LONG_CYCLES, LONG_HOURS, SHORT_HOURS = 6, (0, 6, 12, 18), 48, 18
PROFILE_DEPTHS = (0.0, 25.0, 50.0, 75.0, 100.0, 125.0, 150.0, 200.0, 250.0, 300.0, 350.0, 400.0, 450.0, 500.0, 600.0, 700.0)
FETCH_LEVELS = (1000, 975, 950, 925, 900, 875, 850, 825, 800, 775, 750, 725, 700, 600, 500, 400, 300, 200, 100)
KINEMATIC_LEVELS = (925.0, 850.0, 500.0, 250.0)
MANDATORY_LEVELS = (925.0, 850.0, 700.0, 500.0, 300.0, 250.0, 200.0, 150.0, 100.0)
HODOGRAPH_HEIGHTS = (0.0, 250.0, 500.0, 750.0, 1000.0, 1500.0, 2000.0, 3000.0, 4000.0, 5000.0, 6000.0)
MOTIONS = ("bunkers_rm", "bunkers_lm", "mean_0_6km", "corfidi_up", "corfidi_down")
SR_LAYERS = (("0_500m", 0.0, 500.0), ("500_1000m", 500.0, 1000.0), ("1_3km", 1000.0, 3000.0), ("3_6km", 3000.0, 6000.0))
LAPSE_LAYERS = (*SR_LAYERS, ("6_9km", 6000.0, 9000.0))
PARTIAL_DEPTHS = (90.0, 180.0)
PRESCRIBED_TOKENS = (" RX", "RX ", "PRESCRIBED", "BROADCAST BURN", "PILE BURN")
TILTS = (-1.0, 0.0, 1.0, 2.0)
#: Physics: gas constants, heat capacity, latent heat, gravity, earth's rotation, solar constant.
RD, RV, CP, LV, G, OMEGA, SOLAR = 287.04, 461.5, 1005.7, 2.501e6, 9.81, 7.292e-5, 1361.0

# ---- Derived. ----

EPS = RD / RV
NX, NY, DX = NATIVE_NX // BLOCK, NATIVE_NY // BLOCK, NATIVE_DX * BLOCK
_phi = math.radians(PARALLEL)
CONE = math.sin(_phi)
LCC_F = math.cos(_phi) * math.tan(math.pi / 4 + _phi / 2) ** CONE / CONE
RHO0 = EARTH_RADIUS * LCC_F / math.tan(math.pi / 4 + math.radians(ORIGIN_LAT) / 2) ** CONE


def lcc_xy(lat: float, lon: float) -> tuple[float, float]:
    """Projected metres of a point, on the driver."""
    rho = EARTH_RADIUS * LCC_F / math.tan(math.pi / 4 + math.radians(lat) / 2) ** CONE
    theta = CONE * math.radians(lon - ORIGIN_LON)
    return rho * math.sin(theta), RHO0 - rho * math.cos(theta)


_sw = lcc_xy(SW_LAT, SW_LON)
#: Centre of the first cell: the mean of the first BLOCK native points.
X0, Y0 = (v + NATIVE_DX * (BLOCK - 1) / 2 for v in _sw)


def cells(miles: float) -> float:
    """A radius in cells."""
    return miles * MI_TO_KM * 1000.0 / DX


def stencil(miles: float) -> list[tuple[int, int]]:
    """(dy, dx) of the cells within a radius of a cell."""
    r = cells(miles)
    n = int(r)
    return [(dy, dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dy * dy + dx * dx <= r * r]


def severities(hazard: str) -> list[float]:
    """Expected bin of each reference distribution."""
    return [sum(i * p for i, p in enumerate(ref)) / sum(ref) for ref in CIG_REFERENCE[hazard]]


def cig_edges(hazard: str) -> list[float]:
    """Midpoints between the severities of consecutive references."""
    s = severities(hazard)
    return [(a + b) / 2 for a, b in zip(s, s[1:], strict=False)]


def lead_band(fxx: int) -> str:
    """Name of the 6-hour band of a lead time from 1 to 48."""
    first = (fxx - 1) // 6 * 6 + 1
    return f"f{first}_{first + 5}"
