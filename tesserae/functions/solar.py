"""Solar geometry and clear-sky radiation as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# Fourier series of declination (radians) and of the equation of time (minutes): constant, then cosine and sine of 1, 2, 3 times the year's angle.
DECLINATION = (0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))
EQUATION = (0.000075, (0.001868, -0.032077), (-0.014615, -0.040849))
EQUATION_MINUTES = 229.18


def _series(terms: tuple, angle: Column) -> Column:
    out = F.lit(terms[0])
    for k, (a, b) in enumerate(terms[1:], 1):
        out = out + F.lit(a) * F.cos(k * angle) + F.lit(b) * F.sin(k * angle)
    return out


def position(time: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """cos_zen (0 below the horizon), altitude in degrees, toa and ghi in W/m2 for a UTC time and a place."""
    doy = F.dayofyear(time)
    angle = F.lit(2 * math.pi / 365) * (doy - 1 + (F.hour(time) - 12) / F.lit(24.0))
    decl = _series(DECLINATION, angle)
    minutes = F.hour(time) * 60 + F.minute(time) + F.second(time) / F.lit(60.0) + F.lit(EQUATION_MINUTES) * _series(EQUATION, angle) + 4 * lon
    ha = F.radians(F.pmod(minutes, F.lit(1440.0)) / 4 - 180)
    cz = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(ha)
    cz = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cz))
    up = F.greatest(cz, F.lit(0.0))
    toa = F.lit(C.SOLAR) * (1 + F.lit(0.033) * F.cos(F.lit(2 * math.pi) * doy / 365)) * up
    return {"cos_zen": up, "altitude": F.degrees(F.asin(cz)), "toa": toa, "ghi": F.when(up > 0, 1098 * up * F.exp(F.lit(-0.059) / up)).otherwise(F.lit(0.0))}
