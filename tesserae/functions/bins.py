"""Bins and lookup tables as column expressions; -1 stands for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def by_hazard(hazard: Column, made: dict[str, Column]) -> Column:
    """The expression of a row's hazard; null for others."""
    out = F.lit(None)
    for h, c in made.items():
        out = F.when(hazard == h, c).otherwise(out)
    return out


def edges_at_or_below(value: Column, edges: tuple[float, ...] | list[float]) -> Column:
    """Number of edges not above value."""
    return sum((F.when(value >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))


def intensity_bin(hazard: str, value: Column) -> Column:
    """The last edge not above value; -1 below the first and for null or NaN. Ratings are capped at the last bin."""
    edges = C.INTENSITY_EDGES[hazard]
    return F.when(value.isNull() | F.isnan(value.cast("double")), -1).otherwise(edges_at_or_below(value, edges) - 1)


def size_bin(acres: Column) -> Column:
    """The fire size's bin, clipped to the first and last; null stays null."""
    n = len(C.INTENSITY_EDGES["wildfire"])
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), edges_at_or_below(acres, C.INTENSITY_EDGES["wildfire"]) - 1))


def pib_bin(hazard: str, value: Column) -> Column:
    """Peak-intensity bin: 0 below the first edge; -1 for null, NaN and what isn't above zero."""
    sound = value.isNotNull() & ~F.isnan(value.cast("double")) & (value > 0)
    return F.when(sound, edges_at_or_below(value, C.PIB_EDGES[hazard])).otherwise(-1)


def is_severe(hazard: Column, magnitude: Column) -> Column:
    """Every tornado; others from the severe threshold on."""
    return (hazard == "tor") | by_hazard(hazard, {h: magnitude >= F.lit(t) for h, t in C.SEVERE.items()})


def is_significant(hazard: Column, magnitude: Column, ef: Column) -> Column:
    """From the significant threshold on; false for an unknown rating."""
    tor = (ef >= 0) & (ef >= int(C.SIGNIFICANT["tor"]))
    return by_hazard(hazard, {"tor": tor} | {h: magnitude >= F.lit(t) for h, t in C.SIGNIFICANT.items() if h != "tor"})


def cig_index(hazard: str, severity: Column) -> Column:
    """0 to 3, by the midpoints of the reference severities."""
    return edges_at_or_below(severity, C.cig_edges(hazard))


def category(hazard: str, percent: Column, cig: Column) -> Column:
    """The table's category; -1 below its lowest probability."""
    clipped = F.greatest(F.lit(0), F.least(F.lit(3), cig)).cast("int")
    out = F.lit(-1)
    for least, row in C.CATEGORY_TABLE[hazard]:
        out = F.when(percent >= F.lit(least), F.element_at(F.array(*map(F.lit, row)), clipped + 1)).otherwise(out)
    return out


def threat_mask(hazard: str, p: Column, value: Column, outside: float) -> Column:
    """value where the probability reaches the lowest contour."""
    return F.when(p >= F.lit(C.PROB_LEVELS[hazard][0]), value).otherwise(F.lit(outside))


def edge_labels(edges: tuple[float, ...]) -> list[str]:
    """Display names of the bins between edges: 'a-b', the last open."""
    return [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)] + [f"{edges[-1]:g}+"]
