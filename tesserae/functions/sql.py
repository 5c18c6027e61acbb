"""The library's functions under names that SQL can use: SQL functions of the session, which Catalyst expands into the query, so that nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import constants as C

PREFIX = "tess_"


def _cases(hazard: str, made: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {hazard} " + " ".join(f"WHEN '{h}' THEN {x}" for h, x in made.items()) + f" ELSE {other} END"


def _edges_below(value: str, edges) -> str:
    return "(" + " + ".join(f"CASE WHEN {value} >= {float(e)!r}D THEN 1 ELSE 0 END" for e in edges) + ")"


def _bin(hazard: str) -> str:
    return f"CASE WHEN value IS NULL OR isnan(value) THEN -1 ELSE {_edges_below('value', C.INTENSITY_EDGES[hazard])} - 1 END"


def _pib(hazard: str) -> str:
    return f"CASE WHEN value > 0 AND NOT isnan(value) THEN {_edges_below('value', C.PIB_EDGES[hazard])} ELSE -1 END"


def _category(hazard: str) -> str:
    rows = sorted(C.CATEGORY_TABLE[hazard], reverse=True)
    return "CASE " + " ".join(f"WHEN percent >= {least!r}D THEN element_at(array({', '.join(map(str, row))}), greatest(0, least(3, cig)) + 1)" for least, row in rows) + " ELSE -1 END"


def _total(array: str) -> str:
    return f"aggregate({array}, 0D, (s, v) -> s + v)"


#: Scalars: name, arguments, result, body.
SCALARS = [
    ("haversine", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", f"{2 * C.HAVERSINE_STORM_MI!r}D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    ("lead_band", "fxx INT", "STRING", "CASE WHEN fxx BETWEEN 1 AND 48 THEN concat('f', CAST(floor((fxx - 1) / 6) * 6 + 1 AS STRING), '_', CAST(floor((fxx - 1) / 6) * 6 + 6 AS STRING)) END"),
    ("split", "t TIMESTAMP", "STRING", "CASE weekday(t) WHEN 5 THEN 'validation' WHEN 6 THEN 'test' ELSE 'train' END"),
    ("convective_day", "t TIMESTAMP", "TIMESTAMP", "date_trunc('DAY', t - INTERVAL 12 HOURS) + INTERVAL 12 HOURS"),
    ("intensity_bin", "hazard STRING, value DOUBLE", "INT", _cases("hazard", {h: _bin(h) for h in C.INTENSITY_EDGES})),
    ("pib_bin", "hazard STRING, value DOUBLE", "INT", _cases("hazard", {h: _pib(h) for h in C.PIB_EDGES})),
    ("category", "hazard STRING, percent DOUBLE, cig INT", "INT", _cases("hazard", {h: _category(h) for h in C.CATEGORY_TABLE})),
    ("cig", "hazard STRING, severity DOUBLE", "INT", _cases("hazard", {h: _edges_below("severity", C.cig_edges(h)) for h in C.CIG_REFERENCE})),
    ("expected_bin", "dist ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {_total('dist')} > 0 THEN {_total('transform(dist, (v, i) -> v * i)')} / {_total('dist')} ELSE 0D END"),
    ("modal_bin", "dist ARRAY<DOUBLE>", "INT", f"CASE WHEN {_total('transform(dist, v -> coalesce(nanvl(v, 0D), 0D))')} > 0 THEN CAST(array_position(transform(dist, v -> coalesce(nanvl(v, 0D), 0D)), array_max(transform(dist, v -> coalesce(nanvl(v, 0D), 0D)))) AS INT) - 1 ELSE -1 END"),
    ("threshold_text", "p DOUBLE", "STRING", "format_string('%.2f', p)"),
    ("percent_name", "name STRING, threshold DOUBLE", "STRING", "concat(name, '_ge', CAST(CAST(threshold AS INT) AS STRING))"),
]

#: A radius in cells.
_R = f"(radius_miles * {C.MI_TO_KM!r}D * 1000D / {float(C.DX)!r}D)"
#: Tables: name, arguments, columns, query.
TABLES = [
    ("stencil", "radius_miles DOUBLE", "dy INT, dx INT", f"SELECT y, x FROM (SELECT explode(sequence(-CAST({_R} AS INT), CAST({_R} AS INT))) AS y) LATERAL VIEW explode(sequence(-CAST({_R} AS INT), CAST({_R} AS INT))) e AS x WHERE y * y + x * x <= {_R} * {_R}"),
    ("densify", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, n INT", "k INT, lat DOUBLE, lon DOUBLE", "SELECT k, lat1 + (lat2 - lat1) * CAST(k AS DOUBLE) / CAST(greatest(n - 1, 1) AS DOUBLE), lon1 + (lon2 - lon1) * CAST(k AS DOUBLE) / CAST(greatest(n - 1, 1) AS DOUBLE) FROM (SELECT explode(sequence(0, n - 1)) AS k)"),
    ("leads", "first INT, last INT, step INT", "fxx INT, band STRING", f"SELECT f, {PREFIX}lead_band(f) FROM (SELECT explode(sequence(first, last, step)) AS f)"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session, under names that begin with PREFIX; gives the names. Doing it again changes nothing."""
    for name, args, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({args}) RETURNS {result} RETURN {body}")
    for name, args, columns, query in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({args}) RETURNS TABLE({columns}) RETURN {query}")
    return [PREFIX + f[0] for f in (*SCALARS, *TABLES)]
