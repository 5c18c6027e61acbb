"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, overfull ranges subdivided.

Rows are ordered by (hash of the text, id, place in the input), so that copies lie together and yet a
group of any size can be cut anywhere. Sampled boundaries deal the order out to many ranges;
the exact totals of the ranges then place each row, so that the result doesn't depend on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unit_hash

#: Ranges to aim at for small inputs; rows of a range for large ones; samples for each range; rounds of subdivision.
RANGES, RANGE_ROWS, SAMPLES, ROUNDS = 256, 500_000, 24, 4
#: A range this many times its share is subdivided.
OVERFULL = 2.0
KEY = ["k1", "k2", "k3"]


def range_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of bounds (m, 3) that are not above each of keys (n, 3), both compared column by column; bounds are sorted."""

    def search(cols: list[np.ndarray], lo: int, hi: int, rows: np.ndarray, k: int) -> None:
        if k == 3 or lo == hi:
            out[rows] = hi
            return
        b = bounds[lo:hi, k]
        v = cols[k][rows]
        left, right = np.searchsorted(b, v, "left"), np.searchsorted(b, v, "right")
        out[rows] = lo + left
        tied = left < right
        for x in np.unique(left[tied]):
            same = tied & (left == x)
            search(cols, lo + int(x), lo + int(right[same][0]), rows[same], k + 1)

    out = np.zeros(len(keys), np.int64)
    search([keys[:, k] for k in range(3)], 0, len(bounds), np.arange(len(keys)), 0)
    return out


def _assign(bounds: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in KEY], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range_of(keys, bounds))], [*names, "range"])

    return run


def _ranged(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    ddl = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(_assign(bounds, rows.columns), f"{ddl}, range long")


def _quantiles(sample: list, want: int) -> list[tuple[int, int, int]]:
    """want - 1 boundaries (or fewer) at equal shares of the sample's weight; sample: rows of the key and n, the times each counts."""
    sample = sorted(sample, key=lambda r: (r.k1, r.k2, r.k3))
    total, seen, out = sum(r.n for r in sample), 0, []
    for r in sample:
        if len(out) + 1 < want and seen >= total * (len(out) + 1) / want:
            out.append((r.k1, r.k2, r.k3))
        seen += r.n
    return out


def _sample(rows: DataFrame, per_weight: float, seed: int) -> list:
    """Rows drawn in proportion to their weight, once for each whole draw and by hash for the rest."""
    draws = F.col("weight") * F.lit(per_weight)
    n = F.floor(draws) + F.when(unit_hash(*map(F.col, KEY), seed=seed) < draws - F.floor(draws), 1).otherwise(0)
    return rows.select(*KEY, n.alias("n")).where("n > 0").collect()


def splitters(rows: DataFrame, ranges: int) -> tuple[np.ndarray, DataFrame]:
    """Boundaries, and per range: rows, bytes, weight. rows: KEY, size, weight. The driver holds about SAMPLES keys a range and the ranges' totals."""
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    bounds = np.zeros((0, 3), np.int64)
    if not total:
        return bounds, []
    share = total / ranges
    bounds = np.array(_quantiles(_sample(rows, SAMPLES / share, 11), ranges), np.int64).reshape(-1, 3)
    for k in range(ROUNDS):
        found = _ranged(rows, bounds)
        totals = found.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("weight").alias("weight"), F.min("weight").alias("least")).collect()
        over = {r["range"]: r.weight for r in totals if r.weight > OVERFULL * share and r.n > 1}
        if not over or k == ROUNDS - 1:
            break
        again = found.where(F.col("range").isin([*over])).drop("range")
        again = _ranged(materialize(again, "shard-overfull"), bounds)
        more = []
        drawn: dict[int, list] = {}
        for r, where in ((r, range_of(np.array([[r.k1, r.k2, r.k3]], np.int64), bounds)[0]) for r in _sample(again, 4 * SAMPLES / share, 12 + k)):
            drawn.setdefault(int(where), []).append(r)
        for where, rows_in in drawn.items():
            more += _quantiles(rows_in, int(np.ceil(over.get(where, 0) / share)))
        if not more:
            break
        bounds = np.array(sorted({*map(tuple, bounds.tolist()), *more}), np.int64).reshape(-1, 3)
    return bounds, totals


def shard_by_size(docs: DataFrame, id_col: str = "doc_id", shards: int = 8, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id_col, size, text_crc32, shard, slot of every row of docs (id_col, text).

    size: UTF-8 bytes of the text plus 1 (null: 1). The rows' order is cut where the running size passes a shard's share, so a
    shard's size is within one row of its share; slot counts rows within the shard from 0. Copies lie
    together, and only a group at a cut is split. A null id sorts first, ids that are no integers by a hash of them as text; equal rows keep any order among themselves,
    which no column shows; texts of any length count whole; an empty table gives an empty one. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("k1"))
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    number = F.col("id").cast("long") if whole else F.when(F.col("id").isNotNull(), F.xxhash64(F.col("id").cast("string")))
    slim = slim.select("*", F.coalesce(number, F.lit(-(1 << 63))).alias("k2"), F.monotonically_increasing_id().alias("k3"))
    slim = materialize(slim, "shard-slim")
    n, mean = slim.agg(F.count("*"), F.avg("size")).first()
    rows = slim.withColumn("weight", F.col("size") / F.lit(mean or 1.0) + 1.0)
    bounds, totals = splitters(rows, max(RANGES, -(-n // range_rows)))
    all_bytes, starts, b, r = sum(t.bytes for t in totals), [], 0, 0
    for t in sorted(totals, key=lambda t: t["range"]):
        starts.append((t["range"], b, r))
        b, r = b + t.bytes, r + t.n
    offsets = docs.sparkSession.createDataFrame(starts, "range long, bytes_before long, rows_before long")
    w = Window.partitionBy("range").orderBy(*KEY)
    placed = _ranged(slim, bounds).join(offsets, "range")
    placed = placed.select("id", "size", "text_crc32", (F.col("bytes_before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"), (F.col("rows_before") + F.row_number().over(w) - 1).alias("place"))
    placed = materialize(placed.withColumn("shard", F.expr(f"cast(start * {shards} div {max(1, all_bytes)} as int)")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


#: DuckDB: one running sum over all rows; CRC-32 byte by byte, with a table made by its rule.
SHARD_SQL = """
WITH t AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS crc FROM (SELECT b::BIGINT AS b FROM range(256) r(b))),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, ('0x' || md5(coalesce(text, ''))[1:15])::BIGINT AS k,
         xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM documents, t),
p AS (
  SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, row_number() OVER (ORDER BY k, doc_id NULLS FIRST) - 1 AS place, sum(size) OVER () AS total FROM d),
s AS (SELECT *, (start * 8 // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
