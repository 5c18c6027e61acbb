"""Importance resampling of documents towards the word n-grams of a target.

Words are found by a byte automaton over the UTF-8 buffer of an Arrow column: a lookup table classifies all bytes of a batch,
differences of the classes give the words' bounds, and a table-driven CRC-32 advances over all words at once, one
byte place a step. The CRC of a run of words goes on from the state that the run without its last word has
reached, so that no n-gram is ever built as a string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, slices, spread

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, once A-Z are in lower case: digits, a-z and all of other characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
FRESH = np.uint32(0xFFFFFFFF)
#: With fewer words than this still unread, each goes on alone: a few very long words don't hold up the others.
LANES = 24


@dataclass
class Words:
    """The words of a batch of texts: data is all bytes in lower case; word i is size[i] bytes from start[i], in text of[i]."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    of: np.ndarray
    texts: int


def words_of(column: pa.Array, in_word: np.ndarray = IN_WORD) -> Words:
    """Of an Arrow column of strings; a null counts as empty. in_word: which bytes of the text in lower case are in words."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    low = LOWER[raw]
    inside = in_word[low]
    # A text's end cuts a word too: nothing stands between two texts in the buffer.
    cut = np.zeros(len(low) + 1, bool)
    cut[at] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before[: len(inside)] | cut[:-1]))
    end = np.flatnonzero(inside & (~after[: len(inside)] | cut[1:])) + 1
    return Words(low, start, end - start, np.searchsorted(at, start, "right") - 1, len(column))


def advance(data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC states (uint32, not inverted) that state becomes over size bytes of data from start, for all places at once."""
    order = np.argsort(-size, kind="stable")
    at, s, n = start[order], state[order], size[order]
    most = int(n[0]) if len(n) else 0
    live = len(n)
    for k in range(most):
        live = int(np.searchsorted(-n[:live], -k, "left"))  # those with more than k bytes stand first
        if live < LANES:
            for i in range(live):
                rest = data[at[i] + k : at[i] + n[i]]
                s[i] = zlib.crc32(rest, int(s[i] ^ FRESH)) ^ 0xFFFFFFFF
            break
        x = s[:live]
        s[:live] = CRC[(x ^ data[at[:live] + k]) & 255] ^ (x >> 8)
    out = np.empty_like(s)
    out[order] = s
    return out


def ngram_buckets(w: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each run of 1 to longest consecutive words, joined by one space: CRC-32 modulo buckets."""
    found, texts = [], []
    state = np.full(len(w.start), FRESH, np.uint32)
    start, size, of = w.start, w.size, w.of
    for n in range(1, longest + 1):
        if n > 1:  # runs go on to the next word of their text, behind a space
            goes_on = of[: len(state)] == np.concatenate([of[n - 1 :], np.full(min(n - 1, len(of)), -1)])[: len(state)]
            state = np.where(goes_on, CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8), state)
            last = np.minimum(np.arange(len(state)) + n - 1, max(0, len(start) - 1))
            state = advance(w.data, start[last], np.where(goes_on, size[last], 0), state)
            found.append(((state ^ FRESH) % np.uint32(buckets))[goes_on].astype(np.int64))
            texts.append(of[goes_on])
        else:
            state = advance(w.data, start, size, state)
            found.append(((state ^ FRESH) % np.uint32(buckets)).astype(np.int64))
            texts.append(of)
    return np.concatenate(found), np.concatenate(texts)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs among the n-grams of all rows of texts (text): summed within tasks, then over them; buckets numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            total += np.bincount(ngram_buckets(words_of(b.column("text")), longest, buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in spread(texts.select("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to that in the corpus, both with one more in every bucket; rounded down."""
    b = len(own)
    s, t = float(own.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(own, target, strict=True)], np.int64)


def weighted(docs: DataFrame, id_col: str, gains: np.ndarray, longest: int) -> DataFrame:
    """id_col, n_words, n_features, weight (the mean gain of the text's n-grams, rounded down; none: 0) of each row of docs (id_col, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, shipped = to_arrow_type(docs.schema[id_col].dataType), docs.sparkSession.sparkContext.broadcast(gains)  # a number for each bucket
    schema = pa.schema([(id_col, kind), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for b in slices(batches):
            w = words_of(b.column("text"))
            bucket, text = ngram_buckets(w, longest, len(gain))
            n = np.bincount(text, minlength=w.texts)
            total = np.zeros(w.texts, np.int64)
            np.add.at(total, text, gain[bucket])
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.bincount(w.of, minlength=w.texts), pa.int64()), pa.array(n, pa.int64()), pa.array(mean, pa.int64())], schema=schema)

    return spread(docs.select(id_col, "text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """Thousandths of a standard Gumbel number that the id fixes, rounded down; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, id_col: str, eligible: Column, percent: int) -> DataFrame:
    """scored (id_col, score long) with rank: 1, 2, 3... over the percent (rounded down) of the eligible rows that score highest, ties to the smaller id; else null.

    Scores are thousandths of logarithms, so that their distinct values are bounded however many rows there are: at most some 10^5 numbers
    and counts come to the driver. A row's rank is the count of those above its score and its place among its equals.
    Equal rows (id and score) share out their ranks in any order. Rows below the last score that is drawn aren't sorted.
    """
    counts = scored.where(eligible).groupBy("score").count().collect()
    counts.sort(key=lambda r: -r.score)
    wanted, above, starts = sum(r["count"] for r in counts) * percent // 100, 0, []
    for r in counts:
        if above >= wanted:
            break
        starts.append((r.score, above))
        above += r["count"]
    least = starts[-1][0] if starts else None
    before = scored.sparkSession.createDataFrame(starts, "score long, above long")
    from pyspark.sql import Window

    drawn = F.coalesce(eligible & (F.col("score") >= F.lit(least).cast("long")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    top = scored.where(drawn).join(F.broadcast(before), "score").withColumn("rank", (F.col("above") + place).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= F.lit(wanted), F.col("rank")))
    return top.select(*scored.columns, "rank").unionByName(scored.where(~drawn).select("*", F.lit(None).cast("long").alias("rank")))


def importance_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", percent: int = 25, longest: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7) -> DataFrame:
    """id_col, n_words, n_features, weight, score, rank of every row of docs (id_col, text), for the texts of target (text).

    weight is the mean over a text's n-grams (repeats counted) of their buckets' log ratios, score is weight plus the id's Gumbel number, so that
    the highest scores are a draw without replacement in proportion to exp(weight / 1000). Only texts with least_words words are drawn.
    Null, empty and wordless texts have no features, weight 0 and no rank (unless least_words is 0); texts of any length are read whole.
    A null id counts as the empty text in the Gumbel number and comes last among ties; repeated rows are drawn one by one. An empty
    docs gives an empty result, an empty target equal shares for all buckets. Columns other than id_col and text are not read.
    """
    with scratch(docs.sparkSession) as keep:
        gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
        made = weighted(docs.select(F.col(id_col).alias("id"), "text"), "id", gains, longest)
        scored = keep(materialize(made.withColumn("score", F.col("weight") + gumbel("id", seed)), "resample-scored"))
        return ranked(scored, "id", F.col("n_words") >= least_words, percent).withColumnRenamed("id", id_col)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings: int) -> DataFrame:
    """The rows of docs that importance_ranks draws, with all their columns. Rows that share an id go together: they stay if one of them is drawn. A null id is never drawn here."""
    drawn = importance_ranks(docs, target, id_col, **settings).where("rank IS NOT NULL").select(F.col(id_col).alias(id_col)).distinct()
    return docs.join(drawn, id_col, "left_semi").select(*docs.columns)


#: DuckDB. CRC-32 byte by byte over each distinct feature, with a table made by its rule.
RESAMPLE_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS crc FROM (SELECT b::BIGINT AS b FROM range(256) r(b))),
texts AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
hashed AS (
  SELECT g, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams), tab),
counts AS (
  SELECT b.bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN (SELECT side, bucket FROM grams JOIN hashed USING (g)) USING (bucket) GROUP BY b.bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s::DOUBLE + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
found AS (
  SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM grams JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT d.id AS doc_id, len(d.w) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words d LEFT JOIN found USING (id) WHERE side = 'd'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY n >= 20) // 100 AS wanted FROM scored)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN n >= 20 AND place <= wanted THEN place END::BIGINT AS rank FROM placed
"""
