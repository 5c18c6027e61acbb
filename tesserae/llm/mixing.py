"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a 36-bit number from a hash. Per source, the words are summed by the first 12
bits; the bucket in which the budget runs out is summed by the next 12, and so again. The three
digits are the source's threshold: documents below it are taken, without a sort. Thresholds are
nested: a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, spread

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
LEVELS, DIGIT_BITS = 3, 12


def word_count(text: str) -> Column:
    """Number of matches of WORD; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def number(id_col: str, text: str) -> Column:
    """A 36-bit number of a row: the first nine hex digits of an MD5, so that any engine can redo it."""
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), own).cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size, one row each) with target.

    Sources by code point, null last, weigh weights, repeating, and share share times all sizes. A target stops at most times
    its source's size; the excess is shared again by weight until none is above. In closed form: the targets are
    min(most * size, level * weight), where the level follows from the sources in order of the level at which each stops.
    """
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, all_rows = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    open_to = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level with the sources before stopped and this one not yet; the first such row that doesn't stop has the true one.
    level = ranked.withColumn("level", open_to).withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"])
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _edge(slim: DataFrame, budgets: DataFrame, digits: str) -> DataFrame:
    """budgets (source, whole, left) with at: the value of slim's column digits at which left words of the source run out, left: what is left
    of them there, words and n: the words and rows of that value. LEVELS histograms, of which each refines one bucket of the one before."""
    state = budgets.select("source", "whole", "left", F.lit(0).cast("long").alias("at"))
    for level in range(LEVELS):
        rest = DIGIT_BITS * (LEVELS - 1 - level)
        s = state.select(F.col("source").alias("s"), "left", "at")
        rows = slim.join(s, _same("source", "s")).where(F.shiftright(digits, rest + DIGIT_BITS) == F.col("at"))
        hist = rows.groupBy("s", F.shiftright(digits, rest).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"))
        w = Window.partitionBy("s").orderBy("bucket")
        run = hist.withColumn("through", F.sum("words").over(w)).withColumn("last", F.max("bucket").over(Window.partitionBy("s")))
        # The bucket in which the budget runs out; the last one, if rounding leaves none.
        edge = run.where((F.col("through") > F.col("left")) | (F.col("bucket") == F.col("last"))).groupBy("s").agg(F.min(F.struct("bucket", "through", "words", "n", "left")).alias("e"))
        edge = edge.select("s", F.col("e.bucket").alias("at_"), (F.col("e.left") - (F.col("e.through") - F.col("e.words"))).alias("left_"), F.col("e.words").alias("words_"), F.col("e.n").alias("n_"))
        found = state.select("source", "whole").join(edge, _same("source", "s"), "left")
        state = materialize(found.select("source", "whole", F.coalesce("left_", F.lit(0.0)).alias("left"), F.coalesce("at_", F.lit(0)).alias("at"), F.coalesce("words_", F.lit(0)).alias("words"), F.coalesce("n_", F.lit(0)).alias("n")), "mix-level")
    return state


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, whole, budget) with below and tie_below: rows of the source whose number is smaller than below, or is below and whose
    tie is smaller than tie_below, are taken once more than whole.

    slim: source, size, number, tie. budget words of the source, less than all, are wanted; the last row is included if that
    comes nearer to the budget. Rows that repeat have one number: only where such rows stand at the threshold, they are told apart by tie.
    """
    state = _edge(slim, budgets.select("source", "whole", F.col("budget").alias("left")), "number")
    nearer = F.when((F.col("words") > 0) & (2 * F.col("left") >= F.col("words")), 1).otherwise(0)
    if (state.agg(F.max("n")).first()[0] or 0) < 2:
        return state.select("source", "whole", (F.col("at") + nearer).alias("below"), F.lit(0).cast("long").alias("tie_below"))
    edge = state.select(F.col("source").alias("s"), F.col("at").alias("below"))
    tied = slim.join(edge, _same("source", "s")).where("number = below").select("source", "size", "tie")
    ties = _edge(tied, state.select("source", "whole", "left"), "tie").select("source", "whole", (F.col("at") + nearer).alias("tie_below"))
    return ties.join(edge, _same("source", "s")).select("source", "whole", "below", "tie_below")


def source_plan(slim: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """s (the source), source_size, target, whole, below, tie_below of each source of slim (source, size, number, tie)."""
    per_source = materialize(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = per_source.select("source", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    cut = thresholds(slim, budgets).withColumnRenamed("source", "s")
    # A table of its own: its size is then known, and texts need no shuffle to meet it if it is small.
    return materialize(per_source.join(cut, _same("source", "s")).select("s", "source_size", "target", "whole", "below", "tie_below"), "mix-plan", 1)


def _tie() -> Column:
    """A 36-bit number of a row's place in the input; of use once it is written to a table."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), F.monotonically_increasing_id()), 64 - LEVELS * DIGIT_BITS)


def _slim(docs: DataFrame, id_col: str) -> DataFrame:
    docs = spread(docs.select(id_col, "source", "text"))
    return materialize(docs.select(F.col(id_col).alias("id"), "source", word_count("text").alias("size"), number(id_col, "text").alias("number"), _tie().alias("tie")), "mix-slim")


def times() -> Column:
    """How often the mix takes a row of number, tie, whole, below and tie_below."""
    inside = (F.col("number") < F.col("below")) | (F.col("number") == F.col("below")) & (F.col("tie") < F.col("tie_below"))
    return F.col("whole") + F.when(inside, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """id_col, source, size, source_size, target, taken of every row of docs (id_col, text, source).

    taken: words that the mix takes of the row, which is its size times 0, 1 or 2 (up to most).
    A null source is a source like any other, the last; null and empty texts have size 0 and take 0, very long ones are counted whole; of rows that
    agree in id and text, as many are taken as the budget asks for, and reruns agree in their number; an empty table gives an empty one.
    Other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        slim = keep(_slim(docs, id_col))
        joined = slim.join(keep(source_plan(slim, share, most, weights)), _same("source", "s"))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with the columns of docs, whatever they are called; rows without words are not taken.

    Null, empty, repeated rows and empty tables: as mix.
    """
    with scratch(docs.sparkSession) as keep:
        plan = source_plan(_slim(docs, id_col), share, most, weights)
        held = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("of"), word_count("text").alias("size"), number(id_col, "text").alias("number"), F.lit(0).cast("long").alias("tie"))
        if plan.where("tie_below > 0").limit(1).count():
            # Rows that repeat stand at a threshold: their ties need a copy of the rows that keeps its order.
            copy = keep(materialize(docs.select(F.struct(*docs.columns).alias("row"), _tie().alias("tie")), "mix-rows"))
            inner = copy.select(*(F.col("row").getField(c).alias(n) for c, n in ((id_col, "id"), ("source", "of"), ("text", "text"))), "row", "tie")
            held = inner.select("row", "of", word_count("text").alias("size"), number("id", "text").alias("number"), "tie")
            plan = source_plan(held.select(F.col("of").alias("source"), "size", "number", "tie"), share, most, weights)
        keep(plan)
    taken = held.where("size > 0").join(plan, _same("of", "s")).select("row", times().cast("int").alias("n"))
    return taken.where("n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")


#: DuckDB: exact running sums instead of histograms.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:9])::BIGINT AS number
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * sum(size) AS cap
  FROM d GROUP BY source),
o AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM o WHERE level * weight <= cap) * weight, cap)) AS target FROM o),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (
  SELECT source, number, sum(size)::BIGINT AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY number) AS through FROM d GROUP BY source, number),
e AS (
  SELECT g.source, number, 2 * (target - whole * source_size - (through - words)) >= words AND words > 0 AND target - whole * source_size >= through - words AS inside
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, d.source, size, source_size, target, size * (whole + CASE WHEN inside THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.number = e.number
"""
