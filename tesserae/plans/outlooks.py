"""Queries over predictions: categories, distributions, training rows, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import bins, columns
from ..operators import dataset, events, products, verify
from ..sources import tables, views
from ..sources.tables import table
from .events import SIZE_SQL, bin_sql, cases, reached
from .registry import query

SEVERITY_SQL = "(SELECT *, CASE WHEN list_sum(dist) > 0 THEN list_sum(list_transform(dist, lambda x, i: x * (i - 1))) / list_sum(dist) ELSE 0 END AS severity FROM v_preds)"
CIG_SQL = cases("hazard", {h: reached("severity", C.cig_edges(h)) for h in C.HAZARDS})


def category_sql(p: str, cig: str) -> str:
    """SQL: the category of a probability and a class."""
    rows = {h: "CASE " + " ".join(f"WHEN {p} * 100 >= {t!r}::DOUBLE THEN [{', '.join(map(str, r))}][{cig} + 1]" for t, r in reversed(C.CATEGORY_TABLE[h])) + " ELSE -1 END" for h in C.HAZARDS}
    return cases("hazard", rows)


@query(f"SELECT fxx, iy, ix, hazard, round(severity, 6) AS severity, cig, {category_sql('p', 'cig')} AS category FROM (SELECT *, {CIG_SQL} AS cig FROM {SEVERITY_SQL})", ["v_preds"])
def cig_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products.with_category(products.with_cig(views.predictions(spark, sf_dir)))
    return p.select("fxx", "iy", "ix", "hazard", F.round("severity", 6).alias("severity"), "cig", "category")


@query(f"SELECT hazard, category, count(*) AS n FROM (SELECT hazard, {category_sql('p', '(iy + ix) % 4')} AS category FROM v_preds) GROUP BY 1, 2", ["v_preds"])
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir).withColumn("cig", (F.col("iy") + F.col("ix")) % 4)
    return products.with_category(p).groupBy("hazard", "category").agg(F.count("*").alias("n"))


QUANTILE_SQL = "list_min(list_filter(list_transform(dist, lambda x, i: CASE WHEN list_sum(dist[1:i]) / list_sum(dist) >= {q} THEN i - 1 END), lambda y: y IS NOT NULL))"


@query(f"SELECT fxx, iy, ix, hazard, {QUANTILE_SQL.format(q=0.5)} AS q50, {QUANTILE_SQL.format(q=0.75)} AS q75, {QUANTILE_SQL.format(q=0.9)} AS q90 FROM v_preds", ["v_preds"])
def quantile_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions(spark, sf_dir).select("fxx", "iy", "ix", "hazard", *(columns.quantile_bin(F.col("dist"), q).cast("long").alias(f"q{int(q * 100)}") for q in (0.5, 0.75, 0.9)))


@query("SELECT fxx, iy, ix, hazard, (list_position(pib, list_max(pib)) - 1)::INT AS modal FROM v_preds", ["v_preds"])
def modal_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions(spark, sf_dir).select("fxx", "iy", "ix", "hazard", columns.modal_bin(F.col("pib")).alias("modal"))


@query("SELECT fxx, iy, ix, hazard, round(list_sum(list_transform(pib, lambda x, i: x * (i - 1))) / list_sum(pib), 6) AS expected FROM v_preds", ["v_preds"])
def expected_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = columns.expected_bin(F.col("pib"), F.lit(None).cast("double"))
    return views.predictions(spark, sf_dir).select("fxx", "iy", "ix", "hazard", F.round(e, 6).alias("expected"))


DAY_SQL = f"(SELECT hazard, iy, ix, max(p) AS p, max(cig) AS cig FROM (SELECT *, {CIG_SQL} AS cig FROM {SEVERITY_SQL}) GROUP BY 1, 2, 3)"


@query(f"SELECT hazard, iy, ix, round(p, 6) AS p, cig, {category_sql('p', 'cig')} AS category FROM {DAY_SQL}", ["v_preds"])
def daymax_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.day_max(views.predictions(spark, sf_dir)).select("hazard", "iy", "ix", F.round("p", 6).alias("p"), "cig", "category")


@query(f"SELECT iy, ix, max({category_sql('p', 'cig')}) AS category FROM {DAY_SQL} GROUP BY 1, 2", ["v_preds"])
def combined_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.combined(views.predictions(spark, sf_dir))


def share_sql(key: str, seed: int = 0) -> str:
    """hashed_share in SQL."""
    return f"('0x' || md5('{seed}:' || ({key}))[1:13])::BIGINT / 4503599627370496::DOUBLE"


BANDS = {"b0": (0.9, 0.1), "b1": (1.1, -0.05), "b2": (1.0, 0.0)}


@query(", s AS (SELECT hazard, iy, ix, 'b' || (fxx % 3) AS band, avg(p) AS p FROM v_preds GROUP BY 1, 2, 3, 4), c AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q, CASE band WHEN 'b0' THEN 0.9 WHEN 'b1' THEN 1.1 ELSE 1.0 END::DOUBLE AS a, CASE band WHEN 'b0' THEN 0.1 WHEN 'b1' THEN -0.05 ELSE 0.0 END::DOUBLE AS b FROM s) SELECT hazard, iy, ix, round(avg(1 / (1 + exp(-(a * ln(q / (1 - q)) + b)))), 6) AS p FROM c GROUP BY 1, 2, 3", ["v_preds"])
def band_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.predictions(spark, sf_dir).select("hazard", "iy", "ix", F.concat(F.lit("b"), (F.col("fxx") % 3).cast("string")).alias("band"), "p")
    return products.ensemble(scored, ["hazard", "iy", "ix"], BANDS).select("hazard", "iy", "ix", F.round("p", 6).alias("p"))


@query(", s AS (SELECT hazard, i::INT AS bin, sum(coalesce(dist[i + 1], 0) * p) AS s FROM v_preds, range(5) r(i) GROUP BY 1, 2) SELECT hazard, bin, round(s / sum(s) OVER (PARTITION BY hazard), 6) AS share FROM s", ["v_preds"])
def weighted_mean_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir)
    return products.weighted_distribution(p, ["hazard"], 5).select("hazard", "bin", F.round("share", 6).alias("share"))


@query(f"SELECT l_returnflag = 'R' AS positive, count(*) AS n, round(sum(w), 4) AS weight FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 1 / 0.025::DOUBLE END AS w FROM lineitem WHERE l_returnflag = 'R' OR {share_sql('l_orderkey * 8 + l_linenumber')} < 0.025::DOUBLE) GROUP BY 1")
def subsample_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")  # noqa: E741
    positive = F.col("l_returnflag") == "R"
    s = dataset.subsample(l, positive, F.col("l_orderkey") * 8 + F.col("l_linenumber"), 0.025)
    return s.groupBy(positive.alias("positive")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"SELECT bag::INT AS bag, pos, count(*) AS n, sum(CASE WHEN pos THEN 1.0 ELSE 4.0 END)::DOUBLE AS weight FROM (SELECT l_returnflag = 'R' AS pos, floor({share_sql('l_orderkey * 8 + l_linenumber', 1)} * 4)::INT AS own FROM lineitem), range(4) b(bag) WHERE pos OR own = bag GROUP BY 1, 2")
def bag_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), (F.col("l_returnflag") == "R").alias("pos"), F.lit(1.0).alias("weight"))  # noqa: E741
    return dataset.bag(l, F.col("pos"), F.col("key"), 4).groupBy("bag", "pos").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


EDGES = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.28, 0.46, 0.64, 0.82, 1.0]


@query(f"SELECT bin, round(sum(p * w) / sum(w), 6) AS mean_p, round(sum(y * w) / sum(w)::DOUBLE, 6) AS mean_y, sum(w)::BIGINT AS weight FROM (SELECT *, greatest(0, least(9, {reached('p', EDGES)} - 1)) AS bin FROM v_scores) GROUP BY 1", ["v_scores"])
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = verify.reliability(views.scores(spark, sf_dir), EDGES)
    return r.select("bin", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"), "weight")


THRESHOLDS = [round(k / 30, 4) for k in range(1, 31)]


@query(f", t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS t), s AS (SELECT t, sum((p >= t AND y = 1)::INT)::DOUBLE AS a, sum((p >= t)::INT)::DOUBLE AS f, sum(y)::DOUBLE AS o FROM v_scores, t GROUP BY 1) SELECT t AS threshold, round(a / greatest(o, 1), 6) AS pod, round((f - a) / greatest(f, 1), 6) AS far, round(a / greatest(f, 1), 6) AS sr, round(a / greatest(f + o - a, 1), 6) AS csi, round(f / greatest(o, 1), 6) AS bias FROM s", ["v_scores"])
def csi_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = verify.contingency(views.scores(spark, sf_dir), THRESHOLDS)
    return c.select("threshold", *(F.round(n, 6).alias(n) for n in ("pod", "far", "sr", "csi", "bias")))


@query("SELECT round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*) FROM v_scores a, v_scores b WHERE a.y = 1 AND b.y = 0), 6)::DOUBLE AS auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6)::DOUBLE AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM (SELECT p, sum((y = 1)::INT)::DOUBLE AS pos, sum((y = 0)::INT)::DOUBLE AS neg FROM v_scores GROUP BY 1))", ["v_scores"])
def exact_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.exact_auc(views.scores(spark, sf_dir)).select(F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query(", c AS (SELECT hazard, iy, ix, max(p) AS p FROM v_preds GROUP BY 1, 2, 3), s AS (SELECT r.hazard, coalesce(c.p, 0) AS p FROM v_reports r LEFT JOIN c ON c.hazard = r.hazard AND c.iy = (r.event_id % 24) AND c.ix = ((r.event_id * 7) % 32)) SELECT hazard, l AS level, round(100 * avg((p >= l)::INT), 6) AS rate FROM s, (SELECT unnest([0.02, 0.05, 0.15, 0.30])::DOUBLE AS l) GROUP BY 1, 2", ["v_preds", "v_reports"])
def capture_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.predictions(spark, sf_dir).groupBy("hazard", "iy", "ix").agg(F.max("p").alias("p"))
    r = views.reports(spark, sf_dir).select("hazard", (F.col("event_id") % 24).cast("int").alias("iy"), (F.col("event_id") * 7 % 32).cast("int").alias("ix"))
    s = r.join(c, ["hazard", "iy", "ix"], "left")
    return verify.capture(s, [0.02, 0.05, 0.15, 0.30], ["hazard"]).select("hazard", "level", F.round("rate", 6).alias("rate"))


MARGINAL_SQL = f"(SELECT {SIZE_SQL} AS bin, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM v_fires WHERE final_size > 0 GROUP BY 1)"


@query(f"SELECT bin, n, round(share, 6) AS share FROM {MARGINAL_SQL}", ["v_fires"])
def marginal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.size_marginal(views.fires(spark, sf_dir), "final_size").select("bin", "n", F.round("share", 6).alias("share"))


@query(f"SELECT tilt, bin, round_even(100 * w / sum(w) OVER (PARTITION BY tilt), 2) AS percent FROM (SELECT t AS tilt, bin, share * exp(t * bin) AS w FROM {MARGINAL_SQL}, (SELECT unnest([-1.0, 0.0, 1.0, 2.0])::DOUBLE AS t))", ["v_fires"])
def tilt_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.reference_tilts(dataset.size_marginal(views.fires(spark, sf_dir), "final_size"))


@query("SELECT h AS hour, hazard, count(event_id) AS n FROM (SELECT * FROM range(24) r(h), (SELECT DISTINCT hazard FROM v_reports)) s LEFT JOIN (SELECT event_id, hazard, hour(time) AS h FROM v_reports) USING (h, hazard) GROUP BY 1, 2", ["v_reports"])
def report_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reports(spark, sf_dir)
    h = verify.histogram(r, F.hour("time"), "hour", list(range(24)), ["hazard"])
    return h.select(F.col("hour").cast("long").alias("hour"), "hazard", "n")


@query(f"SELECT fxx, hazard, bin, n FROM (SELECT (1 + event_id % 48)::INT AS fxx, hazard, {bin_sql()} AS bin FROM v_reports), LATERAL (SELECT 1 AS n) z WHERE bin >= 0 QUALIFY count(*) OVER (PARTITION BY hazard) >= 50 AND min(bin) OVER (PARTITION BY hazard) < max(bin) OVER (PARTITION BY hazard)", ["v_reports"])
def sized_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events.with_severity(views.reports(spark, sf_dir)).select((1 + F.col("event_id") % 48).cast("int").alias("fxx"), "hazard", "bin", F.lit(1).alias("flag"))
    return dataset.sized_positives(r, "flag", "bin", keys=["hazard"]).select("fxx", "hazard", "bin", F.lit(1).alias("n"))


@query("SELECT DISTINCT 'f' || a || '_' || (a + 5) AS band FROM (SELECT (1 + l_orderkey % 30 - 1) // 6 * 6 + 1 AS a FROM lineitem WHERE isodow(l_shipdate) < 6)")
def populated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import times

    l = table(spark, sf_dir, "lineitem").select((1 + F.col("l_orderkey") % 30).alias("fxx"), times.split(F.col("l_shipdate")).alias("split"))  # noqa: E741
    return dataset.populated_bands(l)


@query(f"SELECT fxx, hazard, iy, ix, round(CASE WHEN p >= level THEN p ELSE 0 END, 6) AS p, CASE WHEN p >= level THEN {CIG_SQL} ELSE -1 END AS cig FROM (SELECT *, {cases('hazard', {h: repr(C.PROB_LEVELS[h][0]) + '::DOUBLE' for h in C.HAZARDS})} AS level FROM {SEVERITY_SQL})", ["v_preds"])
def threat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products.with_cig(views.predictions(spark, sf_dir))
    mask = lambda v, none: bins.by_hazard(F.col("hazard"), {h: bins.threat_mask(h, F.col("p"), v, none) for h in C.HAZARDS})
    return p.select("fxx", "hazard", "iy", "ix", F.round(mask(F.col("p"), 0.0), 6).alias("p"), mask(F.col("cig"), -1).cast("int").alias("cig"))


@query(", b AS (SELECT fxx, hazard, iy, ix, i::INT AS bin, dist[i + 1] AS s FROM v_preds, range(3) r(i)) SELECT k.fxx, k.hazard, k.iy, k.ix, j::INT AS bin, coalesce(s, 0) AS share FROM (SELECT DISTINCT fxx, hazard, iy, ix FROM b) k CROSS JOIN range(5) r(j) LEFT JOIN b ON b.fxx = k.fxx AND b.hazard = k.hazard AND b.iy = k.iy AND b.ix = k.ix AND b.bin = j", ["v_preds"])
def class_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.predictions(spark, sf_dir).select("fxx", "hazard", "iy", "ix", F.posexplode(F.slice("dist", 1, 3)).alias("bin", "share"))
    return products.aligned_bins(known, ["fxx", "hazard", "iy", "ix"], 5)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE isodow(o_orderdate) = 6 AND o_orderdate >= TIMESTAMP '1998-01-01'")
def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.weekday("o_orderdate") == 5) & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return tables.dataset(spark, f"{sf_dir}/orders.parquet", days, ["o_orderkey", "o_custkey", "o_totalprice"])


@query(f"SELECT hazard, count(*) AS n, sum((bin >= 0)::INT)::BIGINT AS known_n, round(100 * avg((bin >= 0)::INT), 6) AS known_pct FROM (SELECT hazard, {bin_sql()} AS bin FROM v_reports) GROUP BY 1", ["v_reports"])
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events.with_severity(views.reports(spark, sf_dir)).select("hazard", (F.col("bin") >= 0).cast("int").alias("known"))
    b = verify.class_balance(r, ["hazard"], ["known"])
    return b.select("hazard", "n", "known_n", F.round("known_pct", 6).alias("known_pct"))


@query(", o AS (SELECT event_id, ['DAY1', 'DAY2'][event_id % 2 + 1] AS category, event_id % 7 AS threshold, time AS issue, time + to_hours((6 + event_id % 30)::INT) AS expire FROM v_reports), v AS (SELECT * FROM o WHERE issue <= TIMESTAMP '2024-01-10 12:00:00' AND expire > TIMESTAMP '2024-01-10 12:00:00'), m AS (SELECT category, max(issue) AS issue FROM v GROUP BY 1) SELECT event_id, category, threshold FROM v JOIN m USING (category, issue)", ["v_reports"])
def outlook_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    o = views.reports(spark, sf_dir).select("event_id", F.when(i % 2 == 0, "DAY1").otherwise("DAY2").alias("category"), (i % 7).alias("threshold"), F.col("time").alias("issue"), (F.col("time") + F.make_dt_interval(hours=(6 + i % 30).cast("int"))).alias("expire"))
    return events.outlook_at(o, F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).select("event_id", "category", "threshold")


MATRIX_SQL = """, h AS (SELECT date_trunc('hour', time) AS valid FROM v_reports GROUP BY 1 HAVING count(*) >= 12),
s AS (SELECT valid, f::INT AS fxx, valid - to_hours(f::INT) AS run FROM h, (VALUES (6), (18)) t(f)),
w AS (SELECT DISTINCT valid, (event_id % 24)::INT AS iy, ((event_id * 7) % 32)::INT AS ix FROM v_reports JOIN h ON time BETWEEN valid - INTERVAL 30 MINUTE AND valid + INTERVAL 30 MINUTE),
r AS (SELECT s.valid, fxx, run, g.iy, g.ix, round(g.v, 6) AS v, (w.iy IS NOT NULL)::INT AS flag FROM s, v_grid g LEFT JOIN w ON w.valid = s.valid AND w.iy = g.iy AND w.ix = g.ix),
k AS (SELECT *, """ + share_sql("((epoch(valid)::BIGINT // 3600 * 1000 + fxx) * 4096 + iy) * 4096 + ix") + """ AS z FROM r)
SELECT valid, fxx, run, iy, ix, v, flag, CASE WHEN flag = 1 THEN 1.0::DOUBLE ELSE 1 / 0.05::DOUBLE END AS weight, CASE isodow(valid) WHEN 6 THEN 'validation' WHEN 7 THEN 'test' ELSE 'train' END AS split FROM k WHERE flag = 1 OR z < 0.05::DOUBLE"""


@query(MATRIX_SQL, ["v_reports", "v_grid"])
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jobs

    r = views.reports(spark, sf_dir)
    samples = jobs.plan_samples(r, [6, 18], 12)
    i = F.col("event_id")
    labels = jobs.label_flags(r, ((i % 24).cast("int"), (i * 7 % 32).cast("int")))
    hours = samples.select("valid").distinct()
    features = hours.crossJoin(F.broadcast(views.grid(spark, sf_dir).select("iy", "ix", F.round("v", 6).alias("v"))))  # a grid of 768 cells
    return jobs.build_matrix(samples, features, labels, ["flag"], 0.05).select("valid", "fxx", "run", "iy", "ix", "v", "flag", "weight", "split")
