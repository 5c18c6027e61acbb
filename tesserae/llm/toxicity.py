"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier from confirmed toxic texts and unlabelled ones.

The risk of calling unlabelled text toxic is corrected by the class prior; where the corrected part
falls below zero, which only overfitting can cause, the step goes the other way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, crc_mod, materialize, scratch, spread

#: At most so many confirmed toxic rows and unlabelled rows are fitted, the first by a hash of the id.
POSITIVES, UNLABELLED = 4000, 12000
#: Lengths of the word starts that count as features beside whole words.
STARTS = (4, 5, 6)
#: A feature is kept if it is so many standard errors more common in toxic texts; at most so many are.
STANDARD_ERRORS, FEATURES = 5.0, 20000
STEPS, RATE, DECAY = 400, 0.05, 1e-4
#: The prior is taken so much higher than its estimate: a prior that is too low makes rare toxic words look clean.
MARGIN = 1.2

_words = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> set[str]:
    """Distinct words in lower case and, behind a caret, their starts."""
    words = set(_words((text or "").lower()))
    return words.union("^" + w[:n] for w in words if len(w) >= STARTS[0] for n in STARTS if n <= len(w))


@dataclass
class Model:
    """Weights of features, and what a text without any of them scores, as log odds."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(sorted(w for f in features(text) if (w := get(f)) is not None))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_nnpu(chosen: list[str], positive: list[list[int]], unlabelled: list[list[int]], prior: float) -> Model:
    """The linear classifier that has the least non-negative risk; without positives or features, one that scores all alike.

    positive and unlabelled: of each text, the places in chosen of the features that it has.
    """
    prior = min(max(MARGIN * prior, 1e-3), 0.5)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    if not chosen or not positive:
        return Model({}, float(np.log(prior / (1 - prior))))

    def flat(group: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(group)), [len(doc) for doc in group]), np.array([f for doc in group for f in doc], np.int64)

    (dp, fp), (du, fu) = flat(positive), flat(unlabelled)
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def scores(d: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(d, w[f], n) + w[-1]

    def back(g: np.ndarray, d: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(f, g[d], len(chosen)), g.sum())

    for step in range(1, STEPS + 1):
        zp, zu = scores(dp, fp, len(positive)), scores(du, fu, len(unlabelled))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # Losses: -log s of what should be toxic; s itself of what should be clean, which is bounded, so that sure positives
        # can't make the corrected part negative. Their derivatives are s - 1 and s * (1 - s).
        as_clean = su.mean() - prior * sp.mean()
        g_clean = back(su * (1 - su) / n_u, du, fu) - prior * back(sp * (1 - sp) / n_p, dp, fp)
        grad = prior * back((sp - 1) / n_p, dp, fp) + (g_clean if as_clean >= 0 else -g_clean)
        grad += DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows whose crc32(id as text) mod 4 is not 2.

    Of labels (id_col, toxic), only rows with toxic = 1 say anything of a text; all rows give the class prior. Null ids,
    null labels and labels without a document are left out; an id that is toxic in any row is toxic. Of documents with one id, the
    least text is fitted, so that the sample is bounded however often an id repeats.
    """
    docs = spread(docs.select(id_col, "text"))
    inside = F.col(id_col).isNotNull() & (crc_mod(id_col, 4) != 2)
    known = labels.where(inside & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    with scratch(docs.sparkSession):
        by_hash = F.xxhash64(F.lit(5), F.col(id_col)), F.col(id_col)
        p = known.where("toxic = 1").orderBy(*by_hash).limit(positives).select(id_col, F.lit(1).alias("toxic"))
        u = docs.where(inside).select(id_col).distinct().orderBy(*by_hash).limit(unlabelled).select(id_col, F.lit(0).alias("toxic"))
        ids = materialize(p.unionByName(u), "toxicity-sample")  # at most positives + unlabelled rows
        texts = docs.where(inside).join(F.broadcast(ids), id_col).groupBy(id_col, "toxic").agg(F.min("text").alias("text"))
        found = append(texts, "text", lambda ts: [[sorted(features(t)) for t in ts]], [("found", "array<string>", pa.list_(pa.string()))], ["toxic"])
        found = materialize(found, "toxicity-features")
        chosen = choose(found)
        index = {f: k for k, f in enumerate(chosen)}
        rows = append(found, "found", lambda fs: [[[index[f] for f in own if f in index] for own in fs]], [("places", "array<int>", pa.list_(pa.int32()))], ["toxic"]).collect()
        return fit_nnpu(chosen, sorted(r.places for r in rows if r.toxic), sorted(r.places for r in rows if not r.toxic), prior)


def choose(found: DataFrame) -> list[str]:
    """The features that are STANDARD_ERRORS more common in toxic texts, at most FEATURES. found: toxic (1 or 0), found, a row for each sampled text."""
    n = {r.toxic: float(r["count"]) for r in found.groupBy("toxic").count().collect()}
    n_p, n_u = n.get(1, 0.0), n.get(0, 0.0)
    if not n_p or not n_u:
        return []
    counts = found.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"))
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    best = counts.select("feature", z.alias("z")).where(F.col("z") >= STANDARD_ERRORS).orderBy(F.desc("z"), "feature").limit(FEATURES)
    return [r.feature for r in best.collect()]


def with_score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs with the score of each whole text; null and empty texts have the score of a text without features."""
    return append(docs, "text", lambda ts: [[model.score(t) for t in ts]], [(name, "double", pa.float64())], keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score, predicted of every row of docs (id_col, text); repeated rows score alike, a null id is scored like any other."""
    scored = with_score(docs, train(docs, labels, id_col), [id_col])
    return scored.select(id_col, (crc_mod(id_col, 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
