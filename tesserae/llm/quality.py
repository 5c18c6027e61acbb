"""Quality by histogram gradient-boosted trees over document statistics; the trees are flat arrays, traversed by numpy."""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, crc_mod, materialize, scratch, spread

#: At most so many labelled rows are fitted, the first by a hash of the id.
LABELLED = 24000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 150, 4, 0.12, 2.0, 8.0

STATISTICS = ["bytes", "words", "word_length", "longest_word", "distinct_words", "repeats", "top_word", "upper", "digits", "punctuation", "exclamation", "symbols", "bars", "stops", "non_ascii", "lines", "distinct_lines", "line_length", "repeated_lines", "no_letters", "one_letter", "markup", "white", "ends_in_symbol", "distinct_pairs", "lines_with_stop", "control", "capitalised", "at_signs", "slashes"]
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SYMBOLS = b"#$%&*+=@^~_"


def statistics(text: str | None) -> list[float]:
    """One number for each of STATISTICS, 0 where a text has nothing to divide by."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, letters = max(1, len(raw)), max(1, int(count[LETTERS].sum()))
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    seen = Counter(words)
    share = lambda chars: float(count[list(chars)].sum()) / total
    endings = Counter(w[-1] for w in words)
    own_lines = Counter(lines)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(max(map(len, words), default=0)),
        len(seen) / n, sum(map(operator.eq, words, words[1:])) / n, max(seen.values(), default=0) / n,
        float(count[65:91].sum()) / letters, share(range(48, 58)), share(b".,;:!?'\"()-"), share(b"!"), share(SYMBOLS), share(b"|"), share(b"."),
        float(count[128:].sum()) / total, np.log1p(len(lines)), len(own_lines) / m, np.log1p(len(raw) / m),
        sum(len(x) * (k - 1) for x, k in own_lines.items()) / total,
        sum(k for w, k in seen.items() if not w.strip(b"0123456789.,;:!?'\"()-|/#$%&*+=@^~_<>{}[]\\")) / n, sum(k for w, k in seen.items() if len(w) == 1) / n,
        share(b"<>{}[]\\"), share(b" \t\n\r\x0b\x0c"), sum(endings[c] for c in SYMBOLS + b"!?") / n,
        len(set(zip(words, words[1:], strict=False))) / n, sum(x.rstrip().endswith(b".") for x in lines) / m,
        float(count[:9].sum() + count[14:32].sum() + count[127]) / total, sum(k for w, k in seen.items() if 65 <= w[0] <= 90) / n, share(b"@"), share(b"/"),
    ]


@dataclass
class Forest:
    """Complete trees of one depth as arrays (tree, node): a row goes right where its statistic is above the cut; values at the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss; splits are chosen on histograms of at most BINS quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    z = np.full(len(x), bias)
    width, inner = x.shape[1], 2**DEPTH - 1
    feature, cut, value = (np.zeros((0, k)) for k in (inner, inner, inner + 1))
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        s = 1 / (1 + np.exp(-z))
        g, h = s - y, s * (1 - s)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width + np.arange(width)) * BINS + code
            shape = (wide, width, BINS)
            gs = np.bincount(at.ravel(), np.repeat(g, width), wide * width * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(at.ravel(), np.repeat(h, width), wide * width * BINS).reshape(shape).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
            gain[(hs < LEAST) | (ha - hs < LEAST)] = 0
            flat = gain.reshape(wide, -1)
            best = flat.argmax(1)
            for k in range(wide):
                j, b = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-9 and b < len(edges[j]):
                    f[first + k], c[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        z += v[leaf]
        feature, cut, value = np.vstack([feature, f]), np.vstack([cut, c]), np.vstack([value, v])
    return Forest(feature.astype(np.int64), cut, value, bias)


def _measure(texts: list) -> list:
    return [[statistics(t) for t in texts]]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED) -> Forest:
    """A forest from labelled rows whose crc32(id as text) mod 5 is not 0.

    Null ids, null labels and labels without a document are left out; an id with several labels has the least of them. Of documents
    with one id, the least text is fitted, so that the sample is bounded however often an id repeats.
    """
    docs = spread(docs.select(id_col, "text"))
    inside = F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0)
    known = labels.where(inside & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    with scratch(docs.sparkSession):
        known = materialize(known.orderBy(F.xxhash64(F.lit(8), F.col(id_col)), id_col).limit(labelled), "quality-sample")  # at most labelled rows
        texts = docs.where(inside).join(F.broadcast(known), id_col).groupBy(id_col, "quality").agg(F.min("text").alias("text"))
        rows = append(texts, "text", _measure, [("x", "array<double>", pa.list_(pa.float64()))], [id_col, "quality"]).toPandas().sort_values(id_col, kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit_forest(x, rows["quality"].to_numpy(float))


def with_score(docs: DataFrame, forest: Forest, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs with the score of each whole text; null and empty texts are scored by their statistics like any other."""
    return append(docs, "text", lambda ts: [forest.score(np.array(_measure(ts)[0], float).reshape(-1, len(STATISTICS)))], [(name, "double", pa.float64())], keep)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score, predicted of every row of docs (id_col, text); repeated rows score alike, a null id is scored like any other."""
    scored = with_score(docs, train(docs, labels, id_col), [id_col])
    return scored.select(id_col, (crc_mod(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
