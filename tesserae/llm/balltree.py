"""Exact top-k inner products: a ball tree per shard, branch and bound by node upper bounds, the current kth score shared.

Candidates are dealt to shards by coarse centres, large cells to several shards, so that a shard is a ball of its own.
Queries go through the shards in rounds: first the shard whose centre scores best, then the next few, then all others. Before each
round the kth score of each query, from all shards so far, is shared, and a query goes only to the shards whose ball can reach it. A shard
is read once for thousands of queries, which stream past its tree; within a shard, the kth score rises leaf by leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Rows of a shard at least on average, shards at most (larger tables have larger shards), rows of a leaf at most, queries of a block on average.
SHARD_ROWS, SHARDS, LEAF, BLOCK = 8192, 4096, 128, 512
#: Blocks that pass one copy of a shard; rows of the sample from which centres are taken, for each centre; Lloyd's steps.
PASSING, SAMPLED, STEPS = 64, 8, 4
#: Shards, by their centre's score, that a query meets in each round; the last round has all that its bound leaves.
ROUNDS = ((0, 1), (1, 9), (9, None))
LOWEST = -(1 << 63)
#: Doubles hold integers up to this size; products of whole rows up to it are made with them.
EXACT = 1 << 53
#: Rounding of a bound, as a part of the product of the lengths that it is made of.
ROUNDING = 1e-9


@dataclass
class Tree:
    """Rows in leaf order; of each node the first row and the one behind the last, centre, radius; children of node i are left[i], left[i] + 1, or none (-1)."""

    ids: np.ndarray
    rows: np.ndarray
    first: list[int]
    end: list[int]
    left: list[int]
    centre: np.ndarray
    radius: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """Splits at the median of the direction between two far rows; equal rows are split by place."""
    order = np.argsort(ids, kind="stable")
    ids, whole = ids[order], rows[order]
    rows = whole.astype(np.float64)
    place = np.arange(len(ids))
    first, end, left, centres, radii = [0], [len(ids)], [-1], [], []
    k = 0
    while k < len(first):
        a, b = first[k], end[k]
        own = rows[place[a:b]]
        c = own.mean(0) if b > a else np.zeros(rows.shape[1])
        d = np.sqrt(((own - c) ** 2).sum(1))
        centres.append(c)
        radii.append(d.max(initial=0.0))
        if b - a > leaf:
            p = own[d.argmax()]
            q = own[((own - p) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            place[a:b] = place[a:b][np.argpartition(own @ (q - p), half)]
            left[k] = len(first)
            first += [a, a + half]
            end += [a + half, b]
            left += [-1, -1]
        k += 1
    return Tree(ids[place], whole[place], first, end, left, np.array(centres), np.array(radii))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit integers: by doubles where these are exact, else in 64 bits, else one by one; beyond 64 bits an OverflowError."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ x.T
    out = q.astype(object) @ x.astype(object).T
    if out.size and (max(out.flat) >= 1 << 63 or min(out.flat) < LOWEST):
        raise OverflowError("an inner product needs more than 64 bits")
    return out.astype(np.int64)


def reach(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with what lies in balls; rounding, which goes with the lengths multiplied, is added."""
    norm = np.sqrt((queries**2).sum(1))[:, None]
    return queries @ centre.T + norm * radius + ROUNDING * norm * (np.sqrt((centre**2).sum(1)) + radius) + 1e-6


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of the shard's rows that may be among each query's k best, but for the query's own id.

    kth: scores that each query has k better or equal rows for already. Nodes whose bound is below are left. Leaves are visited
    by falling bound in steps: each query's best leaf, then its next three, twelve and so on; in a step, a leaf meets all queries that it is due for
    at once. Only scores that reach the kth are sorted.
    """
    n = len(ids)
    kth = kth.copy()
    none = np.iinfo(np.int64).max
    best_s = np.full((n, k), LOWEST, np.int64)
    best_i = np.full((n, k), none, np.int64)
    as_double = queries.astype(np.float64)
    exact = int(np.abs(queries).max(initial=0)) * int(np.abs(tree.rows).max(initial=0)) * queries.shape[1] < EXACT
    rows = tree.rows.astype(np.float64) if exact else tree.rows

    # Down the tree, level by level: pairs of query and node that the kth score leaves.
    level, leaves = [(0, np.arange(n))], []
    while level:
        deeper = []
        for node, q in level:
            bound = reach(as_double[q], tree.centre[node : node + 1], tree.radius[node : node + 1])[:, 0]
            left = bound >= kth[q]
            q = q[left]
            if len(q) and tree.left[node] < 0:
                leaves.append((node, q, bound[left]))
            elif len(q):
                deeper += [(tree.left[node], q), (tree.left[node] + 1, q)]
        level = deeper
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair_q = np.concatenate([q for _, q, _ in leaves])
    pair_leaf = np.concatenate([np.full(len(q), node) for node, q, _ in leaves])
    pair_bound = np.concatenate([bound for _, _, bound in leaves])
    order = np.lexsort((-pair_bound, pair_q))
    pair_q, pair_leaf, pair_bound = pair_q[order], pair_leaf[order], pair_bound[order]
    turn = np.arange(len(pair_q)) - np.searchsorted(pair_q, pair_q, "left")
    # Products that don't fit doubles are dear, and may be too large: leaf by leaf there.
    step = np.ceil(np.log2(turn + 1) / 2).astype(np.int64) if exact else turn
    order = np.lexsort((pair_leaf, step))
    pair_q, pair_leaf, pair_bound, step = pair_q[order], pair_leaf[order], pair_bound[order], step[order]
    starts = np.flatnonzero(np.diff(pair_leaf, prepend=-1) | np.diff(step, prepend=-1))
    for at, end in zip(starts, np.append(starts[1:], len(pair_q)), strict=True):
        q = pair_q[at:end]
        q = q[pair_bound[at:end] >= kth[q]]
        if not len(q):
            continue
        own = slice(tree.first[pair_leaf[at]], tree.end[pair_leaf[at]])
        s = as_double[q] @ rows[own].T if exact else _products(queries[q], rows[own])
        good = (s >= kth[q, None]) & (tree.ids[own] != ids[q, None])
        hit = good.any(1)
        if not hit.any():
            continue
        q, good = q[hit], good[hit]
        s = np.where(good, s[hit].astype(np.int64), LOWEST)
        s, i = np.concatenate([best_s[q], s], 1), np.concatenate([best_i[q], np.where(s == LOWEST, none, tree.ids[own])], 1)
        top = np.lexsort((i, -(s.astype(np.float64)) if np.abs(s[s != LOWEST]).max(initial=0) < 1 << 52 else _falling(s)), axis=1)[:, :k]
        best_s[q], best_i[q] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        kth[q] = np.maximum(kth[q], best_s[q, -1])
    found = (best_s > LOWEST) & (best_s >= kth[:, None])
    q, j = np.nonzero(found)
    return q, best_i[q, j], best_s[q, j]


def _falling(s: np.ndarray) -> np.ndarray:
    """A key that sorts 64-bit numbers in falling order."""
    return ~s


def _bytes(v: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them, behind that number of bytes."""
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1)
    size = next(n for n in (1, 2, 4, 8) if most < 1 << (8 * n - 1))
    return bytes([size]) + v.astype(f"<i{size}").tobytes()


def _integers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)


def _packed(rows: DataFrame, group: str, ball: bool) -> DataFrame:
    """g, dim, ids, vectors and, for a ball, centre and radius of each value of group, in one row. Groups are bounded by how they were dealt."""
    more = [("centre", pa.binary()), ("radius", pa.float64())] if ball else []
    kinds = pa.schema([("g", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), *more])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy().astype(np.int64)
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        own = flat.reshape(len(ids), -1).astype(np.float64)
        c = own.mean(0)
        ends = [[c.tobytes()], [float(np.sqrt(((own - c) ** 2).sum(1)).max()) * (1 + ROUNDING)]] if ball else []
        return pa.table([[key[0].as_py()], [key[1].as_py()], [ids.astype("<i8").tobytes()], [_bytes(flat)], *ends], schema=kinds)

    return rows.select(F.col(group).alias("g"), "dim", "id", "v").groupBy("g", "dim").applyInArrow(run, "g long, dim int, ids binary, vectors binary" + ", centre binary, radius double" * ball)


def coarse_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n centres of a sample, by a few of Lloyd's steps from rows spread over it."""
    c = np.unique(sample[:: max(1, len(sample) // n)][:n], axis=0)
    for _ in range(STEPS):
        at = _nearest(sample, c)
        count = np.bincount(at, minlength=len(c))
        moved = np.stack([np.bincount(at, col, len(c)) for col in sample.T], 1) / np.maximum(count, 1)[:, None]
        c = np.where(count[:, None] > 0, moved, c)
    return c


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    away = (centres**2).sum(1)
    return np.concatenate([(away - 2 * rows[a : a + 1024] @ centres.T).argmin(1) for a in range(0, len(rows), 1024)] or [np.zeros(0, np.int64)])


def _celled(centres: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell = b.column("dim").to_numpy(), np.zeros(len(b), np.int64)
            for d in np.unique(dim).tolist():
                if d in centres.value:
                    at = np.flatnonzero(dim == d)
                    own = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    cell[at] = _nearest(own.reshape(len(at), d), centres.value[d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (id, v, is_query, dim) with shard: cells of the nearest coarse centre, those of too many rows as several shards."""
    spark = rows.sparkSession
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    each = max(SHARD_ROWS, -(-sum(sizes.values()) // SHARDS))
    cells = {d: -(-n // each) for d, n in sizes.items() if d and n > each}
    centres = {}
    for d, n in cells.items():
        sample = rows.where(F.col("dim") == d).orderBy(F.xxhash64(F.lit(3), "id", "v")).limit(SAMPLED * n).select("v").toPandas()["v"]
        centres[d] = coarse_centres(np.array(sample.tolist(), np.float64), n)
    celled = rows.mapInArrow(_celled(spark.sparkContext.broadcast(centres)), "id long, v array<long>, is_query boolean, dim int, cell long")
    celled = materialize(celled.withColumn("place", F.monotonically_increasing_id()), "ball-rows")
    counts = sorted(celled.groupBy("dim", "cell").count().collect())  # a row for each centre
    starts, at = [], 0
    for r in counts:
        starts.append((r.dim, r.cell, at, parts := -(-r["count"] // each)))
        at += parts
    base = spark.createDataFrame(starts, "dim int, cell long, base long, parts long")
    return celled.join(F.broadcast(base), ["dim", "cell"]).withColumn("shard", F.col("base") + F.pmod(F.xxhash64("place"), F.col("parts")))


def _routed(balls: Broadcast, first: int, end: int | None):
    """Blocks of queries to the shards of their ranks from first to before end whose ball may hold something better than their kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shards, centre, radius = balls.value[row["dim"]]
                ids, kth = np.frombuffer(row["ids"], np.int64), _scores(row["kth"], len(row["ids"]) // 8)
                whole = _integers(row["vectors"]).reshape(len(ids), -1)
                queries = whole.astype(np.float64)
                rank = np.argsort(np.argsort(-(queries @ centre.T), 1, kind="stable"), 1)
                meets = (rank >= first) & (rank < (len(shards) if end is None else end)) & (reach(queries, centre, radius) >= kth[:, None])
                for s in np.flatnonzero(meets.any(0)):
                    at = np.flatnonzero(meets[:, s])
                    made = (int(shards[s]), row["g"] // PASSING, 1, row["g"], row["dim"], ids[at].tobytes(), _bytes(whole[at].ravel()), at.astype(np.int64).tobytes(), kth[at].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip(made, MET, strict=True)], schema=MET)

    return run


def _scores(kth: bytes | None, n: int) -> np.ndarray:
    return np.frombuffer(kth, np.int64) if kth else np.full(n, LOWEST)


MET = pa.schema([("shard", pa.int64()), ("passing", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("places", pa.binary()), ("kth", pa.binary())])
MET_DDL = "shard long, passing long, kind int, block long, dim int, ids binary, vectors binary, places binary, kth binary"


def _searched(k: int):
    """A shard's row stands before those of the queries that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            for r in range(len(b)):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = _integers(row["vectors"]).reshape(len(ids), -1)
                if not row["kind"]:
                    tree = build(ids, vectors)
                    continue
                q, i, s = search(tree, ids, vectors, np.frombuffer(row["kth"], np.int64), k)
                places = np.frombuffer(row["places"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["block"])), pa.array(np.full(len(q), row["dim"], np.int32)), pa.array(places[q]), pa.array(ids[q]), pa.array(i), pa.array(s)], ["block", "dim", "place", "query_id", "id", "score"])

    return run


FOUND = "block long, dim int, place long, query_id long, id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query."""
    w = Window.partitionBy("block", "dim", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _kth(best: DataFrame, k: int, asked: DataFrame) -> DataFrame:
    """g, dim and the kth scores of a block's queries, in their order, as bytes."""
    kinds = pa.schema([("g", pa.int64()), ("dim", pa.int32()), ("kth", pa.binary())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kth = np.full(t.column("n")[0].as_py(), LOWEST, np.int64)
        full = t.column("score").is_valid().to_numpy()
        kth[t.column("place").to_numpy()[full].astype(np.int64)] = t.column("score").to_numpy()[full].astype(np.int64)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [kth.tobytes()]], schema=kinds)

    sizes = asked.select("g", "dim", (F.octet_length("ids") / 8).cast("int").alias("n"))
    own = sizes.join(best.where(F.col("rank") == k).select(F.col("block").alias("g"), "dim", "place", "score"), ["g", "dim"], "left")
    return own.groupBy("g", "dim").applyInArrow(run, "g long, dim int, kth binary")


def top_products(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k rows with the highest integer inner products, ties to the smaller id.

    Components are floor(scale * x). is_query: SQL that holds for the query rows; every row but those of the query's own id is
    a candidate. Rows with a null id or vector, or with null, NaN or infinite components, take no part. Vectors of
    different lengths never meet. A query row that repeats is answered once; a candidate row that repeats counts each
    time. Components, and inner products of what is compared, that need more than 64 bits are errors; all others are exact. Fewer than k
    candidates: all of them; an empty table gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(F.lit(scale) * x.cast("double")) < F.lit(2.0**63), F.floor(F.lit(scale) * x.cast("double"))).otherwise(F.raise_error(F.lit("a component needs more than 64 bits")).cast("long"))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, whole).alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("is_query")).withColumn("dim", F.size("v"))
    with scratch(spark) as keep:
        dealt = _dealt(rows)
        trees = materialize(_packed(dealt, "shard", True), "ball-shards")
        balls: dict[int, list] = {}
        for r in trees.select("g", "dim", "centre", "radius").orderBy("g").toLocalIterator():  # SHARDS rows, and one for each length of vectors
            balls.setdefault(r.dim, []).append((r.g, np.frombuffer(r.centre, np.float64), r.radius))
        known = spark.sparkContext.broadcast({d: tuple(map(np.array, zip(*own, strict=True))) for d, own in balls.items()})
        most = max(map(len, balls.values()), default=0)
        asked = dealt.where("is_query").select("id", "dim", "v").dropDuplicates(["id", "dim"])
        blocks = max(1, -(-asked.count() // BLOCK))
        asked = materialize(_packed(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "block", False), "ball-blocks")
        best = None
        for first, end in ROUNDS:
            if first and first >= most:
                break
            kth = asked.join(_kth(best, k, asked), ["g", "dim"], "left") if best is not None else asked.withColumn("kth", F.lit(None).cast("binary"))
            met = materialize(kth.mapInArrow(_routed(known, first, end), MET_DDL), "ball-met")
            copies = trees.join(met.select(F.col("shard").alias("g"), "passing").distinct(), "g")
            copies = copies.select(F.col("g").alias("shard"), "passing", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "dim", "ids", "vectors", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("kth"))
            both = materialize(copies, "ball-copies").unionByName(met).repartitionByRange(max(1, min(len(balls) and sum(map(len, balls.values())) * -(-blocks // PASSING), SHARDS)), "shard", "passing").sortWithinPartitions("shard", "passing", "kind", "block")
            found = both.mapInArrow(_searched(k), FOUND)
            best = materialize(_best(found if best is None else best.drop("rank").unionByName(materialize(found, "ball-found")), k), "ball-best")
        keep(best)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: DuckDB: all products.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
