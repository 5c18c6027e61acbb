"""Mixing, sharding, near-duplicates, search and classifiers against plain versions and held-out rows."""

import glob
import os
import random
import shutil

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tesserae.llm import balltree, common, components, mixing, quality, queries, sharding, simhash, toxicity

from ..compare import same
from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    rows = [(i, "w " * (i % 7), "en", None if i % 5 == 0 else f"s{i % 3}", 1) for i in range(60)]
    rows += [(None, "some words", None, "s1", None), (7, None, None, "s0", None), (7, None, None, "s0", None), (8, "w " * 3000, "en", "Ω", 6000)]
    return spark.createDataFrame(rows, DOCS)


def duck_docs(df):
    con = duckdb.connect()
    con.register("frame", df.toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    return con


def test_mix_as_sql(spark):
    df = odd_docs(spark)
    got = mixing.mix(df.withColumn("target", F.lit(1)))
    same(got.toPandas(), duck_docs(df).execute(mixing.MIX_SQL).df())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_keeps_its_promises(spark):
    pdf = queries.op1_mix_sources(spark, SF).toPandas()
    by = pdf.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert (pdf.taken <= 2 * pdf["size"]).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert by.target.sum() == pytest.approx(1.5 * pdf["size"].sum())
    assert ((by.taken - by.target).abs() <= by.largest).all()
    # Nested: a larger budget takes no document less.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    less = mixing.mix(docs, share=0.4).select("doc_id", F.col("taken").alias("less"))
    assert mixing.mix(docs, share=0.9).join(less, "doc_id").where("taken < less").count() == 0


def test_mixed_rows_repeat(spark):
    df = odd_docs(spark)
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    words = rows.select(mixing.word_count("text").alias("n")).agg(F.sum("n")).first()[0]
    assert words == mixing.mix(df).agg(F.sum("taken")).first()[0]


def test_mix_splits_hot_repeated_rows(spark):
    rows = [(1, "w " * 100, "en", "a", 1)] * 400 + [(2, "w " * 144, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).toPandas()
    assert got.target[0] == 60_216 and abs(got.taken.sum() - 60_216) <= 144
    assert sorted(got.taken) == sorted(mixing.mix(df.repartition(7)).toPandas().taken)
    back = mixing.mixed_rows(df.withColumnsRenamed({"lang": "tie", "n_chars": "number"}))
    assert back.columns == ["doc_id", "text", "tie", "source", "number"]
    assert back.select(mixing.word_count("text").alias("n")).agg(F.sum("n")).first()[0] == got.taken.sum()


def place(df, **kw):
    return sharding.shard_by_size(df, **kw).toPandas()


def test_shards_as_sql(spark):
    df = odd_docs(spark)
    got = sharding.shard_by_size(df).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    same(got.toPandas(), duck_docs(df).execute(sharding.SHARD_SQL).df())
    assert sharding.shard_by_size(df.limit(0)).count() == 0


def test_shards_of_hot_groups(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}", None, None, None) for i in range(3000)] + [(5, "one row", None, None, None)] * 1500
    got = place(spark.createDataFrame(rows, DOCS))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.text_crc32.between(0, 2**32 - 1).all() and len(got) == 4500


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 16)
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    rows = spark.range(4000).select(F.lit(5).cast("long").alias("k1"), F.lit(7).cast("long").alias("k2"), F.col("id").alias("k3"), F.lit(3).cast("long").alias("size"), F.lit(1.0).alias("weight"))
    bounds, totals = sharding.splitters(rows, 16)
    assert len(totals) > 8 and max(t.n for t in totals) < 1500 and sum(t.n for t in totals) == 4000


def test_range_of_compares_all_columns():
    rng = np.random.default_rng(1)
    bounds = np.array(sorted({tuple(map(int, r)) for r in rng.integers(0, 4, (30, 3))}), np.int64)
    keys = rng.integers(-1, 5, (500, 3))
    want = [sum(tuple(b) <= tuple(k) for b in bounds.tolist()) for k in keys.tolist()]
    assert sharding.range_of(keys, bounds).tolist() == want


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, bits=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash_near_dups(spark, SF).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(prints, [i for i, _ in rows])
    assert got == {i: (p, c) for (i, _), p, c in zip(rows, prints, want, strict=True)}


@pytest.mark.parametrize("hot", [4000, 2])
def test_links_within_three_bits_are_all_found(spark, hot):
    rng = random.Random(hot)
    prints, centre = [0, (1 << 64) - 1], rng.getrandbits(64)
    for _ in range(150):
        x = centre if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([*enumerate(signed)], "id long, fp long")
    for bits in (0, 1, 3):
        got = {r.id: r.component_id for r in simhash.fingerprint_components(df, "id", bits, hot).collect()}
        assert [got[i] for i in range(len(prints))] == plain_components(prints, list(range(len(prints))), bits)
    with pytest.raises(ValueError):
        simhash.fingerprint_components(df, "id", 4)


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "one two three four"), (2, "ONE two  three\tfour"), (2, "one two three four"), (7, "quite other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = [(r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.simhash_near_dups(df).collect()]
    assert sorted(got, key=str) == sorted([(5, True, 3), (3, True, 3), (9, True, 3), (None, False, 2), (2, False, 2), (2, False, 2), (7, False, 7)], key=str)
    assert simhash.simhash_near_dups(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i + 1, i) for i in range(100, 160)]
    edges = path + [(1, k) for k in range(2, 60)] + [(70, 70), (80, 81), (81, 80), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(1, 60)} == {1} and got[81] == 80 and 70 not in got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copy_docs():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, groups = [], {}
    for g in range(12):
        base = [word() for _ in range(220)]
        for k in range(6):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = word()
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    half = [word() for _ in range(200)]
    for _ in range(2):  # alike in half only: both stay
        groups[len(rows)] = 100 + len(rows)
        rows.append((len(rows), " ".join(half[:100] + [word() for _ in range(100)]), "en", "s", 1))
    return rows, groups


def test_one_of_each_near_copy(spark):
    rows, groups = near_copy_docs()
    df = spark.createDataFrame(rows, DOCS)
    kept = [r.doc_id for r in simhash.one_of_each(df).collect()]
    assert sorted(kept) == sorted({g: i for i, g in reversed(groups.items())}.values())
    doubled = df.unionByName(df.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, rows[0][1], None, None, None)], DOCS))
    again = simhash.one_of_each(doubled)
    assert again.columns == df.columns and sorted(r.doc_id for r in again.collect()) == sorted(kept)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def plain_groups(texts, least=0.8):
    """Groups by every pair's fingerprints and shingle sets."""
    sets, prints = [set(simhash.shingles(t, 5)) for t in texts], [simhash.fingerprint(t, 5) for t in texts]
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and ((prints[i] ^ prints[j]).bit_count() <= 3 or both >= least * (len(sets[i]) + len(sets[j]) - both)):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def near_groups(spark, texts):
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()
    return [r.group for r in sorted(got, key=lambda r: r.doc_id)]


def test_near_copies_within_a_family(spark):
    """Members have the same words in orders of their own, so they are below 0.8 to each other; each has one near copy."""
    rng = random.Random(11)
    words, texts = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(200)], []
    for _ in range(40):
        member = rng.sample(words, 200)
        texts += [" ".join(member), " ".join(member[:190] + member[:189:-1])]
    rng.shuffle(texts)
    want = plain_groups(texts)
    assert len(set(want)) == 40 and near_groups(spark, texts) == want


def test_near_copies_appended_and_cut(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = []
    for k in range(120):
        n, more = [(220, 35), (200, 45), (1000, 200), (10, 1)][k % 4]
        w = [word() for _ in range(n + more)]
        texts += [" ".join(w[:n]), " ".join(w)][:: 1 if k % 8 < 4 else -1]
    assert near_groups(spark, texts) == [i - i % 2 for i in range(len(texts))]


def test_near_copies_of_any_member(spark):
    """x0 and x1 have fingerprints within 3 bits; y is at 0.8 to x1 but below to x0."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts, triples = [], 0
    while triples < 12:
        x0 = [word() for _ in range(400)]
        x1 = list(x0)
        x1[200] = word()
        prints = [simhash.fingerprint(" ".join(x), 5) for x in (x0, x1)]
        if (prints[0] ^ prints[1]).bit_count() > 3:
            continue
        y = list(x1)
        for place in range(2, 2 + 8 * 9, 8):
            y[place] = word()
        sets = [set(simhash.shingles(" ".join(x), 5)) for x in (x0, x1, y)]
        while len(sets[1] & sets[2]) >= 0.8 * len(sets[1] | sets[2]):
            last, place = y, next(p for p in range(398, 0, -1) if y[p] == x1[p] and p != 200)
            y = [*y[:place], word(), *y[place + 1 :]]
            sets[2] = set(simhash.shingles(" ".join(y), 5))
        sets[2] = set(simhash.shingles(" ".join(last), 5))
        if len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2]):
            texts += [" ".join(x) for x in (x0, x1, last)]
            triples += 1
    want = plain_groups(texts)
    assert want == [i - i % 3 for i in range(len(texts))] and near_groups(spark, texts) == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def test_search_as_sql(spark, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    monkeypatch.setattr(balltree, "SHARD_ROWS", 90)
    monkeypatch.setattr(balltree, "BLOCK", 4)
    same(queries.op9_ball_tree_topk(spark, SF).toPandas(), con.execute(balltree.TOP_SQL).df())


def test_search_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist(), 0) for i in range(120)]
    rows += [(200, None, 0), (250, [1.0, None, 1.0, 1.0], 0), (300, [float("nan")] * 4, 0), (350, [float("inf")] * 4, 0), (None, [9.0] * 4, 0), (400, [1.0, 2.0], 0), (401, [3.0, 4.0], 0), (7, [3.0] * 4, 0), (7, [3.0] * 4, 0)]
    got = balltree.top_products(vectors(spark, rows), "vec_id % 50 = 0").toPandas()
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    same(got, pd.DataFrame(want, columns=["query_id", "rank", "vec_id", "score"]))
    assert balltree.top_products(vectors(spark, rows).limit(0), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("scale", [10, 1 << 25, 1 << 26, 1 << 29])
def test_tree_search_is_exact(scale):
    rng = np.random.default_rng(scale)
    rows = rng.integers(-scale, scale, (700, 8))
    rows[300:400] = rows[0]
    rows[400:430] = -rows[1]
    ids = np.arange(700)
    tree = balltree.build(ids, rows, 16)
    q, i, s = balltree.search(tree, ids[:40], rows[:40], np.full(40, balltree.LOWEST), 5)
    for k in range(40):
        exact = rows[k].astype(object) @ rows.astype(object).T
        best = sorted((-int(exact[j]), j) for j in ids if j != k)[:5]
        assert sorted(zip(-s[q == k], i[q == k], strict=True)) == best


def test_leaves_meet_their_queries_together(monkeypatch):
    """A leaf meets all queries that it is due for in a few steps, not each query at its own turn; the kth score given, ties, repeated ids and own ids keep their meaning."""
    rng = np.random.default_rng(6)
    rows = rng.integers(-9, 10, (2000, 6))
    rows[500:560] = rows[3]
    ids = np.arange(2000)
    ids[700:720] = ids[5]
    tree = balltree.build(ids, rows, 32)
    leaves = sum(x < 0 for x in tree.left)
    kept, calls = np.lexsort, []
    monkeypatch.setattr(balltree.np, "lexsort", lambda *a, **b: calls.append(1) or kept(*a, **b))
    scores = rows[:150] @ rows.T
    kth = np.where(np.arange(150) % 3 == 0, np.sort(scores, 1)[:, -4], balltree.LOWEST)
    q, i, s = balltree.search(tree, ids[:150], rows[:150], kth, 5)
    for k in range(150):
        best = sorted((-int(scores[k, j]), int(ids[j])) for j in range(2000) if ids[j] != ids[k] and scores[k, j] >= kth[k])[:5]
        assert sorted(zip((-s[q == k]).tolist(), i[q == k].tolist(), strict=True)) == best
    assert len(calls) < leaves * (2 + np.log2(leaves) / 2)


def test_search_refuses_what_64_bits_cannot_hold(spark):
    assert balltree._products(np.array([[1 << 40, 3]]), np.array([[1 << 22, -1]])).tolist() == [[(1 << 62) - 3]]
    with pytest.raises(OverflowError):
        balltree._products(np.array([[1 << 40, 0]]), np.array([[1 << 23, 0]]))
    with pytest.raises(Exception, match="64 bits"):
        balltree.top_products(vectors(spark, [(0, [1e38, 1.0], 0), (1, [1.0, 1.0], 0)]), "vec_id % 50 = 0").count()


def test_search_prunes_shards_by_their_balls(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 50)
    rng = np.random.default_rng(8)
    centres = 40 * np.eye(12)
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.2, 12)).tolist(), 0) for i in range(1200)]
    met = []
    kept = balltree.materialize
    monkeypatch.setattr(balltree, "materialize", lambda df, label: (out := kept(df, label), met.append(out) if label == "ball-met" else None)[0])
    monkeypatch.setattr(balltree, "scratch", lambda spark: __import__("contextlib").nullcontext(lambda df: df))
    got = balltree.top_products(vectors(spark, rows), "vec_id % 50 = 0").toPandas()
    v = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    want = [(q, k + 1, i, -s) for q in range(0, 1200, 50) for k, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in range(1200) if i != q)[:5])]
    same(got, pd.DataFrame(want, columns=["query_id", "rank", "vec_id", "score"]))
    pairs = sum(m.agg(F.coalesce(F.sum(F.octet_length("places") / 8), F.lit(0))).first()[0] for m in met)
    assert pairs < 24 * 24 / 2  # of 24 queries and some 24 shards or more


def held_out(got, labels, name):
    pdf = got.join(labels, "doc_id").toPandas()
    return pdf[pdf.held_out], pdf[~pdf.held_out]


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("run", "label", "least"), [(queries.op5_toxicity_nnpu, "toxic", 0.9), (queries.op8_quality_trees, "quality", 0.97)])
def test_classifiers_on_held_out_rows(spark, run, label, least):
    sf = "/root/testdata/sf0.1"
    got = run(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out, _ = held_out(got, spark.read.parquet(f"{sf}/labels.parquet"), label)
    assert auc(out[label].to_numpy(), out.score.to_numpy()) > least and (out.predicted == out[label]).mean() > 0.93
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> cast(score >= 0.3 AS int)").count() == 0


def test_classifiers_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "ugly word" if i % 2 else "nice word", "en", "s", 1) for i in range(80)] + [(None, "", None, None, None)] * 2, DOCS).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    for run in (toxicity.toxicity, quality.quality):
        got = run(docs, labels)
        assert got.count() == 82 and got.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
        assert run(docs, labels.limit(0)).count() == 82 and run(docs.limit(0), labels).count() == 0


def test_scores_ignore_labels_and_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for module, n, rest in ((toxicity, 4, 2), (quality, 5, 0)):
        flipped = labels.withColumns({c: F.when(common.crc_mod("doc_id", n) == rest, 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
        run = getattr(module, module.__name__.rpartition(".")[2])
        same(run(docs, labels).toPandas(), run(docs, flipped).toPandas())


def test_flat_trees_as_recursion():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = (x[:, 1] * x[:, 3] > 0).astype(float)
    f = quality.fit_forest(x, y)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.9

    def walk(t, row, node=0, depth=0):
        if depth == quality.DEPTH:
            return f.value[t][node - (2**quality.DEPTH - 1)]
        return walk(t, row, 2 * node + 1 + (row[f.feature[t][node]] > f.cut[t][node]), depth + 1)

    plain = [1 / (1 + np.exp(-(f.bias + sum(walk(t, r) for t in range(len(f.value)))))) for r in x[:20]]
    assert np.allclose(plain, f.score(x[:20]))



def test_nnpu_as_a_plain_estimator(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rng = np.random.default_rng(4)
    xp, xu = (rng.random((n, 6)) < share for n, share in ((30, 0.6), (90, 0.2)))
    places = lambda x: [np.flatnonzero(r).tolist() for r in x]
    model = toxicity.fit_nnpu(list("abcdef"), places(xp), places(xu), 0.4)

    prior, w = 0.4 * toxicity.MARGIN, np.zeros(7)
    w[-1] = np.log(prior / (1 - prior))
    ones = lambda x: np.c_[x, np.ones(len(x))]
    sigmoid = lambda x, v: 1 / (1 + np.exp(-ones(x) @ v))
    clean = lambda v: sigmoid(xu, v).mean() - prior * sigmoid(xp, v).mean()
    m, q, signs = np.zeros(7), np.zeros(7), set()
    for step in range(1, 61):
        sign = 1 if clean(w) >= 0 else -1
        signs.add(sign)
        risk = lambda v, sign=sign: -prior * np.log(sigmoid(xp, v)).mean() + sign * clean(v) + toxicity.DECAY / 2 * (v[:-1] ** 2).sum()
        slope = np.array([(risk(w + d) - risk(w - d)) / 2e-6 for d in np.eye(7) * 1e-6])
        m, q = 0.9 * m + 0.1 * slope, 0.999 * q + 0.001 * slope**2
        w = w - toxicity.RATE * m / (1 - 0.9**step) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    assert signs == {1, -1}
    assert np.allclose([*model.weights.values(), model.bias], w, atol=1e-5)


def test_splits_as_an_exhaustive_search(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 2)
    rng = np.random.default_rng(6)
    x = np.c_[rng.normal(size=(400, 3)), rng.integers(0, 4, 400)]
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 400) > 0).astype(float)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in x.T]
    term = lambda g, h, rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.L2)

    def grow(rows, g, h, depth):
        """Adds a subtree's leaf values to z."""
        best = (1e-9, rows, rows[:0])
        for j in range(x.shape[1]) if depth < quality.DEPTH else ():
            for e in edges[j]:
                right = x[rows, j] > e
                a, b = rows[~right], rows[right]
                if min(h[a].sum(), h[b].sum()) >= quality.LEAST:
                    best = max(best, (term(g, h, a) + term(g, h, b) - term(g, h, rows), a, b), key=lambda t: t[0])
        if depth == quality.DEPTH:
            z[rows] -= quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
            return
        for part in best[1:]:
            if len(part):
                grow(part, g, h, depth + 1)

    z = np.full(400, np.log(y.mean() / (1 - y.mean())))
    for _ in range(2):
        s = 1 / (1 + np.exp(-z))
        grow(np.arange(400), s - y, s * (1 - s), 0)
    assert np.allclose(quality.fit_forest(x, y).score(x), 1 / (1 + np.exp(-z)))


def test_pipeline_stages_of_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, " \t", None, "s", 2), (3, "kind words of a clean text " * 4000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("toxic_score", "Quality_Score", "n", "row", "id", "number", "group", "fp", "size", "of")})
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        if name.startswith("byte"):
            assert got.count() == 5 and got.where("NOT exact").count() == 0
        else:
            assert got.columns == docs.columns and got.where("doc_id = 3 AND n = 7").count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, SF).select("doc_id").collect()) == [1, 3]


def test_settings_and_scratch_stay_as_they_were(spark):
    def listed():
        return {os.path.basename(p).rpartition("-")[0] for p in glob.glob(f"{common.shared_dir(spark)}/*")}

    for p in glob.glob(f"{common.shared_dir(spark)}/*"):
        shutil.rmtree(p)
    common.small_batches(spark)  # the one setting that is made
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    for name, run in queries.queries().items():
        run(spark, SF).write.format("noop").mode("overwrite").save()
        # Only what the result itself reads is left.
        assert len(listed()) <= 3, (name, listed())
        for p in glob.glob(f"{common.shared_dir(spark)}/*"):
            shutil.rmtree(p)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in cp.STAGES[:-1]:
        before, out = out, common.materialize(stage(spark, out, SF), "test-stage")
        assert out.columns == docs.columns
        if "mixing" not in name:
            assert 0 < out.count() <= before.count() and out.join(before, "doc_id", "left_anti").count() == 0
    words = lambda d: d.select(mixing.word_count("text").alias("n")).agg(F.sum("n")).first()[0]
    assert words(out) == pytest.approx(1.5 * words(before), rel=0.25)
    last = cp.run(spark, SF)
    assert last.count() == out.count() and last.where("NOT exact").count() == 0
    assert last.agg(F.sum("n_tokens")).first()[0] > 0
