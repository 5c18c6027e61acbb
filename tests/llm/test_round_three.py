"""Importance resampling, the Jaccard join and the filter audit against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tesserae.llm import audit, common, jaccard, resample, slots
from tesserae.llm.queries import oracle_sql, queries

from ..compare import same
from ..conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_filter_audit"])
def test_new_queries_match_sql(spark, duck, name):
    same(queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df())


# Importance resampling

ODD = [None, "", "...", "One", "a b", "A-B c9", "né à x", "日本 語", "x" * 5000 + " " + "y" * 70000 + " z", "a\tb\nc\x00d", "ß1 2", "q" * 300, "one two one two", "ÀÉ Ab"]


def grams(text, longest):
    w = WORD.findall(low(text))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_automaton_finds_all_ngrams(longest):
    column = pa.array(["skipped", *ODD, *ODD * 3, "no"]).slice(1, 4 * len(ODD))
    w = resample.words_of(column)
    bucket, text = resample.ngram_buckets(w, longest, 10_000)
    want = [Counter(zlib.crc32(g.encode()) % 10_000 for g in grams(t, longest)) for t in column.to_pylist()]
    got = [Counter() for _ in want]
    for b, t in zip(bucket.tolist(), text.tolist(), strict=True):
        got[t][b] += 1
    assert got == want
    assert resample.words_of(pa.array([], pa.string())).texts == 0
    large = resample.words_of(pa.array(ODD, pa.large_string()))
    assert large.start.tolist() == resample.words_of(pa.array(ODD)).start.tolist()


def plain_ranks(docs, target, percent=25, longest=2, buckets=50, least=3, seed=7):
    own, want = Counter(), Counter()
    for side, texts in ((own, [t for _, t in docs]), (want, target)):
        for t in texts:
            side.update(zlib.crc32(g.encode()) % buckets for g in grams(t, longest))
    s, t = sum(own.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        g = [gain[zlib.crc32(x.encode()) % buckets] for x in grams(text, longest)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(low(text)))))
    ranked = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(ranked[: len(ranked) * percent // 100], 1)}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=str)


def test_importance_ranks_of_odd_rows(spark):
    random.seed(5)
    docs = [(k, " ".join(random.choices("alpha beta gamma delta Ää 99".split(), k=random.randint(0, 9)))) for k in range(300)]
    docs += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "alpha beta beta gamma")]
    target = ["gamma delta gamma", None, "delta delta Ää"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, Rank int")
    to = spark.createDataFrame([(t,) for t in target], "text string")
    small = {"buckets": 50, "least_words": 3}
    got = resample.importance_ranks(df, to, **small).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_ranks(docs, target)
    drawn = resample.resampled(df, to, **small)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got if r.rank is not None and r.doc_id is not None}
    # Repeated rows are drawn one by one; no rows, no target.
    twice = resample.importance_ranks(df.unionAll(df), to, **small)
    ranks = sorted(r["rank"] for r in twice.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 2 * sum(len(WORD.findall(low(t))) >= 3 for _, t in docs) // 4
    assert resample.importance_ranks(df.limit(0), to).count() == 0
    assert resample.importance_ranks(df, to.limit(0), **small).count() == len(docs)


# Jaccard join


def shingle_set(text, words=3):
    w = SPACE.findall(low(text))
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_components(docs, percent=90, words=3):
    sets = [shingle_set(t, words) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    name = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(sets[i]), name[root(i)]) for i, (d, _) in enumerate(docs)), key=str)


def components_of(spark, docs, **settings):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, n string, node int")
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, **settings).collect()), key=str)


def family(rng, size, members, edits, start):
    """Near copies of one text with chains: each is made of the text or of an earlier member."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    made = [base]
    for _ in range(members - 1):
        w = list(rng.choice(made[-4:] if rng.random() < 0.6 else made[:1]))
        for _ in range(rng.randint(1, edits)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.4:
                w[at] = f"v{rng.randrange(10**6)}"
            elif kind < 0.6:
                w[at:at] = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 6))]
            elif kind < 0.8 and len(w) > 30:
                del w[at : at + rng.randint(1, 6)]
            else:
                w = w + [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(1, 10))]
        made.append(w)
    return [(start + k, " ".join(w)) for k, w in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "PLACES", 4)
    rng = random.Random(seed)
    docs = []
    for size, members, edits in ((60, 25, 2), (200, 40, 5), (120, 30, 4), (400, 25, 12), (14, 20, 1), (90, 60, 3)):
        docs += family(rng, size, members, edits, len(docs))
    line = " ".join(f"l{k}" for k in range(25))  # in very many texts
    docs = [(d, f"{line} {t}" if d % 3 else t) for d, t in docs]
    docs += [(len(docs) + k, f"{line} {' '.join(f'k{rng.randrange(10**5)}' for _ in range(rng.randint(0, 4)))}") for k in range(60)]
    docs += [(len(docs) + k, docs[k][1].upper()) for k in range(0, 40, 3)]
    got = components_of(spark, docs)
    want = plain_components(docs)
    assert got == want
    assert len({c for _, _, c in want}) < len(docs) - 60


def test_jaccard_other_settings_and_odd_rows(spark):
    rng = random.Random(9)
    docs = family(rng, 80, 30, 6, 0) + family(rng, 30, 30, 4, 40)
    for settings in ({"words": 2, "percent": 75}, {"words": 5, "percent": 80}, {"percent": 100}):
        assert components_of(spark, docs, **settings) == plain_components(docs, **settings)
    odd = [(5, None), (4, ""), (3, " \t\n"), (None, "a b"), (9, "A b"), (None, "solo text here"), (None, "solo text here"), (7, "a"), (7, "a"), (7, "other words stand in this row"), (8, "other words stand in this row"), (6, "a b"), (2, " ".join(f"w{k}" for k in range(30_000))), (1, " ".join(f"w{k}" for k in range(29_000)))]
    assert components_of(spark, odd) == plain_components(odd)
    assert components_of(spark, []) == []


def test_batch_keys_are_those_of_the_shingles():
    texts = [None, "", "a", "A b", "a b c", "x" * 200 + " y z", "é ü\u00a0ö c d", "a b c a b c", "one\ttwo\nthree four", "y z " + "x" * 200, "X" * 63 + " " + "y" * 64 + " q r", "x" * 200 + " Y Z", "z"]
    for words in (1, 2, 3, 5):
        column = pa.array(["before", *texts]).slice(1)
        keys = jaccard.batch_keys(column, words)
        sets = [shingle_set(t, words) for t in texts]
        assert [len(k) for k in keys] == [len(s) for s in sets] and all((np.diff(k.astype(object)) > 0).all() for k in keys)
        for (p, a), (q, b) in itertools.combinations(zip(sets, keys, strict=True), 2):
            assert len(p & q) == len(np.intersect1d(a, b))


def test_jaccard_links_that_only_followers_have(spark, monkeypatch):
    """Chains over two followers of different leaders, and over one: found from the leaders' overlaps and the differences."""
    found = []
    plain = jaccard.derived
    monkeypatch.setattr(jaccard, "derived", lambda *a: found.append(plain(*a).count()) or plain(*a))
    docs = []
    for g in range(60):  # what is cut off is seldom in a prefix, so that a follower adds nothing of its own
        base = [f"g{g}w{k}" for k in range(400)]
        y, far = base[:-22], [*base[22:], f"g{g}end"]
        texts = [base] * 3 + [y, y[:-22]] + ([far] * 3 if g % 2 else [])
        docs += [(len(docs) + k, " ".join(w)) for k, w in enumerate(texts)]
    assert components_of(spark, docs) == plain_components(docs)
    assert sum(found) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_links_of_large_groups_are_found_in_blocks(spark, monkeypatch, seed):
    """A leader of many followers and open pairs is dealt to blocks, in which each pair meets each follower once; the links are those of all members."""
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 2)
    monkeypatch.setattr(jaccard, "FOLLOWERS_AT_ONCE", 3)
    rng = random.Random(seed)
    alike = lambda p, q: len(p & q) / len(p | q)
    groups, sets = defaultdict(list), {}
    base = set(range(200))
    for leader in range(14):  # those from 10 on have no followers
        sets[leader] = set(rng.sample(sorted(base), 187)) | {1000 * leader + 1000 + k for k in range(2)}
        for node in range(100 * leader + 100, 100 * leader + 100 + (0 if leader >= 10 else 20 if leader == 3 else 5)):
            own = (sets[leader] - set(rng.sample(sorted(sets[leader]), rng.randint(0, 9)))) | set(rng.sample(sorted(base - sets[leader]), rng.randint(0, 9)))
            if alike(own, sets[leader]) >= 0.9:
                groups[leader].append((node, own))
    slack = {g: max((1 - alike(y, sets[g]) for _, y in groups[g]), default=-jaccard.NEAR) + jaccard.NEAR for g in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b]) < 0.9 and slack[a] + slack[b] > 0]
    members = {g: [sets[g], *(y for _, y in groups[g])] for g in sets}
    linked = {p for p in pairs if any(alike(y, z) >= 0.9 for y in members[p[0]] for z in members[p[1]])}
    rows = [(a, b, len(sets[a]), len(sets[b]), slack[a], slack[b], len(sets[a] & sets[b])) for a, b in pairs]
    follow = [(g, node, len(sets[g]), len(y), sorted(sets[g] - y), sorted(y - sets[g])) for g in groups for node, y in groups[g]]
    with common.scratch(spark):
        found = jaccard.derived(
            spark.createDataFrame(rows, "a long, b long, n_a int, n_b int, slack_a double, slack_b double, both long"),
            spark.createDataFrame(follow, "leader long, node long, n_leader int, n int, minus array<long>, plus array<long>"),
            spark.createDataFrame([(g, sorted(k)) for g, k in sets.items()], "node long, keys array<long>"), 90)
        got = {tuple(sorted(r)) for r in found.collect()}
    assert got == linked and 0 < len(linked) < len(pairs)
    assert any(a >= 10 or b >= 10 for a, b in linked) and any(a < 10 and b < 10 for a, b in linked)
    cuts = jaccard._blocks_of_leaders(spark.createDataFrame([(3, k) for k in range(5)], "a long, b long"), spark.createDataFrame([(3, k) for k in range(20)] + [(4, 1)], "leader long, y long"))
    assert [tuple(r) for r in cuts.collect()] == [(3, 3, 7)]


def test_jaccard_one_large_group_stays_small(spark):
    """Near copies of one text: followers add nothing to the index but what is their own, so that pairs stay few."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for d in range(900):
        w = list(base)
        w[rng.randrange(300)] = f"x{d}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "id long, text string")
    rows = jaccard.set_digests(df, "id", 3)
    nodes = rows.selectExpr("id AS node", "*", "id AS rep", "1L AS copies")
    follow = jaccard.followers(df, "id", nodes, 3, 90)
    assert follow.count() > 850
    assert jaccard.candidates(jaccard.postings(df, nodes, follow, 3, 90), 90).count() < 5000
    assert components_of(spark, docs) == [(d, 298, 0) for d, _ in sorted(docs, key=str)]


# Filter audit


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    fails, parts = {}, defaultdict(list)
    for k, (i, text, source) in enumerate(docs):
        text = text or ""
        w = SPACE.findall(text)
        fails[k] = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs)), strict=True) if bad}
        parts[source or ""].append(k)
    out = []
    for part, rows in parts.items():
        removed, of = {}, []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                removed[f] = removed.get(f, 0) + len(gone)
                earlier = sum(f in fails[k] for k in rows) - len(gone)
                of.append((part, order, step, len(left), len(gone), earlier - sum(f in fails[k] for k in left), sum(fails[k] == {f} for k in rows), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone), f))
        out += [(*r[:-1], removed[r[-1]]) for r in of]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    docs = []
    for k in range(160):
        n = rng.choice([0, 5, 49, 50, 51, 80])
        words = [rng.choice(["aa", "bb", "Cc", "déjà", "日本"]) + (str(rng.randrange(60)) if rng.random() < 0.8 else "") for _ in range(n)]
        docs.append((k, " ".join(words) + rng.choice(["", "", " #", "|"]), rng.choice(["x", "y", None])))
    docs += [(200 + k, docs[rng.randrange(160)][1], "x") for k in range(80)] + [(-k, docs[7][1], "y") for k in range(1, 40)]
    docs += [(None, docs[7][1], "x"), (None, None, None), (3, None, "y"), (2, "", "y"), docs[5], docs[5], (201, "fresh", "x"), (900, "K" * 200_000, "")]
    return docs, [(k, k % 3 == 0 and 1 or 0, k % 5 == 0 and 1 or None) for k in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]


@pytest.mark.parametrize("weak", [False, True])
def test_filter_audit_matches_brute_force(spark, weak):
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, mask int").repartition(5)
    lab = spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], "doc_id long, quality int, toxic int, source string")
    # A weak fingerprint puts different texts into one chain; little held at once makes chains leave early.
    made = audit.filter_audit(df, lab, fingerprint=(lambda raw: len(raw) % 3), held=50) if weak else audit.filter_audit(df, lab)
    assert sorted(tuple(r) for r in made.collect()) == plain_audit(docs, labels)
    assert audit.filter_audit(df.limit(0), lab).count() == 0
    if not weak:
        assert audit.filter_audit(df, lab.limit(0)).groupBy().sum("good_lost").first()[0] == 0


def test_chains_tell_texts_of_one_fingerprint_apart():
    c = audit.Chains()
    gone = []
    for doc_id, raw in ((5, b"a"), (3, b"b"), (7, b"a"), (4, b"a"), (9, b"b"), (4, b"a")):
        gone += c.put(1, raw, doc_id, ["p"])
    assert gone == [(7, ["p"]), (5, ["p"]), (9, ["p"])]
    assert list(c.drain()) == [(1, b"a", 4, ["p", "p"]), (1, b"b", 3, ["p"])] and not c.links
    assert np.array_equal(audit._count(audit._vector(), (5, 3))[:, 5], [1, 1, 1])


# Rows that earlier operators could not take


def test_hostile_gifs_are_error_rows(spark):
    import struct

    from tesserae.llm import gif

    grey = gif._grey()
    good = gif.write_gif(4, 2, grey, [gif.Frame(0, 0, 4, 2, bytes(range(8)), grey, delay_ms=k) for k in (10, 20)])
    claims = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x44\x01\0\x3b"
    frame = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x44\x01\0\x3b"
    second = good[:-1] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 2, 0) + b"\x08\x02\xff\xff\0\x3b"
    rows = [(1, good), (2, claims), (3, frame), (4, second), (5, b"GIF89a"), (6, b"GIF89a\xff\xff"), (7, good[:40]), (8, None), (9, b"")]
    rows += [(100 + k, good[:k] + bytes([good[k] ^ 0xFF]) + good[k + 1 :]) for k in range(0, len(good), 7)]
    df = spark.createDataFrame(rows, "k int, m binary")
    got = gif.decode_column(df, "k", "m", most=1 << 16).select("k", "frame", "error").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.frame, r.error))
    assert by[1] == [(0, None), (1, None)] and 8 not in by
    assert all(len(by[k]) == 1 and by[k][0][0] == -1 for k in (2, 3, 4, 5, 6, 7, 9)) and "pixels" in by[2][0][1] and "pixels" in by[3][0][1]


def test_gif_features_against_a_plain_count():
    from tesserae.llm import gif

    for payload in (bytes(range(64)), b"\xff" * 128 + b"\0" * 64, bytes(k * 7 % 256 for k in range(64 * 900))):
        back, feature = gif.unpack(gif.pack(payload))
        counts = Counter(b >> 6 for b in payload)
        rows = len(payload) // gif.WIDTH
        frames = -(-rows // gif.ROWS)
        assert back == payload
        words = dict(x.split("=") for x in feature.split()[1:])
        assert feature.split()[0] == f"{gif.WIDTH}x{min(rows, gif.ROWS)}" and words["frames"] == str(frames) and words["ms"] == str(100 * frames)
        # The last frame leaves the lower part of the one before on the canvas.
        shown = [bytes(payload)] if frames == 1 else [payload[k : k + gif.WIDTH * gif.ROWS] for k in range(0, len(payload), gif.WIDTH * gif.ROWS)]
        if frames > 1:
            shown[-1] = shown[-1] + shown[-2][len(shown[-1]) :]
            counts = Counter(b >> 6 for part in shown for b in part)
        assert [int(x) for x in words["grey"].split(",")] == [counts.get(k, 0) for k in range(4)]


def test_text_ids_are_taken(spark):
    from tesserae.llm import quotes, sharding

    docs = spark.createDataFrame([(f"d{k}", "x" * (k % 9), 1) for k in range(300)] + [(None, "y" * 50_000, 1), ("d1", "x", 1)], "doc_id string, text string, range int")
    got = sharding.shard_by_size(docs).toPandas()
    assert len(got) == 302 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    m = spark.createDataFrame([("c-1", 0, "u", "Where is the old red house?"), ("c-1", 1, "v", "> Where is the old red house?\nDown the road."), (None, 0, "u", "hi")], "conv_id string, turn int, role string, text string")
    assert {(r.conv_id, r.turn): r.reply_to for r in quotes.link_quotes(m).collect()} == {("c-1", 0): None, ("c-1", 1): 0, (None, 0): None}


def test_dangling_revisits_are_errors(spark):
    from tesserae.llm import warc

    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = [(1, 10, "a", "response", None), (1, 10, "a", "response", None), (2, 99, "a", "revisit", 1), (None, 99, "a", "revisit", 1), (3, 5, "b", "response", None)]
    got = warc.resolved(spark.createDataFrame(rows, shape)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in got) == [(0, 10), (1, 10), (1, 10), (2, 10), (3, 5)]
    for bad in ((4, 5, "b", "revisit", 9), (4, 5, "a", "revisit", 3)):
        with pytest.raises(Exception, match="revisit 4 refers to"):
            warc.resolved(spark.createDataFrame([*rows, bad], shape)).collect()


def test_jaccard_bit_sets_grow_with_the_table(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(60)) + f" end{i % 3}") for i in range(90)], "doc_id long, text string")
    sent, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value.nbytes) or own(self, value))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: i // 3 * 3 for i in range(90)}
    assert len(sent) == 4 and max(sent) <= 1 << 16  # 16 MB each, whatever the table, before
    assert slots.power_for(10**12, 8) == slots.MOST and slots.power_for(0, 8) == 16 and 1 << slots.power_for(10**6, 8) >= 8 * 10**6
    for power in (16, 18, 27):
        keys = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = spark.createDataFrame([(int(k),) for k in np.concatenate([keys, keys[:700]]).view(np.int64)], "key long")
        bits = slots.slot_bits(rows, lambda b: iter([b.column("key").to_numpy().view(np.uint64)]), lambda n: n >= 2, power)
        assert len(bits) == 1 << power >> 3 and slots.bit_of(bits, keys[:700]).all()
        assert power < 27 or slots.bit_of(bits, keys[700:]).mean() < 0.01
