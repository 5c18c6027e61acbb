"""Exact Jaccard join of documents' shingle sets, by relations between sets.

Sets are nodes: equal sets are one. Among sets that share a min-hash a leader is chosen, and those whose similarity to it is proven become its followers,
known by what they lack of it and have besides it. Only leaders (and sets without one) put their prefixes into the index; a follower adds the part of its prefix
that its leader's doesn't have. Lists of the index that many sets are in are cut into blocks by size and position, and a set is
sent only to the blocks in which a partner can stand. Jaccard distance is a metric: what is linked to a follower is within the
leader's radius of the leader, so leaders answer with that much slack, and a follower's overlap with any of
its leader's answers follows from the leader's overlap and the two differences, without its set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, slices, spread
from .components import components
from .resample import words_of
from .slots import bit_of, power_for, slot_bits

#: All but ASCII white space is in words.
IN_WORD = np.ones(256, bool)
IN_WORD[[32, *range(9, 14)]] = False
#: Bytes of a word up to which words are hashed all at once.
SHORT = 64
ODD, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: Parts of the range of keys whose smallest key is a min-hash: few for finding leaders (one round each, but for the last part), more for comparing sketches.
QUARTERS, SKETCH, ROUNDS = 4, 16, 3
#: Bits of a set's parity map: two maps differ in no more bits than the sets in elements.
PARITY = 256
#: Columns of a set's digest besides its id, size and hash.
MINS, SKETCHES, MAPS = [f"m{k}" for k in range(ROUNDS)], ["s0", "s1"], [f"b{k}" for k in range(PARITY // 64)]
#: Of a sketch, so many must agree before sets are compared: fewer are hardly ever those of similar sets, and missing some costs time alone.
AGREE = 9
#: Bits for each row, and power of two of the bits at most, of the table that says which rows' sets are needed.
ROW_BITS, MOST_ROW_BITS = 64, 27
#: Slots for each key where keys are counted, and where those in one set alone are told.
COUNTED, ALONE = 2, 8
#: Positions of a frequent key's list are cut into so many blocks over the length of a prefix.
PLACES = 4
#: A key is frequent if it is in so many texts and four times what the average slot has.
OFTEN = 8
NEAR = 1e-9
#: Of a leader, so many open pairs and followers meet in one block, on average.
PAIRS_AT_ONCE, FOLLOWERS_AT_ONCE = 64, 512


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each word: one byte place a step for all short words at once; long words by XXH64."""
    h = np.full(len(start), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-size, kind="stable")
    at, n = start[order], size[order]
    first = int(np.searchsorted(-n, -SHORT, "left"))
    own = h[order]
    for i in range(first):
        own[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + n[i]].tobytes(), 42)
    live = len(n)
    for k in range(SHORT):
        live = first + int(np.searchsorted(-n[first:live], -k, "left"))
        if live == first:
            break
        own[first:live] = (own[first:live] ^ data[at[first:live] + k]) * PRIME
    h[order] = own
    h = (h ^ (h >> np.uint64(32))) * ODD
    return h ^ (h >> np.uint64(29))


def _joined(parts: list[np.ndarray], tag: int) -> np.ndarray:
    k = np.full(len(parts[0]), tag, np.uint64)
    for h in parts:
        k = (k ^ h) * ODD
        k ^= k >> np.uint64(29)
    return k


def batch_keys(column: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text, the distinct 64-bit keys of its shingles, ascending: equal shingles have equal keys. Fewer words: one key of the whole sequence; none: no key."""
    w = words_of(column, IN_WORD)
    h = word_hashes(w.data, w.start, w.size)
    counts = np.bincount(w.of, minlength=w.texts) if len(w.of) else np.zeros(w.texts, np.int64)
    n = len(h) - words + 1
    if n > 0:
        whole = w.of[:n] == w.of[words - 1 :]
        keys = _joined([h[i : i + n] for i in range(words)], words)[whole]
        ends = np.cumsum(np.bincount(w.of[:n][whole], minlength=w.texts))
    else:
        keys, ends = np.zeros(0, np.uint64), np.zeros(w.texts, np.int64)
    last, out = np.cumsum(counts), []
    for t in range(w.texts):
        if counts[t] >= words:
            out.append(np.unique(keys[ends[t - 1] if t else 0 : ends[t]]))
        elif counts[t]:
            out.append(_joined([h[i : i + 1] for i in range(last[t] - counts[t], last[t])], int(counts[t])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lows(keys: np.ndarray, parts: int) -> np.ndarray:
    """The smallest key of each part of the range of keys, or the part's end where it has none."""
    ends = (np.arange(1, parts + 1, dtype=np.uint64) << np.uint64(64 - parts.bit_length() + 1)) - np.uint64(1)
    at = np.searchsorted(keys, np.concatenate([[np.uint64(0)], ends[:-1] + np.uint64(1)]))
    return np.minimum(np.append(keys, ~np.uint64(0))[at], ends)


def _digests(words: int, schema: pa.Schema, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = batch_keys(b.column("text"), words)
            same = [xxhash.xxh3_128_digest(k.tobytes()) for k in sets]
            wide = [_parity(k, max(PARITY, 1 << max(0, len(k) - 1).bit_length())) for k in sets]
            made = np.zeros((len(sets), ROUNDS + 2 + len(MAPS)), np.int64)
            for row, k in zip(made, sets, strict=True):
                row[:ROUNDS] = (_lows(k, QUARTERS)[:ROUNDS] >> np.uint64(1)).view(np.int64)
                row[ROUNDS : ROUNDS + 2] = ((_lows(k, SKETCH) * ODD) >> np.uint64(56)).astype(np.uint8).view(np.int64)
                row[ROUNDS + 2 :] = _parity(k, PARITY)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([len(k) for k in sets], pa.int32()), pa.array(same, pa.binary()), *(pa.array(c) for c in made.T), pa.array(wide, pa.list_(pa.int64()))], schema=schema)

    return run


def _parity(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each value of the keys' low bits: do an odd number of keys have it? As 64-bit numbers; a map of half the bits is the halves' exclusive or."""
    return np.packbits((np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def set_digests(docs: DataFrame, id_col: str, words: int) -> DataFrame:
    """id_col, n (distinct shingles), same (128 bits of the set), min-hashes, sketch, parity map and a wide one (about a bit for each element) of each row of docs (id_col, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    numbers = [*MINS, *SKETCHES, *MAPS]
    schema = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)), ("n", pa.int32()), ("same", pa.binary()), *((c, pa.int64()) for c in numbers), ("wide", pa.list_(pa.int64()))])
    ddl = ", ".join([f"`{id_col}` {dict(docs.dtypes)[id_col]}", "n int", "same binary", *(f"{c} long" for c in numbers), "wide array<long>"])
    return spread(docs.select(id_col, "text")).mapInArrow(_digests(words, schema, id_col), ddl)


def _row_slot(id_col: str, power: int) -> Column:
    return F.expr(f"xxhash64(`{id_col}`) & {(1 << power) - 1}L")


def _marks(nodes: DataFrame, power: int) -> np.ndarray:
    """A bit for each of 2 ** power slots of ids, set for those of nodes (rep): 16 MB at most, whatever is needed."""
    spot = _row_slot("rep", power)
    bits = nodes.select(F.bitmap_bucket_number(spot + 1).alias("b"), F.bitmap_bit_position(spot + 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(1 << power >> 3, np.uint8)
    for r in bits.collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _needed(words: int, marks: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for b in slices(batches):
            slot = b.column("slot").to_numpy()
            wanted = b.column("text").filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            keys = batch_keys(wanted, words)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(k.tobytes()) for k in keys], pa.binary()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))], ["same", "keys"])

    return run


def sets_of(docs: DataFrame, id_col: str, nodes: DataFrame, words: int, *more: str) -> DataFrame:
    """node, keys and more columns of nodes (node, rep, same): made again from the texts of the rows whose ids are marked, so that other texts stay where they are."""
    power = power_for(docs.count(), ROW_BITS, MOST_ROW_BITS)
    marks = docs.sparkSession.sparkContext.broadcast(_marks(nodes, power))
    made = spread(docs.select("text", _row_slot(id_col, power).alias("slot"))).mapInArrow(_needed(words, marks), "same binary, keys array<long>")
    one = made.groupBy("same").agg(F.first("keys").alias("keys"))
    return materialize(one.join(nodes.select("node", "same", *more), "same").select("node", "keys", *more), "jaccard-sets")


def may_follow(nodes: DataFrame, percent: int) -> DataFrame:
    """leader, node, n_leader, n: whom a node may follow, by sizes and sketches alone; no leader follows.

    One round for each min-hash: of the nodes with it, that with the most followers leads (then that with the most copies, then the smallest); those without followers whose sketch
    agrees leave. Nothing depends on who is found here but how much is left to join.
    """
    live, found = nodes.select("node", "n", "copies", *MINS, *SKETCHES).withColumn("led", F.lit(0).cast("long")), None
    for m in MINS:
        rank = F.struct((-F.col("led")).alias("led"), (-F.col("copies")).alias("copies"), "node", "n", *SKETCHES)
        lead = live.groupBy(m).agg(F.min(rank).alias("l"), F.count("*").alias("together")).where("together > 1")
        lead = lead.select(m, F.col("l.node").alias("leader"), F.col("l.n").alias("n_leader"), *(F.col(f"l.{c}").alias(f"its_{c}") for c in SKETCHES))
        alike = " + ".join(f"CAST(((shiftrightunsigned({c} ^ its_{c}, {8 * i})) & 255L) = 0 AS INT)" for c in SKETCHES for i in range(8))
        pairs = live.where("led = 0").select("node", "n", m, *SKETCHES).join(lead, m).where(f"node <> leader AND 100L * least(n, n_leader) >= {percent}L * greatest(n, n_leader) AND {alike} >= {AGREE}")
        pairs = materialize(pairs.select("leader", "node", "n_leader", "n"), "jaccard-may-follow")
        found = pairs if found is None else found.unionByName(pairs)
        if m != MINS[-1]:
            live = live.join(pairs.select("node"), "node", "left_anti").join(pairs.groupBy(F.col("leader").alias("node")).agg(F.count("*").alias("more")), "node", "left")
            live = materialize(live.withColumn("led", F.col("led") + F.coalesce("more", F.lit(0))).drop("more"), "jaccard-live")
    return found


def followers(docs: DataFrame, id_col: str, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """leader, node, n_leader, n, minus, plus: sets whose similarity to the leader that they follow is proven. minus is what a follower lacks, plus what it has besides."""
    pairs = may_follow(nodes, percent)
    needed = pairs.select("node", F.lit(False).alias("leads")).unionByName(pairs.select(F.col("leader").alias("node")).distinct().withColumn("leads", F.lit(True)))
    sets = sets_of(docs, id_col, nodes.join(needed, "node"), words, "leads")
    own, its = sets.where("NOT leads").select("node", F.col("keys").alias("own")), sets.where("leads").select(F.col("node").alias("leader"), F.col("keys").alias("its"))
    both = pairs.join(own, "node").join(its, "leader")
    apart = both.select("leader", "node", "n_leader", "n", F.array_except("its", "own").alias("minus"), F.array_except("own", "its").alias("plus"))
    return materialize(apart.where(f"100L * (n_leader - size(minus)) >= {percent}L * (n + size(minus))"), "jaccard-followers")


def _prefixes(words: int, percent: int, frequent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for b in slices(batches):
            same, rare, keys = [], [], []
            for k in batch_keys(b.column("text"), words):
                often = bit_of(bits, k)
                first = len(k) - -(-percent * len(k) // 100) + 1 if len(k) else 0
                same.append(xxhash.xxh3_128_digest(k.tobytes()))
                rare.append(int((~often).sum()))
                keys.append(np.concatenate([k[~often], k[often]])[:first].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array(rare, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["same", "rare", "keys"])

    return run


def _shared(bits: Broadcast, schema: pa.Schema):
    """Of each row's keys, with their positions, those that another row may have too; rows without one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, pos = b.column("keys"), b.column("pos")
            kept = bit_of(bits.value, keys.flatten().to_numpy().view(np.uint64))
            ends = np.concatenate([[0], np.cumsum(kept)])[np.asarray(keys.offsets) - keys.offsets[0].as_py()].astype(np.int32)
            lists = {n: pa.ListArray.from_arrays(pa.array(ends), c.flatten().filter(pa.array(kept))) for n, c in (("keys", keys), ("pos", pos))}
            whole = pa.RecordBatch.from_arrays([lists.get(f.name, b.column(f.name)) for f in schema], names=schema.names)
            yield whole.filter(pa.array(np.diff(ends) > 0))

    return run


def postings(docs: DataFrame, nodes: DataFrame, follow: DataFrame, words: int, percent: int) -> DataFrame:
    """key, node, grp, n, pos, slack, own, often and the parity map: the index. grp is the leader's node or the own one; own is false for what a follower adds.

    Keys stand in one order for all sets, frequent ones last. slack is a leader's radius, the largest distance of a follower.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    texts = lambda b: (k for piece in slices([b]) for k in batch_keys(piece.column("text"), words))
    shingles = nodes.agg(F.sum(F.col("n").cast("long") * F.col("copies"))).first()[0] or 0
    frequent = broadcast(slot_bits(spread(docs.select("text")), texts, lambda n: n >= OFTEN + 4 * n.mean(), power_for(shingles, COUNTED)))
    # Who leads and who follows is joined to the nodes before their keys come, so that these are shuffled once.
    radius = follow.groupBy("leader").agg(F.max(F.expr(f"1D - (n_leader - size(minus)) / CAST(n + size(minus) AS DOUBLE) + {NEAR}D")).alias("slack")).withColumnRenamed("leader", "node")
    roles = nodes.select("node", "n", "same", *MAPS).join(follow.select("node", "leader"), "node", "left").join(radius, "node", "left")
    made = spread(docs.select("text")).mapInArrow(_prefixes(words, percent, frequent), "same binary, rare int, keys array<long>")
    made = made.groupBy("same").agg(F.first("rare").alias("rare"), F.first("keys").alias("keys")).join(roles, "same").drop("same")
    made = materialize(made, "jaccard-prefixes")
    columns = ["node", "grp", "n", "rare", *MAPS, "slack", "own", "keys", "pos"]
    lead = made.where("leader IS NULL").withColumns({"grp": F.col("node"), "slack": F.coalesce("slack", F.lit(0.0)), "own": F.lit(True), "pos": F.sequence(F.lit(0), F.size("keys") - 1)})
    theirs = made.where("leader IS NULL AND slack IS NOT NULL").select(F.col("node").alias("leader"), F.col("keys").alias("led"))
    added = made.where("leader IS NOT NULL").join(theirs, "leader").withColumns({"new": F.array_except("keys", "led"), "grp": F.col("leader"), "slack": F.lit(0.0), "own": F.lit(False)}).where("size(new) > 0")
    added = added.withColumn("pos", F.expr("transform(new, k -> CAST(array_position(keys, k) - 1 AS INT))")).drop("keys").withColumnRenamed("new", "keys")
    entries = materialize(lead.select(*columns).unionByName(added.select(*columns)), "jaccard-entries")
    # Most keys of prefixes are in one set alone: they meet nobody and are left out.
    indexed = entries.agg(F.sum(F.size("keys"))).first()[0] or 0
    shared = broadcast(slot_bits(entries.select("keys"), lambda b: iter([b.column("keys").flatten().to_numpy().view(np.uint64)]), lambda n: n >= 2, power_for(indexed, ALONE)))
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = entries.mapInArrow(_shared(shared, to_arrow_schema(entries.schema)), entries.schema)
    index = kept.select(*(c for c in columns if c not in ("keys", "pos")), F.explode(F.arrays_zip("keys", "pos")).alias("e")).select("*", F.col("e.keys").alias("key"), F.col("e.pos").alias("pos"))
    return materialize(index.withColumn("often", F.expr("pos >= rare")).drop("rare", "e"), "jaccard-index")


def _least_overlap(t: str, a: str, b: str) -> str:
    """SQL: what sets of a and b elements have in common at least, if their similarity is t."""
    return f"({t}) / (1D + ({t})) * ({a} + {b}) - 1e-6D"


def _blocks(percent: int) -> tuple[str, str]:
    """SQL arrays of the blocks that a row of a frequent key's list stands in (one), and that it probes.

    Two sets have a size band of at most one apart, as bands are as wide as the least ratio of sizes that any slack leaves. Of two sets with no slack, the first common key has positions
    whose sum is at most what one may lack, so of the places (shares of a prefix) those too far down for the prober's own are skipped.
    """
    t = percent / 100
    ratio = max(0.05, 1 - 3 * (1 - t) - 1e-6)  # slack on both sides
    band = f"CAST(floor(ln(n) / {-math.log(ratio)!r}D + 1e-9D) AS INT)" if ratio < 1 else "n"
    width = max((1 - t) / PLACES, 1e-6)
    place = f"CAST(least(floor(pos / (n * {width!r}D)), {PLACES - 1}) AS INT)"
    free = "(own AND slack = 0D)"
    number = lambda s, v, f: f"(({s}) * {2 * PLACES} + 2 * ({v}) + {f})"
    stand = f"array({number(band, place, f'CAST({free} AS INT)')})"
    c = (1 - t) / (1 + t)  # share of both sizes that the positions of a first common key add up to at most; the partner is up to 1 / t times as large
    reach = [[v for v in range(PLACES) if v * width <= c + (c - u * width) * (1 if u * width <= c else t) + NEAR] for u in range(PLACES)]
    chosen = "CASE " + " ".join(f"WHEN {place} = {u} THEN array({', '.join(map(str, vs))})" for u, vs in enumerate(reach)) + " END"
    every = f"array({', '.join(map(str, range(PLACES)))})"
    combos = f"concat(transform(CASE WHEN {free} THEN {chosen} ELSE {every} END, v -> 2 * v + 1), transform({every}, v -> 2 * v))"
    probe = f"flatten(transform(array({band}, {band} + 1), s -> transform({combos}, c -> s * {2 * PLACES} + c)))"
    whole = "array(-1)"
    return f"CASE WHEN often THEN {stand} ELSE {whole} END", f"CASE WHEN often THEN {probe} ELSE {whole} END"


def candidates(index: DataFrame, percent: int) -> DataFrame:
    """a, b, n_a, n_b, slack: pairs of nodes of different groups that may have the similarity less both slacks; a is the smaller set."""
    stand, probe = _blocks(percent)
    side = lambda blocks, x: index.select("key", F.explode(F.expr(blocks)).alias("block"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "grp", "n", "pos", "slack", "own", *MAPS)))
    t = f"({percent / 100!r}D - slack_a - slack_b)"
    need = _least_overlap(t, "n_a", "n_b")
    # The first common key has nothing common before it; of a follower's added keys, any may be the first that is seen.
    before = "CASE WHEN own_a AND own_b THEN 0 ELSE least(pos_a, pos_b) END"
    apart = f"(NOT (own_a AND own_b) OR pos_a + pos_b <= n_a + n_b - 2D * ({need}))"
    # Sets differ in at least as many elements as their parity maps in bits.
    differ = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in MAPS)
    apart = f"{apart} AND {differ} <= n_a + n_b - 2D * ({need})"
    met = side(probe, "a").join(side(stand, "b"), ["key", "block"]).where(f"(n_a < n_b OR (n_a = n_b AND node_a < node_b)) AND grp_a <> grp_b AND n_a >= {t} * n_b - 1e-6D AND {before} + least(n_a - pos_a, n_b - pos_b) >= {need} AND {apart}")
    return met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.first("slack_a").alias("slack_a"), F.first("slack_b").alias("slack_b"))


def compared(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (candidates) whose wide parity maps don't rule them out, so that few sets have to be fetched: maps differ in no more bits than the sets in elements."""
    wide = nodes.select("node", "wide")
    met = pairs.join(wide.withColumnsRenamed({"node": "a", "wide": "wide_a"}), "a").join(wide.withColumnsRenamed({"node": "b", "wide": "wide_b"}), "b")
    m = "least(size(wide_a), size(wide_b))"
    folded = lambda x: f"transform(sequence(0, {m} - 1), i -> aggregate(sequence(i, size({x}) - 1, {m}), 0L, (s, j) -> s ^ {x}[j]))"
    differ = f"aggregate(zip_with({folded('wide_a')}, {folded('wide_b')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    need = _least_overlap(f"{percent / 100!r}D - slack_a - slack_b", "n_a", "n_b")
    return met.where(f"{differ} <= n_a + n_b - 2D * ({need})").drop("wide_a", "wide_b")


def _blocks_of_leaders(ways: DataFrame, led: DataFrame) -> DataFrame:
    """leader, down, across: into how many parts a leader's open pairs and its followers are dealt. A row for each leader of both."""
    pairs = ways.groupBy(F.col("a").alias("leader")).agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).alias("down"))
    return pairs.join(led.groupBy("leader").agg(F.ceil(F.count("*") / FOLLOWERS_AT_ONCE).alias("across")), "leader")


def derived(open_pairs: DataFrame, follow: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: those of open_pairs (a, b, n_a, n_b, slack_a, slack_b, both: their overlap) of which some members are linked. Followers' overlaps follow from their leaders' and the differences.

    Members of a group are linked through their leader, so that one link between two groups is enough: no join here gives more than the members that a pair's other end
    may still be linked to, or each pair once. A leader of many followers or pairs is dealt to several blocks, in which each pair meets each follower once.
    """
    t = percent / 100
    # The end with a group is a; if both have one, pairs come both ways below.
    turned = open_pairs.select(*(F.col(x).alias(y) for x, y in (("b", "a"), ("a", "b"), ("n_b", "n_a"), ("n_a", "n_b"), ("slack_b", "slack_a"), ("slack_a", "slack_b"), ("both", "both"))))
    ways = open_pairs.select(*turned.columns).unionByName(turned).where("slack_a > 0")
    led = follow.select("leader", F.col("node").alias("y"), F.col("n").alias("n_y"), "minus", "plus")
    cuts = materialize(_blocks_of_leaders(ways, led), "jaccard-blocks")
    led = led.join(cuts, "leader").withColumn("block", F.explode(F.expr("transform(sequence(0L, down - 1), d -> pmod(xxhash64(y), across) * down + d)"))).drop("y", "down", "across")
    # Both are written before arrays come to them: their sizes are known then, and no set is shuffled for a few pairs.
    ways = materialize(ways.join(cuts.withColumnRenamed("leader", "a"), "a"), "jaccard-ways").join(sets.withColumnRenamed("node", "b"), "b").withColumnRenamed("a", "u")
    block = F.explode(F.expr("transform(sequence(0L, across - 1), c -> c * down + pmod(xxhash64(b), down))"))
    # Few of a set's keys are in a difference: the difference is what is hashed, and only where the most that it can add is enough.
    common = "(both - size(array_intersect(keys, minus)) + size(array_intersect(keys, plus)))"
    most = "(both + least(size(plus), n_b - both))"
    at = "u = leader AND w.block = l.block"
    linked = f"{100 + percent}L * {most} >= {percent}L * (n_y + n_b) AND {100 + percent}L * {common} >= {percent}L * (n_y + n_b)"
    one = ways.where("slack_b = 0").withColumn("block", block).alias("w").join(led.alias("l"), F.expr(f"{at} AND {linked}"), "left_semi").select("u", F.col("b").alias("v"))
    # Two groups: of each, the leader and the followers that the other's radius still allows.
    two = ways.where("slack_b > 0")
    least = _least_overlap(f"{t!r}D - slack_b", "n_y", "n_b")
    near = two.withColumn("block", block).alias("w").join(led.alias("l"), F.expr(f"{at} AND {most} >= {least} AND {common} >= {least}"))
    near = near.select("u", "b", "both", F.col("n_y").alias("n"), "minus", "plus", F.expr(common).alias("common"))
    empty = F.array().cast("array<long>")
    near = near.unionByName(two.select("u", "b", "both", F.col("n_a").alias("n"), empty.alias("minus"), empty.alias("plus"), F.col("both").alias("common")))
    y = near.where("u < b").select("u", "b", "both", *(F.col(c).alias(f"y_{c}") for c in ("n", "minus", "plus", "common")))
    z = near.where("u > b").select(F.col("b").alias("zu"), F.col("u").alias("zb"), *(F.col(c).alias(f"z_{c}") for c in ("n", "minus", "plus", "common")))
    shared = "(y_common + z_common - both + size(array_intersect(y_minus, z_minus)) - size(array_intersect(y_plus, z_minus)) - size(array_intersect(y_minus, z_plus)) + size(array_intersect(y_plus, z_plus)))"
    hit = y.join(z, F.expr(f"u = zu AND b = zb AND 100L * {shared} >= {percent}L * (y_n + z_n - {shared})"), "left_semi")
    return one.unionByName(hit.select("u", F.col("b").alias("v"))).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", words: int = 3, percent: int = 90) -> DataFrame:
    """id_col, n_shingles, component_id of each row of docs (id_col, text): rows are linked if the Jaccard similarity of their sets of shingles is at least percent.

    component_id is the smallest id of the rows that links reach, itself included; null ids take part and name nothing (null, if there are only those). Texts with fewer
    words than a shingle have one, the whole sequence; null, empty and wordless texts have none, are linked with nothing and keep their own id. Equal sets
    are compared once, repeated rows share their component, texts of any length are taken whole; an empty table gives an empty
    one. Shingles are compared by 64 bits of hash. Columns other than id_col and text are not read. percent is 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    with scratch(docs.sparkSession) as keep:
        rows = keep(materialize(set_digests(docs.select(F.col(id_col).alias("id"), "text"), "id", words), "jaccard-rows"))
        named = keep(materialize(_named(docs.select(F.col(id_col).alias("id"), "text"), rows, words, percent), "jaccard-named"))
        own = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        linked = rows.where("n > 0").select("id", "n", "same").join(named, "same").select("id", "n", "component_id")
        return own.unionByName(linked).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """same, component_id of each set that isn't empty."""
    nodes = rows.where("n > 0").groupBy("same").agg(F.first("n").alias("n"), F.min("id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in (*MINS, *SKETCHES, *MAPS, "wide")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    # Smaller sets are linked to no other set than their own.
    large = nodes.where(f"{100 - percent}L * n >= {percent}L")
    follow = followers(docs, "id", large, words, percent)
    index = postings(docs, large, follow, words, percent)
    pairs = materialize(compared(materialize(candidates(index, percent), "jaccard-candidates"), large, percent), "jaccard-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(docs, "id", large.join(ends, "node", "left_semi"), words)
    one, other = sets.withColumnsRenamed({"node": "a", "keys": "keys_a"}), sets.withColumnsRenamed({"node": "b", "keys": "keys_b"})
    met = pairs.join(one, "a").join(other, "b").withColumn("both", F.expr("CAST(n_a - size(array_except(keys_a, keys_b)) AS LONG)")).drop("keys_a", "keys_b")
    met = materialize(met.where(f"both >= {_least_overlap(f'{percent / 100!r}D - slack_a - slack_b', 'n_a', 'n_b')}"), "jaccard-met")
    sure = f"100L * both >= {percent}L * (n_a + n_b - both)"
    edges = follow.select(F.col("leader").alias("u"), F.col("node").alias("v")).unionByName(met.where(sure).select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = components(edges, "jaccard-links")
    open_pairs = met.where(f"NOT ({sure})")
    for end in ("a", "b"):
        open_pairs = open_pairs.join(joined.withColumnsRenamed({"node": end, "component": f"c_{end}"}), end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    open_pairs = materialize(open_pairs.where("c_a <> c_b"), "jaccard-open")
    more = materialize(derived(open_pairs, follow, sets, percent), "jaccard-derived")
    if not more.isEmpty():
        joined = components(edges.unionByName(more), "jaccard-links")
    grouped = nodes.select("node", "same", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return grouped.join(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("same", "component_id")
