"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is two 32-bit halves; two fingerprints that differ in at most 3 bits have
a half that differs in at most one. Each half is a point of the code C = Hamming(31, 26) x {0, 1}: its
codewords are the anchors. The Hamming code is perfect with covering radius 1, so each half has
just one home anchor within that radius; with the threshold of one bit, a neighbour's home lies
within radius 2 of the half itself. So each half is replicated to the 17 (or fewer) anchors within
covering radius plus threshold, and compared there with the halves whose home the anchor is.
No candidate is capped: an anchor with very many homes is split by the bytes of the other half,
one of which two fingerprints within 3 bits must share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, slices, small_batches, spread
from .components import components

#: Position i (1 to 31) of the Hamming code is column i of its check matrix; mask j holds the positions with bit j.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
LOW31 = (1 << 31) - 1
#: Homes of one anchor from which it is split further.
HOT_ANCHOR = 4000
CHUNK = 1 << 15


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles, repeats included, of the words between ASCII white space, A-Z in lower case; fewer words: the whole sequence."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def _majority(h: np.ndarray) -> bytes:
    """Big-endian bytes of the bits that over half of the rows of h (n, k: uint64) have."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for a in range(0, len(h), CHUNK):  # bounded, however long the text is
        ones += np.unpackbits(h[a : a + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8 * h.shape[1]), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles' XXH64 (seed 42) as an unsigned number; no words: 0."""
    s = shingles(text, words)
    if not s:
        return 0
    return int.from_bytes(_majority(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64, len(s))[:, None]), "big")


def _fingerprints(words: int, id_cols: list[str], schema: pa.Schema, sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, same = [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), words)
                h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64, len(s))
                fps.append(int.from_bytes(_majority(h[:, None]), "big") if s else 0)
                if sets:
                    same.append(xxhash.xxh3_128_digest(np.unique(h).tobytes()))
            cols = [b.column(c) for c in id_cols] + [pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(same, pa.binary())] * sets, schema=schema)

    return run


def with_fingerprints(docs: DataFrame, id_cols: list[str], words: int = 3, sets: bool = False) -> DataFrame:
    """id_cols, fp long (the 64 bits as a signed number) and, if asked for, same binary (128 bits of the shingle set), of each row of docs (text)."""
    kinds = dict(docs.dtypes)
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [pa.field(c, to_arrow_type(docs.schema[c].dataType)) for c in id_cols] + [pa.field("fp", pa.int64())] + [pa.field("same", pa.binary())] * sets
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in id_cols), "fp long"] + ["same binary"] * sets)
    return spread(docs.select(*id_cols, "text")).mapInArrow(_fingerprints(words, id_cols, pa.schema(fields), sets), ddl)


def _syndrome(v: Column) -> Column:
    s = F.lit(0)
    for j, mask in enumerate(CHECKS):
        s = s + F.bit_count(v.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
    return s


def _flip(s: str) -> str:
    return f"CASE WHEN {s} = 0 THEN 0L ELSE shiftleft(1L, {s} - 1) END"


def _halves(fps: list[str]) -> str:
    return "array(" + ", ".join(f"named_struct('t', {2 * k + i}, 'v', {x} & 4294967295L, 'o', {y} & 4294967295L)" for k, c in enumerate(fps) for i, (x, y) in enumerate([(c, f"shiftrightunsigned({c}, 32)"), (f"shiftrightunsigned({c}, 32)", c)])) + ")"


def _points(nodes: DataFrame, fps: list[str]) -> DataFrame:
    """One row for each node and half: t its number, v the half, o the other one, s the syndrome of v's low 31 bits."""
    return nodes.withColumn("h", F.explode(F.expr(_halves(fps)))).select(*nodes.columns, "h.t", "h.v", "h.o").withColumn("s", _syndrome(F.col("v").bitwiseAND(F.lit(LOW31))))


def homes(nodes: DataFrame, fps: list[str]) -> DataFrame:
    """Each half at its one anchor within the covering radius."""
    return _points(nodes, fps).withColumn("anchor", F.expr(f"v ^ ({_flip('s')})")).drop("s", "v")


def probes(nodes: DataFrame, fps: list[str]) -> DataFrame:
    """Each half at every anchor within covering radius plus one bit: its home, its home with bit 32 flipped, and those that flip positions i and i ^ s."""
    near = f"concat(array(v ^ ({_flip('s')}), v ^ ({_flip('s')}) ^ 2147483648L), CASE WHEN s = 0 THEN array() ELSE transform(filter(sequence(1, 31), i -> i < (i ^ s)), i -> v ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)) END)"
    return _points(nodes, fps).withColumn("anchor", F.explode(F.expr(near))).drop("s", "v")


def _split_hot(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """sub: what further splits the anchors in hot; rows there go once to each byte of the other half."""
    if hot is None:
        return rows.withColumn("sub", F.lit(-1)).drop("o")
    quarters = F.expr("CASE WHEN is_hot THEN transform(sequence(0, 3), k -> cast(k * 256 + (shiftrightunsigned(o, 8 * k) & 255) as int)) ELSE array(-1) END")
    return rows.join(hot, ["t", "anchor"], "left").withColumn("is_hot", F.col("is_hot").isNotNull()).withColumn("sub", F.explode(quarters)).drop("o", "is_hot")


def anchor_pairs(nodes: DataFrame, fps: list[str], keep: str, within3: bool, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Pairs of rows of nodes that share an anchor and for which keep holds (SQL over a and b: home and probe), as columns a and b.

    Equal for every pair within one bit on some half. within3 says that keep implies 3 bits on the
    whole fingerprint; only then may a hot anchor be split by the bytes of the other half.
    """
    cols = nodes.columns
    home, probe = homes(nodes, fps), probes(nodes, fps)
    hot = None
    if within3:
        hot = materialize(home.groupBy("t", "anchor").count().where(F.col("count") > hot_anchor).select("t", "anchor", F.lit(True).alias("is_hot")), "hot-anchors")
        hot = hot if hot.limit(1).count() else None
    side = lambda df, name: _split_hot(df, hot).select("t", "anchor", "sub", F.struct(*cols).alias(name))
    a, b = side(home, "a"), side(probe, "b").withColumnsRenamed({"t": "pt", "anchor": "panchor", "sub": "psub"})
    return a.join(b, F.expr(f"t = pt AND anchor = panchor AND sub = psub AND ({keep})")).select("a", "b")


def distance(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b})"


def fingerprint_components(prints: DataFrame, id_col: str, max_bits: int = 3, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """prints (id_col long, fp long) with component_id: the smallest id reachable over links of at most max_bits (0 to 3) differing bits.

    Rows of one fingerprint are one node, so copies are not expanded into pairs. Null ids take part
    with their fingerprints but are never a component's name; a component of null ids alone has null. An
    empty table gives an empty one.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two 32-bit halves cover at most 3 differing bits")
    with scratch(prints.sparkSession) as keep:
        return prints.join(keep(materialize(_named(prints, id_col, max_bits, hot_anchor), "simhash-named")), "fp")


def _named(prints: DataFrame, id_col: str, max_bits: int, hot_anchor: int) -> DataFrame:
    """fp and component_id of each fingerprint."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    pairs = anchor_pairs(nodes.select("fp"), ["fp"], f"a.fp < b.fp AND {distance('a.fp', 'b.fp')} <= {max_bits}", True, hot_anchor)
    found = components(pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")), "simhash-links").withColumnRenamed("node", "fp")
    grouped = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    return grouped.join(least, "component").select("fp", "component_id")


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", words: int = 3, max_bits: int = 3) -> DataFrame:
    """id_col, fingerprint string (16 hex digits), component_id of every row of docs (id_col, text).

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows stay and share
    their component; columns other than id_col and text are not read, so their names cannot clash.
    """
    prints = materialize(with_fingerprints(docs, [id_col], words), "simhash-prints")
    return fingerprint_components(prints, id_col, max_bits).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verify(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = []
            for x, y in zip(b.column("text_a"), b.column("text_b"), strict=True):
                p, q = set(shingles(x.as_py(), words)), set(shingles(y.as_py(), words))
                both = len(p & q)
                ok.append(both >= least * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    return run


class _WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_word_hashes = _WordHashes()


def shingle_keys(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit keys, ascending, of the shingles: equal shingles have equal keys, made of their words' hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_word_hashes.__getitem__, w), np.uint64, len(w))
    k = np.full(max(len(h) - words + 1, min(len(h), 1)), len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        k = (k ^ h[i : i + len(k)]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
    return np.unique(k)


#: Slots into which the shingles of all texts are counted, and parts of them; shingles that are counted together before they are sent.
SLOTS, SLOT_PARTS, COUNTED_AT_ONCE = 1 << 27, 2048, 1 << 20
#: A slot is frequent from so many texts on, and four times what the average slot of its part has.
OFTEN = 8


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(37)).astype(np.uint32)


def _slot_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, SLOTS // SLOT_PARTS

        def sent() -> pa.RecordBatch:
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(slots, np.arange(SLOT_PARTS + 1, dtype=np.int64) * size)
            full = [i for i in range(SLOT_PARTS) if cut[i] < cut[i + 1]]
            blob = lambda x: pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())
            # Counts of one sending are as good as 255 from there on: such slots are frequent anyway.
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), blob((slots % size).astype(np.uint16)), blob(np.minimum(counts, 255).astype(np.uint8))], ["part", "slots", "counts"])

        for b in slices(batches):
            for t in b.column("text"):
                held.append(_slot(shingle_keys(t.as_py(), words)))
                n += len(held[-1])
                if n >= COUNTED_AT_ONCE:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    return run


def _frequent_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up one part after another: its rows stand together."""
    held, own = -1, np.zeros(SLOTS // SLOT_PARTS, np.uint32)

    def found() -> pa.RecordBatch:
        bits = np.packbits(own >= OFTEN + 4 * own.mean()).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([bits], pa.binary())], ["part", "bits"])

    for b in batches:
        for part, slots, n in zip(b.column("part").to_pylist(), b.column("slots"), b.column("counts"), strict=True):
            if part != held:
                if held >= 0:
                    yield found()
                held = part
                own[:] = 0
            own[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint8)
    if held >= 0:
        yield found()


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """A bit for each slot of shingles: is it in many texts of docs (text)? Counted over all texts; a fixed 16 MB.

    The bits set the order of the shingles alone: any order finds the same pairs, this one with fewer candidates.
    """
    counted = spread(docs.select("text")).mapInArrow(_slot_counts(words), "part int, slots binary, counts binary")
    out = np.zeros((SLOT_PARTS, SLOTS // SLOT_PARTS // 8), np.uint8)
    for r in counted.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent_slots, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _prefixes(words: int, least: float, frequent: Broadcast, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for b in slices(batches):
            sizes, keys = [], []
            for t in b.column("text"):
                k = shingle_keys(t.as_py(), words)
                slot = _slot(k)
                often = bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
                first = len(k) - max(1, math.ceil(least * len(k) - 1e-9)) + 1 if len(k) else 0
                sizes.append(len(k))
                keys.append(k[np.argsort(often, kind="stable")[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "keys"])

    return run


def prefix_rows(docs: DataFrame, id_col: str, words: int, least: float, nodes: DataFrame) -> DataFrame:
    """key, id, n, pos: the first shingles, in one order for all, of each row of docs that is in nodes (id); n is the size of its set.

    Two sets with a similarity of least or more have their first common shingle in both prefixes.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    sets = spread(docs.select(id_col, "text")).mapInArrow(_prefixes(words, least, frequent, id_col), "id long, n int, keys array<long>")
    return sets.join(nodes, "id").select("id", "n", F.posexplode("keys").alias("pos", "key"))


def _may_be(least: float, n: str, m: str, rest: str, other: str) -> str:
    """SQL: sets of n and m shingles, of which rest and other follow from a first common one on, can have the similarity."""
    return f"least({rest}, {other}) >= {least / (1 + least)!r}D * ({n} + {m}) - 1e-6D"


def hub_pairs(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows whose key others have too, and candidates u, v of each with the hub of its key: the row where the key comes first.

    Hubs link a large group in few pairs; cross_pairs has all the others.
    """
    by_place = Window.partitionBy("key").orderBy("pos", "id")
    met = rows.withColumn("hub", F.first(F.struct("pos", "id", "n")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("id").over(by_place))
    shared = materialize(met.where("id <> hub.id OR next IS NOT NULL").drop("next"), "near-shared")
    found = shared.where(f"id <> hub.id AND {_may_be(least, 'n', 'hub.n', 'n - pos', 'hub.n - hub.pos')}")
    return shared.drop("hub"), found.select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v")).distinct()


def cross_pairs(shared: DataFrame, component: DataFrame, least: float) -> DataFrame:
    """All candidates u < v whose ends are in different components (node, component; others are their own)."""
    live = shared.join(component.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("component", F.coalesce("component", "id"))
    live = materialize(live.withColumn("rest", F.expr("n - pos")), "near-live")
    # Components meet before their members do, so that a large one isn't compared with itself.
    parts = live.groupBy("key", "component").agg(F.min("n").alias("n"), F.max("rest").alias("rest"))
    a, b = parts.alias("a"), parts.alias("b")
    met = a.join(b, F.expr(f"a.key = b.key AND a.component < b.component AND {_may_be(least, 'a.n', 'b.n', 'a.rest', 'b.rest')}")).select("a.key", F.col("a.component").alias("one"), F.col("b.component").alias("other"))
    side = lambda c, x: live.select("key", F.col("component").alias(c), *(F.col(k).alias(f"{x}_{k}") for k in ("id", "n", "rest")))
    pairs = met.join(side("one", "x"), ["key", "one"]).join(side("other", "y"), ["key", "other"]).where(_may_be(least, "x_n", "y_n", "x_rest", "y_rest"))
    return pairs.select(F.least("x_id", "y_id").alias("u"), F.greatest("x_id", "y_id").alias("v")).distinct()


def _linked(docs: DataFrame, id_col: str, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose texts' shingle sets have the similarity."""
    small_batches(docs.sparkSession)
    needed = pairs.select(F.explode(F.array("u", "v")).alias(id_col)).distinct()
    # Joins with texts are the same at every size: neither side's size is bounded.
    texts = materialize(docs.select(id_col, "text").join(needed.hint("merge"), id_col, "left_semi"), "near-texts")
    left = texts.select(F.col(id_col).alias("u"), F.col("text").alias("text_a"))
    right = texts.select(F.col(id_col).alias("v"), F.col("text").alias("text_b"))
    links = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "text_a", "text_b").mapInArrow(_verify(words, similarity), "u long, v long")
    return materialize(links, "near-found")


def near_copies(docs: DataFrame, id_col: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id_col (unique, not null, long) and group: the smallest id of the near copies of each row of docs (id_col, text).

    Rows are linked if their fingerprints over shingles of so many words differ in 3 bits at most, or if the Jaccard
    similarity of their shingle sets is at least similarity (above 0), verified on the whole texts. Candidates of the latter are all pairs of
    distinct sets that prefixes of the sets allow (prefix and positional filter): no link is lost. Only pairs
    whose ends are in one group already are not verified.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        prints = materialize(with_fingerprints(docs, [id_col], words, sets=True), "near-prints")
        first = materialize(fingerprint_components(prints.select(id_col, "fp"), id_col).select(id_col, "component_id"), "near-first")
        # Equal sets are one node.
        nodes = materialize(prints.groupBy("same").agg(F.min(id_col).alias("id")), "near-nodes")
        known = first.select(F.col(id_col).alias("u"), F.col("component_id").alias("v")).unionByName(prints.join(nodes, "same").select(F.col(id_col).alias("u"), F.col("id").alias("v")))
        known = materialize(known.where("u <> v"), "near-known")
        shared, pairs = hub_pairs(prefix_rows(docs, id_col, words, similarity, nodes.select("id")), similarity)
        one = first.select(F.col(id_col).alias("u"), F.col("component_id").alias("cu"))
        other = first.select(F.col(id_col).alias("v"), F.col("component_id").alias("cv"))
        pairs = materialize(pairs.join(one, "u").join(other, "v").where("cu <> cv").select("u", "v"), "near-pairs")
        known = known.unionByName(_linked(docs, id_col, pairs, words, similarity))
        joined = components(known, "near-links")
        rest = materialize(cross_pairs(shared, joined, similarity).join(pairs, ["u", "v"], "left_anti"), "near-rest")
        merged = components(known.unionByName(_linked(docs, id_col, rest, words, similarity)), "near-links").withColumnsRenamed({"node": id_col, "component": "merged"})
        return keep(materialize(first.join(merged, id_col, "left").select(id_col, F.coalesce("merged", id_col).alias("group")), "near-groups"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs with the smallest id of their group of near copies, with all columns.

    If ids repeat or are null, rows are numbered in a copy of docs first; null ids then sort last, equal ids by place in the input.
    Null, empty and wordless texts are copies of one another. Texts of any length are compared whole. Columns other than id_col and text may have any name;
    an empty table gives an empty one.
    """
    n, ids = docs.agg(F.count("*"), F.countDistinct(id_col)).first()
    if n == ids and dict(docs.dtypes)[id_col] == "bigint":
        groups = near_copies(docs, id_col, words, similarity)
        return docs.join(groups.where(F.col(id_col) == F.col("group")).select(id_col).hint("merge"), id_col, "left_semi").select(*docs.columns)
    # The row is one column beside its number, whatever its columns are called.
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*docs.columns).alias("row")), "near-docs")
    ids = F.col("row").getField(id_col)
    groups = near_copies(numbered.select("n", F.col("row").getField("text").alias("text")), "n", words, similarity).join(numbered.select("n", ids.alias("id")), "n")
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("k")).select("k.n")
    return numbered.join(kept.hint("merge"), "n", "left_semi").select("row.*")
