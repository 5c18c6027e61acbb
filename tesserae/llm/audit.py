"""Audit of how filters interact: what each removes in every order of application.

Copies are found by a fingerprint-routed RDD: texts go by their XXH64 to partitions that keep, for each fingerprint, a chain of the different
texts with it, each whole and with the smallest id seen. Ids above the smallest leave the chain as soon as that is known. Every row ends as
a mask of the filters it fails; combineByKey adds masks up to one vector of counts for each part, from which all orders follow.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes that go on with a character.
CONTINUED = bytes(range(0x80, 0xC0))
#: Bytes of texts that a task holds before its chains are sent on.
HELD = 24 << 20
#: Bytes of texts that a partition of fingerprints gets on average, at most.
ROUTED = 32 << 20
#: What rows without an id are dealt out by.
NO_ID = 4096

OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failing(raw: bytes) -> int:
    """Bits of those of A to D that a text in UTF-8 fails: under 50 words, too few distinct ones, too many capitals, marks."""
    words = raw.split()  # bytes: at ASCII white space only
    points = len(raw.translate(None, CONTINUED))
    short = len(words) < 50
    poor = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * points
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return short | poor << 1 | loud << 2 | marked << 3


def xx64(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 42)


def _spot(doc_id: object) -> int:
    return xxhash.xxh64_intdigest(repr(doc_id).encode(), 7)


class Chains:
    """For each fingerprint a chain of links [text, smallest id, parts of the rows with that id]. put() gives the rows that have become copies for good."""

    def __init__(self) -> None:
        self.links: dict[int, list[list]] = {}
        self.bytes = 0

    def put(self, fp: int, raw: bytes, doc_id: object, parts: list[str]) -> Iterator[tuple[object, list[str]]]:
        chain = self.links.setdefault(fp, [])
        for link in chain:
            if link[0] == raw:
                break
        else:
            chain.append([raw, doc_id, parts])
            self.bytes += len(raw)
            return
        if doc_id == link[1]:
            link[2] = link[2] + parts
        elif doc_id < link[1]:
            yield link[1], link[2]
            link[1:] = [doc_id, parts]
        else:
            yield doc_id, parts

    def drain(self) -> Iterator[tuple[int, bytes, object, list[str]]]:
        for fp, chain in self.links.items():
            for raw, doc_id, parts in chain:
                yield fp, raw, doc_id, parts
        self.links, self.bytes = {}, 0


def _settled(doc_id: object, parts: Iterable[str], mask: int) -> Iterator[tuple[int, tuple]]:
    for p in parts:
        yield _spot(doc_id), (None, doc_id, p, mask)


def _first_chains(fingerprint: Callable[[bytes], int], held: int):
    """(key, (text, id, parts, mask)) for chains, key their fingerprint; (key, (None, id, part, mask)) for rows that are settled."""

    def run(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        chains = Chains()
        for n, (doc_id, text, part) in enumerate(rows):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if doc_id is None:  # neither smaller nor larger than any other
                yield n, (None, None, part, failing(raw))
                continue
            for gone, parts in chains.put(fingerprint(raw), raw, doc_id, [part]):
                yield from _settled(gone, parts, failing(raw) | COPY)
            if chains.bytes > held:
                yield from ((fp, (raw, i, parts, failing(raw))) for fp, raw, i, parts in chains.drain())
        yield from ((fp, (raw, i, parts, failing(raw))) for fp, raw, i, parts in chains.drain())

    return run


def _last_chains(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple[object, str, int]]:
    """(id, part, mask) of every row. Records of a fingerprint stand together, so that only one chain is held."""
    held, chains, masks = None, Chains(), {}

    def rest() -> Iterator[tuple[object, str, int]]:
        for _, raw, doc_id, parts in chains.drain():
            yield from ((doc_id, p, masks[raw]) for p in parts)
        masks.clear()

    for key, (raw, doc_id, parts, mask) in records:
        if raw is None:
            yield doc_id, parts, mask
            continue
        if key != held:
            yield from rest()
            held = key
        masks[raw] = mask
        for gone, those in chains.put(key, raw, doc_id, parts):
            yield from ((gone, p, mask | COPY) for p in those)
    yield from rest()


def failure_masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", fingerprint: Callable[[bytes], int] = xx64, held: int = HELD) -> RDD:
    """(id, part, mask) of every row of docs (id_col, text, part_col): bit k is set if it fails filter k of FILTERS.

    A row fails E if a smaller id has the same text. Equal fingerprints only bring texts together, the texts themselves decide. Copies meet
    within their input partition first, so that a text with very many copies reaches its partition once for each input partition, not for each copy.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(-(-size // ROUTED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col), F.col("text"), F.coalesce(F.col(part_col).cast("string"), F.lit(""))).rdd.map(tuple)
    return rows.mapPartitions(_first_chains(fingerprint, held)).repartitionAndSortWithinPartitions(n, lambda k: k).mapPartitions(_last_chains)


def _vector() -> np.ndarray:
    """rows, good and toxic ones (3) for each mask (32)."""
    return np.zeros((3, 1 << len(FILTERS)), np.int64)


def _count(v: np.ndarray, row: tuple[int, int]) -> np.ndarray:
    mask, flags = row
    v[0, mask] += 1
    v[1, mask] += flags & 1
    v[2, mask] += flags >> 1
    return v


def _orders(part: str, v: np.ndarray) -> list[tuple]:
    """The rows of one part: 120 orders by 5 steps."""
    masks = np.arange(v.shape[1])
    out, gained = [], dict.fromkeys(FILTERS, 0)
    for order in itertools.permutations(FILTERS):
        seen, left = 0, int(v[0].sum())
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (masks & bit) > 0, (masks & seen) > 0
            now = fails & ~gone
            removed, good, toxic = (int(x[now].sum()) for x in v)
            left -= removed
            gained[letter] += removed
            out.append((part, "".join(order), step, left, removed, int(v[0][fails & gone].sum()), int(v[0, bit]), good, toxic, letter))
            seen |= bit
    return [(*r[:-1], gained[r[-1]]) for r in out]


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", fingerprint: Callable[[bytes], int] = xx64, held: int = HELD) -> DataFrame:
    """One row for each value of part_col, order of the filters and step: what is kept, removed, redundant, and so on (OUT).

    labels (id_col, quality, toxic) says which ids are good (quality 1) and toxic (toxic 1); an id with several rows there has what any of them says. A null text is empty, a null part the empty
    string. A row without an id has no label, is no copy and makes none. Rows that repeat an id and its text are both kept by E, if no smaller id has the text. Texts
    of any length are compared whole. An empty docs gives no row. Columns other than these are not read.
    """
    spark = docs.sparkSession
    masks = failure_masks(docs, id_col, part_col, fingerprint, held)
    n = masks.getNumPartitions()
    # Rows without an id meet no label: they are dealt out by the place they have in their partition.
    keyed = masks.mapPartitions(lambda rows: ((("", k % NO_ID) if i is None else i, (p, m)) for k, (i, p, m) in enumerate(rows)))
    flags = labels.select(F.col(id_col).alias("i"), ((F.col("quality") == 1).cast("int")).alias("q"), ((F.col("toxic") == 1).cast("int")).alias("t")).where("i IS NOT NULL AND (q = 1 OR t = 1)")
    flags = flags.groupBy("i").agg(F.coalesce(F.max("q"), F.lit(0)).alias("q"), F.coalesce(F.max("t"), F.lit(0)).alias("t")).rdd.map(lambda r: (r.i, r.q | r.t << 1))
    both = keyed.partitionBy(n, _spot).leftOuterJoin(flags.partitionBy(n, _spot), n)
    counted = both.map(lambda r: (r[1][0][0], (r[1][0][1], r[1][1] or 0))).combineByKey(lambda row: _count(_vector(), row), _count, np.add, min(n, 64))
    return spark.createDataFrame(counted.flatMap(lambda r: _orders(*r)), OUT)


#: DuckDB. Orders are the permutations of the letters; a row's fate in an order follows from its mask.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
n AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p JOIN letters q ON q.bit <> p.bit JOIN letters r ON r.bit NOT IN (p.bit, q.bit) JOIN letters s ON s.bit NOT IN (p.bit, q.bit, r.bit) JOIN letters t ON t.bit NOT IN (p.bit, q.bit, r.bit, s.bit)),
steps AS (SELECT filter_order, s.step::INT AS step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS seen FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
rows AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (seen | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & seen = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & seen > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & seen = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & seen = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM n, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM rows
"""
