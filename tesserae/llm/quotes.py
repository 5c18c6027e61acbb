"""Quotation linking: quote levels parsed, quoted passages hashed and joined to the messages they come from, conversations in reply order without quotes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, small_batches

MARKS = re.compile(r"[ \t]*(?:>[ \t]*)+")
SPACE = re.compile(r"[ \t\r\f\v]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rounds that find the first message of a thread; each doubles the depth that is covered.
ROUNDS = 40


def passages(text: str | None) -> list[tuple[int, str]]:
    """(quote level, normalised words) of each run of lines of one level without a blank line; A-Z in lower case, white space as one space."""
    out: list[tuple[int, list[str]]] = []
    joins = False
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        level, body = (m[0].count(">"), line[m.end() :]) if m else (0, line)
        body = SPACE.sub(" ", body).strip(" ").translate(LOWER)
        if not body:
            joins = False
        elif joins and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
            joins = True
    return [(level, " ".join(lines)) for level, lines in out]


def unquoted(text: str | None) -> str:
    """The text without quoted lines, and without white space at its ends."""
    return "\n".join(x for x in (text or "").split("\n") if not MARKS.match(x)).strip(" \t\r\n\f\v")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda p: hashlib.md5(p.encode("utf-8", "surrogatepass")).hexdigest()
    for b in slices(batches):
        found = [passages(t) for t in b.column("text").to_pylist()]
        own = [sorted({digest(p) for level, p in ps if not level}) for ps in found]
        quoted = [[{"level": level, "hash": digest(p)} for level, p in ps if level] for ps in found]
        clean = [unquoted(t) for t in b.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role")), pa.array(clean, pa.string()), pa.array(own, pa.list_(pa.string())), pa.array(quoted, kind)], ["conv_id", "turn", "role", "clean", "own", "quoted"])


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean, quotes, linked, reply_to, root_turn, depth of every row of messages (conv_id, turn, role, text).

    A quoted passage comes from the first message of its conversation with that passage as its own, if that is of an
    earlier turn. quotes: passages quoted; linked: those whose message is found. A message replies to the latest turn that it quotes at
    its lowest level of quotation found; one that quotes nothing found has no reply_to and begins a thread (root_turn: its turn, depth 0).
    Reply order is that of (root_turn, turn): a message follows what it replies to. Null ids or turns take part in no
    link; a null text counts as empty; rows that repeat a turn are kept, and the links of all of them hold for each: the latest
    turn counts. Messages of any length are parsed whole; other columns are not read, so their names cannot clash.
    An empty table gives an empty one. Ids of conversations that are no integers count as text; turns that are no integers are an error.
    """
    small_batches(messages.sparkSession)
    kind = "long" if dict(messages.dtypes)["conv_id"] in ("tinyint", "smallint", "int", "bigint") else "string"
    ddl = f"conv_id {kind}, turn long, role string, clean string, own array<string>, quoted array<struct<level: int, hash: string>>"
    rows = messages.select(F.col("conv_id").cast(kind), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = materialize(rows.mapInArrow(_parsed, ddl), "quotes-parsed")
    wanted = parsed.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash")
    # Partial sums find each passage's first turn, so that no message meets another but through its passage.
    first = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = wanted.join(first, ["conv_id", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    replies = found.where("origin IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("origin"))).alias("m"), F.collect_set("hash").alias("hit"))
    links = materialize(replies.select("conv_id", "turn", (-F.col("m")["col2"]).alias("reply_to"), "hit"), "quotes-links")
    roots = materialize(links.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "quotes-roots")
    for _ in range(ROUNDS if links.limit(1).count() else 0):
        up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        shorter, roots = roots, materialize(roots.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quotes-roots")
        discard(messages.sparkSession, shorter.tesserae_path)
        if not roots.join(roots.select("conv_id", F.col("turn").alias("root")), ["conv_id", "root"], "left_semi").limit(1).count():
            break
    out = parsed.join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    linked = F.when(F.col("hit").isNull(), 0).otherwise(F.size(F.filter("quoted", lambda q: F.array_contains(F.coalesce("hit", F.array().cast("array<string>")), q["hash"]))))
    return out.select("conv_id", "turn", "role", "clean", F.size("quoted").alias("quotes"), linked.alias("linked"), "reply_to", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))



def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, root_turn, turn, reply_to, depth, role, text (without quotes) of every row of messages, sorted in reply order.

    The rows of a conversation stand together, its threads (root_turn) one after another, and a message follows what it
    replies to. A range sort spreads a conversation of any length over tasks, so none is gathered into one row; null ids,
    turns, roles come last, repeated rows side by side. Null texts are empty, other columns are not read.
    """
    linked = link_quotes(messages).withColumnRenamed("clean", "text")
    order = [F.asc_nulls_last(c) for c in ("conv_id", "root_turn", "turn", "role", "text")]
    return linked.select("conv_id", "root_turn", "turn", "reply_to", "depth", "role", "text").orderBy(*order)


#: DuckDB: the same by lines, islands and a recursive walk.
QUOTES_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (
  SELECT id, conv_id, turn, pos, line, regexp_extract(line, '^[ \t]*(>[ \t]*)+') AS mark
  FROM (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m)),
b AS (
  SELECT *, length(mark) - length(replace(mark, '>', '')) AS level,
         translate(trim(regexp_replace(line[length(mark) + 1:], '[ \t\r\f\v]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM l),
n AS (
  SELECT *, CASE WHEN lag(body) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS begins FROM b WINDOW w AS (PARTITION BY id ORDER BY pos)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY pos) AS island FROM n),
p AS (SELECT id, conv_id, turn, level, md5(string_agg(body, ' ' ORDER BY pos)) AS hash FROM i WHERE body <> '' GROUP BY id, conv_id, turn, level, island),
o AS (SELECT conv_id, hash, min(turn) AS origin FROM p WHERE level = 0 GROUP BY conv_id, hash),
f AS (SELECT p.*, CASE WHEN origin < turn THEN origin END AS origin FROM p LEFT JOIN o USING (conv_id, hash) WHERE level > 0),
r AS (SELECT conv_id, turn, arg_min(origin, (level, -origin)) AS reply_to FROM f WHERE origin IS NOT NULL GROUP BY conv_id, turn),
walk AS (
  SELECT conv_id, turn, reply_to AS "at", 1 AS depth FROM r
  UNION ALL SELECT walk.conv_id, walk.turn, r.reply_to, depth + 1 FROM walk JOIN r ON r.conv_id = walk.conv_id AND r.turn = walk."at"),
t AS (SELECT conv_id, turn, arg_max(walk."at", depth) AS root_turn, max(depth)::INT AS depth FROM walk GROUP BY conv_id, turn),
c AS (
  SELECT id, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (mark = ''), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean FROM l GROUP BY id),
q AS (SELECT id, count(*)::INT AS quotes, count(origin)::INT AS linked FROM f GROUP BY id)
SELECT m.conv_id, m.turn, role, sha256(clean) AS clean_sha256, coalesce(quotes, 0) AS quotes, coalesce(linked, 0) AS linked, reply_to, coalesce(root_turn, m.turn) AS root_turn, coalesce(depth, 0) AS depth
FROM m JOIN c USING (id) LEFT JOIN q USING (id) LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
