"""Tokens, quotes, media and archives against other implementations, plain versions and round trips."""

import hashlib
import random
import zlib

import base64
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tesserae.llm import bpe, gif, queries, quotes, warc

from ..compare import same
from ..conftest import SF

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(alphabet=st.sampled_from(list("aabtheing  \n\té1!'sÜ😀")), max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_bpe_as_the_library(own, library, texts):
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in ids] == [t.encode() for t in texts]


def test_bpe_of_long_and_repeating_words(own, library):
    rng = random.Random(4)
    texts = ["a" * 9999, "ab" * 4000, "aaab" * 777, "", "x " * 500, "".join(rng.choice("abcdehilnorst") for _ in range(20000)), "<|endoftext|>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_forgets_and_still_encodes(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for t in ("one two three four five", "six seven one two", "one"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode_ordinary(t)


def test_bpe_rows(spark, library):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = bpe.encode_texts(df, RANKS, P.PATTERN, ["doc_id"], digests=True)
    ids = np.array(library.encode_ordinary("the cat"), "<u4").tobytes()
    empty = hashlib.sha256(b"").hexdigest()
    want = [(1, 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"the cat").hexdigest())] * 2 + [(None, 0, empty, empty), (3, 0, empty, empty)]
    same(got.toPandas(), pd.DataFrame(want, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]))
    assert bpe.encode_texts(df.limit(0), RANKS, P.PATTERN, ["doc_id"]).count() == 0


def test_bpe_query_as_the_library(spark, library):
    got = queries.op3_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text)
        g = got.loc[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


@given(st.binary(max_size=3000), st.sampled_from([2, 5, 8]))
@settings(max_examples=60, deadline=None)
def test_gif_code_stream_round_trip(data, depth):
    samples = bytes(b & (1 << depth) - 1 for b in data)
    assert gif.lzw_decode(gif.lzw_encode(samples, depth), depth, len(samples)) == samples


@pytest.mark.parametrize("n", [0, 1, 2, 3836, 3838, 3840, 9000, 200_000])
def test_gif_code_stream_around_a_full_table(n):
    rng = random.Random(n)
    s = bytes(rng.randrange(256) for _ in range(n))
    assert gif.lzw_decode(gif.lzw_encode(s), 8, n) == s
    assert gif.lzw_decode(gif.lzw_encode(bytes(n)), 8, n) == bytes(n)


def plain_gif_codes(samples, depth):
    """A code stream that never clears its table, written bit by bit."""
    table = {(i,): i for i in range(1 << depth)}
    size, width, out, w = (1 << depth) + 2, depth + 1, [(1 << depth, depth + 1)], ()
    for s in samples:
        if (*w, s) in table:
            w = (*w, s)
            continue
        out.append((table[w], width))
        if size < 4096:
            table[(*w, s)] = size
            size += 1
            if size > 1 << width and width < 12:
                width += 1
        w = (s,)
    out += [(table[w], width)] if w else []
    if size == 1 << width and width < 12:
        width += 1
    bits = "".join(f"{c:0{n}b}"[::-1] for c, n in [*out, ((1 << depth) + 1, width)])
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def late_gif_codes(samples, depth, after):
    """A code stream that clears its table once it has written so many more codes than fill it."""
    full = 4096 - (1 << depth)
    codes, width, table, w = [(1 << depth, depth + 1)], depth + 1, {(i,): i for i in range(1 << depth)}, ()
    size, since = (1 << depth) + 2, 0
    for s in samples:
        if (*w, s) in table:
            w = (*w, s)
            continue
        codes.append((table[w], width))
        since += 1
        if size < 4096:
            table[(*w, s)] = size
            size += 1
            if size > 1 << width and width < 12:
                width += 1
        w = (s,)
        if since == full + after:
            codes.append((1 << depth, width))
            table, width, size, since = {(i,): i for i in range(1 << depth)}, depth + 1, (1 << depth) + 2, 0
    codes.append((table[w], width))
    if size == 1 << width and width < 12:
        width += 1
    bits = "".join(f"{c:0{n}b}"[::-1] for c, n in [*codes, ((1 << depth) + 1, width)])
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("after", [2, 3, 500, 20_000])
def test_gif_stream_cleared_late(after):
    rng = random.Random(after)
    s = [rng.randrange(256) for _ in range(10_000)]
    assert gif.lzw_decode(late_gif_codes(s, 8, after), 8, len(s)) == bytes(s)


def test_gif_streams_of_another_writer():
    rng = random.Random(9)
    for n in (1, 50, 300, 20_000):
        s = [rng.randrange(4) for _ in range(n)]
        assert gif.lzw_decode(plain_gif_codes(s, 2), 2, n) == bytes(s)


def test_gif_animation_rules():
    red_green = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], np.uint8)
    f = lambda samples, **kw: gif.Frame(kw.pop("left", 0), kw.pop("top", 0), 2, len(samples) // 2, bytes(samples), red_green, **kw)
    frames = [f([0, 0, 0, 0], delay_ms=50), f([1, 2], top=1, transparent=2, disposal=3, delay_ms=70), f([1, 1], disposal=2), f([2, 3], top=1, transparent=3)]
    width, height, back = gif.read_gif(gif.write_gif(2, 2, red_green, frames))
    shown = [c[..., :].tolist() for c in map(np.copy, gif.composed(width, height, back))]
    R, G, B, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown == [[[R, R], [R, R]], [[R, R], [G, R]], [[G, G], [R, R]], [[none, none], [B, R]]]
    assert [x.delay_ms for x in back] == [50, 70, 0, 0]


def test_gif_frames_as_rows(spark):
    red = np.array([[255, 0, 0], [0, 0, 0]], np.uint8)
    g = gif.write_gif(2, 1, red, [gif.Frame(0, 0, 2, 1, b"\0\1", red, delay_ms=30), gif.Frame(0, 0, 2, 1, b"\0\0", red, delay_ms=40)])
    df = spark.createDataFrame([(1, bytearray(g)), (2, None), (3, bytearray(b"no gif")), (4, bytearray(g[:-20]))], "k long, m binary")
    got = gif.decode_column(df, "k", "m").orderBy("k", "frame").collect()
    assert [(r.k, r.frame, r.start_ms) for r in got] == [(1, 0, 0), (1, 1, 30), (3, -1, None), (4, -1, None)]
    assert got[0].histogram[48] == 1 and got[0].histogram[0] == 1 and sum(got[1].histogram) == 2 and got[2].error


def test_gif_query_round_trip(spark):
    got = queries.op4_gif_media(spark, SF).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        raw = r.text.encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        g = got.loc[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_gif_store_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 64), (4, "é" * 100_000)], "doc_id long, text string").withColumn("feature", F.lit(1))
    got = {r.doc_id: r for r in gif.stored_texts(df).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 64 and got[1].media_sha256 == got[2].media_sha256
    assert got[None].payload_bytes == 64 and got[4].payload_bytes == 200_000 and "frames=4" in got[4].feature
    assert gif.stored_texts(df.limit(0)).count() == 0


def conversation_rows(seed):
    rng, rows = random.Random(seed), []
    for c in range(25):
        said = []
        for t in range(rng.randint(1, 9)):
            parts = []
            for _ in range(rng.randint(0, 4)):
                if said and rng.random() < 0.6:
                    parts.append("\n".join("> " * rng.randint(1, 2) + x for x in rng.choice(said).split("\n")))
                else:
                    said.append("\n".join(rng.choice(["Alpha  beta", "gamma\tDelta ", "x", "Éta"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 2))))
                    parts.append(said[-1])
                parts += [""] * (rng.random() < 0.7)
            rows.append((c, t, "user", "\n".join(parts)))
    return [*rows, (0, 1, None, None), (0, 1, "u", ""), (None, 1, "u", "> x1"), (3, None, "u", "x1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_as_sql(spark, seed):
    pdf = pd.DataFrame(conversation_rows(seed), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("frame", pdf)
    con.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    df = spark.createDataFrame(conversation_rows(seed), "conv_id long, turn long, role string, text string")
    got = quotes.link_quotes(df).withColumn("clean_sha256", F.sha2("clean", 256)).drop("clean").toPandas()
    assert got.linked.sum() > 20
    same(got, con.execute(quotes.QUOTES_SQL).df())
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_follow_replies(spark):
    rows = [(1, 0, "a", "First point.\n\nSecond  POINT"), (1, 1, "b", "> second point\n\nyes"), (1, 2, "c", "> yes\n>> second point\n\nwhy"), (1, 3, "d", "> never said\n\nhm")]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(4)] == [None, 0, 1, None]
    assert [got[t].depth for t in range(4)] == [0, 1, 2, 0] and [got[t].root_turn for t in range(4)] == [0, 0, 0, 3]
    assert got[2].clean == "why" and (got[2].quotes, got[2].linked) == (2, 2)



def test_conversations_in_reply_order(spark):
    rows = [(2, 0, "a", "Other talk"), (1, 0, "a", "First point.\n\nSecond  POINT"), (1, 1, "b", "New thread"), (1, 2, "c", "> second point\n\nyes"), (1, 3, "d", "> new thread\n\nno"), (1, 4, "e", "> yes\n\nwhy"), (None, 0, "z", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("clean", F.lit("x")).repartition(3)
    got = [tuple(r) for r in quotes.conversations(df).collect()]
    assert got == [
        (1, 0, 0, None, 0, "a", "First point.\n\nSecond  POINT"),
        (1, 0, 2, 0, 1, "c", "yes"),
        (1, 0, 4, 2, 2, "e", "why"),
        (1, 1, 1, None, 0, "b", "New thread"),
        (1, 1, 3, 1, 1, "d", "no"),
        (2, 0, 0, None, 0, "a", "Other talk"),
        (None, 0, 0, None, 0, "z", ""),
    ]


def test_quotes_of_a_very_long_message(spark):
    said = [f"line {i}" for i in range(10_000)]
    rows = [(1, 0, "a", "\n\n".join(said)), (1, 1, "b", "\n\n".join(f"> {x}" for x in said) + "\n\nall of it")]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].quotes, got[1].linked, got[1].reply_to, got[1].clean) == (10_000, 10_000, 0, "all of it")


def page_rows():
    long = "<p>" + "word " * 400
    return [(1, "http://www.b.example.org/x?q=1", long), (2, "https://b.example.org:8443/y", long), (3, None, None), (4, "not a url", "short"), (5, "http://a.example/", "short"), (None, "http://a.example/z", long), (6, "http://a.example/", "é" * 999), (6, "http://a.example/", "é" * 999)]


def test_archive_says_what_sql_says(spark):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(page_rows(), columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    con.execute("CREATE VIEW pages AS SELECT * FROM frame")
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    same(warc.archived_pages(df).toPandas(), con.execute(warc.WARC_SQL).df())
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_lookups_read_only_the_blocks_they_need(spark):
    rows = [(i, f"http://h{i % 7}.example/{'same' if i % 3 == 0 else i}\n{i % 2}", f"page {i} " * (200 if i % 5 else 1), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    archive = warc.write_archive(df, block_lines=4, file_bytes=20_000)
    wanted = df.where("page_id % 10 = 3 OR page_id = 0")
    got = warc.captures(archive, wanted.unionByName(wanted)).toPandas()
    keys = {warc.url_key(r[1]) for r in rows if r[0] % 10 == 3 or r[0] == 0}
    assert sorted(got.page_id) == [i for i, u, _, _ in rows if warc.url_key(u) in keys]
    assert sorted(warc.captures(archive, df).toPandas().page_id) == list(range(300))
    # The directory leads to few blocks: count those that a task reads.
    one = archive.directory.groupBy("index_file").count().first()
    entries = [r.asDict() | {"kind": 0, "key": r.first_key} for r in archive.directory.where(F.col("index_file") == one.index_file).orderBy("first_key", "offset").collect()]
    read = []
    kept = warc._read_block
    warc._read_block = lambda *a: read.append(a[2]["offset"]) or kept(*a)
    try:
        import pyarrow as pa

        ask = entries + [{"index_file": one.index_file, "kind": 1, "key": k, "offset": None, "length": None, "archive_file": None} for k in (entries[0]["first_key"], entries[-1]["last_key"])]
        list(warc._looked_up(archive.folder)(iter([pa.RecordBatch.from_pylist([{k: x[k] for k in ("index_file", "kind", "key", "offset", "length", "archive_file")} for x in ask])])))
    finally:
        warc._read_block = kept
    assert 2 <= len(read) <= 6 and (len(entries) < 6 or len(read) < len(entries))


def test_records_use_standard_fields():
    digest = hashlib.sha1(b"x").hexdigest()
    data = warc.record('http://a/é "b"\r\nX: y', 7, b"x", digest, 9, "3-1")
    assert b"\r\nWARC-Target-URI: http://a/%C3%A9%20%22b%22%0D%0AX:%20y\r\n" in data and f"\r\nWARC-Refers-To: <urn:page:9:{digest}>\r\n".encode() in data
    back = warc.parse(data)
    assert (back.page_id, back.url, back.refers_to, back.payload) == (7, 'http://a/é "b"\r\nX: y', 9, None)
    assert b"WARC-Target-URI" not in warc.record(None, None, b"x", digest, None, "0-0") and warc.parse(warc.record(None, None, b"x", digest, None, "0-0")).page_id is None


def test_index_finds_captures(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    index = warc.Index(warc.write_archive(df, block_lines=2))
    found = index.find("http://a.example/")
    assert sorted(c.page_id for c in found) == [5, 6, 6] and {c.payload for c in found if c.page_id == 6} == {("é" * 999).encode()}
    assert [c.record_type for c in index.find("http://b.example.org/x?q=1")] == ["revisit"] and index.find("http://nowhere.example/") == []
    assert warc.url_key("https://M.B.example:443/p#frag") == "example,b,m)/p"


def test_damaged_record_is_found():
    good = warc.record("http://a/", 1, b"abc", hashlib.sha1(b"abc").hexdigest(), None, "0-0")
    assert warc.parse(good).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"abc", b"abd"))


def test_workers_forget_words_when_another_operator_runs():
    import public_tokenizers
    import pyarrow as pa
    from tesserae.llm import bpe
    from tesserae.llm.common import slices

    own = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    batch = pa.RecordBatch.from_arrays([pa.array(["some zxqvword and qwrtzx words", None])], ["text"])
    encoded = lambda: [ids for _, _, ids in bpe._together(own, iter([batch]), "text")]
    first = encoded()
    assert own.words and own.pairs and encoded() == first and own.words
    assert sum(map(len, slices(iter([batch])))) == 2  # any other operator's batches
    assert not own.words and not own.pairs
    assert encoded() == first
