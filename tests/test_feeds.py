"""Filters that go to a feed, and feeds that are followed, against a small server that counts what is asked of it."""

import datetime as dt
import json
import re
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import datasource as ds
from tesserae.sources import feeds

ROWS = [(k, f"name {k % 7}" if k % 11 else None, k / 4, "x'y" if k % 5 == 0 else "z%") for k in range(1000)]


class Feed:
    def __init__(self):
        self.rows, self.asked = list(ROWS), []
        feed = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                feed.asked.append(q)
                con = sqlite3.connect(":memory:")
                con.execute("PRAGMA case_sensitive_like = ON")
                con.execute("CREATE TABLE t (id INT, name TEXT, v REAL, tag TEXT)")
                con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", feed.rows)
                where = q.get("where", "1=1")
                if "offset" in q:
                    names = q.get("fields", "id,name,v,tag").split(",")
                    got = con.execute(f"SELECT {', '.join(names)} FROM t WHERE {where} ORDER BY id LIMIT {q['count']} OFFSET {q['offset']}").fetchall()
                    body = [dict(zip(names, r, strict=True)) for r in got]
                else:
                    body = {"count": con.execute(f"SELECT count(*) FROM t WHERE {where}").fetchone()[0]}
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"
        self.options = {"path": self.url + "?offset={offset}&count={count}&where={where}&fields={fields}", "count": self.url + "?where={where}", "page": "100"}

    def pages(self):
        n = sum("offset" in q for q in self.asked)
        self.asked.clear()
        return n


@pytest.fixture
def feed():
    f = Feed()
    yield f
    f.server.shutdown()


SCHEMA = "id long, name string, v double, tag string"


def test_filters_reach_the_feed(spark, feed):
    feeds.with_feeds(spark)
    load = lambda **o: spark.read.format("paged").schema(SCHEMA).options(**(feed.options | o)).load()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    everything = rows(load())
    assert everything == sorted(ROWS, key=str) and feed.pages() == 10
    local = spark.createDataFrame(ROWS, SCHEMA)
    for where, pages in (("id < 150", 2), ("id >= 900 AND name = 'name 3'", 1), ("name IS NULL AND v > 100.5", 1), ("id IN (5, 7, 900)", 1), ("tag = 'x\\'y' AND id <= 300", 1), ("name LIKE 'name 2%'", 2), ("tag LIKE 'z\\\\%%' AND id < 50", 1), ("id < 120 AND v * 2 > 20", 2), ("id < 0", 1), ("name IS NOT NULL AND id > 800", 2)):
        got = rows(load().where(where))
        assert got == rows(local.where(where)), where
        assert feed.pages() == pages, where
    # A lane reads on until a page is short, where the feed can't count.
    plain = feed.options | {"lanes": "3"}
    del plain["count"]
    got = spark.read.format("paged").schema(SCHEMA).options(**plain).load().where("id < 250")
    assert got.count() == 250 and feed.pages() <= 6
    # Only the fields of the schema are asked for; a filter to begin with holds too.
    few = spark.read.format("paged").schema("id long, v double").options(**feed.options, where="id > 990").load()
    assert rows(few) == sorted([(k, v) for k, _, v, _ in ROWS if k > 990], key=str) and {q["fields"] for q in feed.asked if "offset" in q} == {"id,v"}
    # Without the place for it in the address, Spark filters itself.
    feed.pages()
    blind = feed.options | {"path": re.sub("&where={where}", "", feed.options["path"]), "count": feed.url + "?"}
    assert spark.read.format("paged").schema(SCHEMA).options(**blind).load().where("id < 150").count() == 150 and feed.pages() == 10


def test_a_feed_is_followed(spark, feed, tmp_path):
    feeds.with_feeds(spark)
    run = lambda: spark.readStream.format("paged").schema(SCHEMA).options(**feed.options).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000 and feed.pages() == 10
    feed.rows += [(1000 + k, "new", 0.0, "n") for k in range(150)]
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 1150 and got.where("name = 'new'").count() == 150 and feed.pages() == 2


def test_what_is_not_exact_stays_here():
    c = ("a",)
    assert feeds.remote(ds.EqualTo(c, "it's")) == "a = 'it''s'"
    assert feeds.remote(ds.GreaterThan(c, dt.datetime(2024, 1, 2, 3))) == "a > TIMESTAMP '2024-01-02 03:00:00'"
    assert feeds.remote(ds.LessThanOrEqual(c, dt.date(2024, 1, 2))) == "a <= DATE '2024-01-02'"
    assert feeds.remote(ds.In(c, (1, None, 2))) == "a IN (1, 2)"
    for f in (ds.EqualTo(c, float("nan")), ds.EqualTo(c, True), ds.EqualTo(("a", "b"), 1), ds.EqualTo(("a; DROP",), 1), ds.StringStartsWith(c, "5%"), ds.StringContains(c, "x"), ds.GreaterThan(c, dt.datetime(2024, 1, 1, microsecond=5)), ds.In(c, (None,))):
        assert feeds.remote(f) is None
