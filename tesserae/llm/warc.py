"""WARC archives with a two-level capture index.

Records are written in the order of their reversed-host URL keys, one gzip member each. The index
lines of an archive stand in the same order in compressed blocks; a sparse directory has the first key of each
block. A lookup finds the files whose range of keys holds its key, binary-searches the file's part of the directory, reads the
block's range, and then the record's range. Many lookups go to the files together, each file's in the order of their keys, so
that a block is read once however many keys of it are asked for.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, shared_path, slices, small_batches

#: Lines of an index block; payloads from this size on are stored once; bytes of payload that an archive file aims at, and files at most:
#: larger archives have larger files. Characters of a file's first and last key by which lookups find it.
BLOCK_LINES, REVISIT_BYTES, FILE_BYTES, FILES, ROUTE_CHARS = 500, 1000, 64 << 20, 1 << 15, 256
DATE = "1970-01-01T00:00:00Z"
DIRECTORY_DDL = "first_key string, last_key string, index_file string, offset long, length long, lines int, archive_file string"
PORTS = {"http": 80, "https": 443}


def url_key(url: str | None) -> str:
    """Host labels reversed, then port if unusual, path and query: 'org,example)/a?b'. What is no URL with a host stays as it is, null is ''."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    shown = f":{port}" if port and port != PORTS.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _inflated(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


#: What a URI may hold as it is; all else is written as percent-encoded UTF-8.
URI_SAFE = "%/:=&?~#+!$,;'@()*[]"


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, number: str) -> bytes:
    """A response record, or a revisit of refers_to, whose HTTP header keeps the length of the payload that isn't stored again.

    A response is named by its page and digest, so that revisits can refer to it; responses that agree in both share the name. A URL that
    is no URI as it stands is percent-encoded, and kept beside it; a null URL has none.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda page, more="": f"<urn:page:{'' if page is None else page}:{digest}{more}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {name(page_id, f':{number}' if refers_to is not None else '')}", f"WARC-Date: {DATE}"]
    if url is not None:
        uri = quote(url.encode("utf-8", "surrogatepass"), safe=URI_SAFE)
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:
            head.append(f"X-Target-As-Given: {json.dumps(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_of(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return int(page) if page else None


@dataclass
class Capture:
    """A record as read back; payload is None for a revisit."""

    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload: bytes | None
    payload_bytes: int
    digest: str


def parse(data: bytes) -> Capture:
    """One record; a payload that doesn't match its length or digest is a ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    url = json.loads(fields["X-Target-As-Given"]) if "X-Target-As-Given" in fields else fields.get("WARC-Target-URI")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit:
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return Capture(_page_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"], _page_of(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload, size, digest)


def _writer(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = open_store(folder)
        fs.create_dir(root)
        # Named by attempt: what a lost one left behind is in no directory, and nothing is ever moved or written over.
        archive, index = f"part-{part:05d}-{attempt}.warc.gz", f"part-{part:05d}-{attempt}.cdx.gz"
        lines: list[tuple[str, str]] = []
        directory: list[dict] = []
        at, index_at, seen = 0, 0, 0

        def end_block(out) -> None:
            nonlocal index_at
            if lines:
                packed = _member("".join(f"{k} {rest}\n" for k, rest in lines).encode("utf-8", "surrogatepass"))
                directory.append({"first_key": json.loads(lines[0][0]), "last_key": json.loads(lines[-1][0]), "index_file": index, "offset": index_at, "length": len(packed), "lines": len(lines), "archive_file": archive})
                out.write(packed)
                index_at += len(packed)
                lines.clear()

        batches = slices(batches)
        first = next(batches, None)
        if first is None:
            return
        with closing(fs.open_output_stream(f"{root}/{archive}", compression=None)) as out, closing(fs.open_output_stream(f"{root}/{index}", compression=None)) as cdx:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    key, page_id, url, payload, digest, refers_to = row
                    data = _member(record(url, page_id, payload, digest, refers_to, f"{part}-{seen}"))
                    out.write(data)
                    lines.append((json.dumps(key), json.dumps({"page": page_id, "offset": at, "length": len(data), "type": "revisit" if refers_to is not None else "response", "digest": digest})))
                    at += len(data)
                    seen += 1
                    if len(lines) >= block_lines:
                        end_block(cdx)
                batch = next(batches, None)
            end_block(cdx)
        yield pa.RecordBatch.from_pylist(directory, pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("index_file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32()), ("archive_file", pa.string())]))

    return run


@dataclass
class Archive:
    """Archive files in a shared folder and the sparse directory of their index blocks."""

    folder: str
    directory: DataFrame


def write_archive(pages: DataFrame, id_col: str = "page_id", block_lines: int = BLOCK_LINES, file_bytes: int = FILE_BYTES) -> Archive:
    """Writes a record for every row of pages (id_col, url, html).

    Of the rows with one payload of at least REVISIT_BYTES, those with the largest id are responses and the others revisits; rows
    whose id is null revisit them too, and are responses where no row has an id. Null html is an empty payload, a null
    url has the empty key. Repeated rows are written each; html of any length is one record; an empty table gives an empty directory. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    key = F.udf(url_key, "string", useArrow=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    sized = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    shared = sized.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("digest", "top")
    rows = rows.join(materialize(shared, "warc-shared"), "digest", "left")
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("top")), None).otherwise(F.col("top"))
    rows = rows.select(key("url").alias("key"), "page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    files = min(FILES, max(12, -(-total // file_bytes)))
    folder = shared_path(spark, "warc")
    # Each task names its files by its number, so tasks must not be merged on the way to the directory.
    sorted_rows = rows.repartitionByRange(files, "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")
    return Archive(folder, materialize(sorted_rows.mapInArrow(_writer(folder, block_lines), DIRECTORY_DDL), "warc-directory", 1 << 20))


def _read_block(fs: pafs.FileSystem, root: str, entry: dict) -> list[tuple[str, dict]]:
    with fs.open_input_file(f"{root}/{entry['index_file']}") as f:
        text = _inflated(f.read_at(entry["length"], entry["offset"])).decode("utf-8", "surrogatepass")
    decoder, out = json.JSONDecoder(), []
    for line in text.splitlines():
        key, end = decoder.raw_decode(line)
        out.append((key, json.loads(line[end + 1 :])))
    return out


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _looked_up(folder: str):
    """The captures of the keys that are asked of each index file; its part of the directory stands before them, and they are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        file, entries, firsts, block, keys, lines, source = None, [], [], -1, [], [], None
        try:
            for b in slices(batches):
                found: list[tuple] = []
                for row in b.to_pylist():
                    if row["index_file"] != file:
                        file, entries, firsts, block = row["index_file"], [], [], -1
                        if source is not None:
                            source.close()
                            source = None
                    if row["kind"] == 0:
                        entries.append(row)
                        firsts.append(row["key"])
                        continue
                    at = max(0, bisect.bisect_left(firsts, row["key"]) - 1)
                    while at < len(entries) and firsts[at] <= row["key"]:
                        if at != block:
                            block, (keys, lines) = at, tuple(zip(*_read_block(fs, root, entries[at]), strict=True))
                        for line in lines[bisect.bisect_left(keys, row["key"]) : bisect.bisect_right(keys, row["key"])]:
                            if source is None:
                                source = fs.open_input_file(f"{root}/{entries[at]['archive_file']}")
                            c = parse(_inflated(source.read_at(line["length"], line["offset"])))
                            found.append((c.page_id, c.payload_bytes, c.digest, c.record_type, c.refers_to))
                        at += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*found, strict=True), READ, strict=True)], schema=READ)
        finally:
            if source is not None:
                source.close()

    return run


def _routed(files: Broadcast):
    """Keys of the URLs asked for, once a batch, and the files that may hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, names = files.value
        for b in slices(batches):
            found = []
            for key in {url_key(u) for u in b.column(0).to_pylist()}:
                start = key[:ROUTE_CHARS]
                found += [(names[i], key) for i in range(bisect.bisect_left(high, start), bisect.bisect_right(low, start))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], ["index_file", "key"])

    return run


def captures(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture of the URL keys of urls (url_col).

    A key is looked up once, however often it is asked for; one without a capture gives no row; a null url asks for the captures of null.
    """
    spark = urls.sparkSession
    entries = archive.directory.select("index_file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "offset", "length", "archive_file")
    # FILES rows at most, of bounded length; keys stand in the order of files.
    held = archive.directory.groupBy("index_file").agg(F.substring(F.min("first_key"), 1, ROUTE_CHARS).alias("low"), F.substring(F.max("last_key"), 1, ROUTE_CHARS).alias("high"))
    files = sorted((r.low, r.high, r.index_file) for r in held.collect())
    route = spark.sparkContext.broadcast(tuple(map(list, zip(*files, strict=True))) or ([], [], []))
    lookups = urls.select(url_col).mapInArrow(_routed(route), "index_file string, key string").distinct()
    lookups = lookups.select("index_file", F.lit(1).alias("kind"), "key", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("archive_file"))
    together = entries.unionByName(lookups).repartition(max(12, len(files)), "index_file").sortWithinPartitions("index_file", "kind", "key", "offset")
    return together.mapInArrow(_looked_up(archive.folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class Index:
    """Lookups by URL; holds the sparse directory, a row for each block of lines."""

    def __init__(self, archive: Archive):
        self.fs, self.root = open_store(archive.folder)
        rows = [r.asDict() for r in archive.directory.toLocalIterator()]
        self.blocks = sorted(rows, key=lambda r: (r["first_key"], r["index_file"], r["offset"]))
        self.first = [r["first_key"] for r in self.blocks]

    def find(self, url: str | None) -> list[Capture]:
        """The captures of a URL's key: binary search in the directory, then ranges of blocks and records."""
        key, out = url_key(url), []
        at = max(0, bisect.bisect_left(self.first, key) - 1)
        while at < len(self.blocks) and self.first[at] <= key:
            entry = self.blocks[at]
            lines = _read_block(self.fs, self.root, entry)
            keys = [k for k, _ in lines]
            with self.fs.open_input_file(f"{self.root}/{entry['archive_file']}") as f:
                for _, line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                    out.append(parse(_inflated(f.read_at(line["length"], line["offset"]))))
            at += 1
        return out


def resolved(found: DataFrame) -> DataFrame:
    """found (the columns of captures) with each revisit's payload_bytes as its response has them. A revisit whose response isn't among found, or has another payload, is an error when the result is read."""
    held = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    met = found.join(held, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    lost = F.raise_error(F.format_string("revisit %s refers to %s, which is no response with the payload %s", F.col("page_id").cast("string"), F.col("refers_to").cast("string"), "payload_digest"))
    size = F.when(F.col("record_type") == "revisit", F.coalesce("__bytes", lost)).otherwise(F.col("payload_bytes"))
    return met.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archived_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Every page written to archives, and every capture of the pages' URLs looked up, read back and resolved; the columns of captures, the id as id_col."""
    with scratch(pages.sparkSession) as keep:
        archive = write_archive(pages, id_col)
        found = keep(materialize(captures(archive, pages), "warc-found"))
    return resolved(found).withColumnRenamed("page_id", id_col)


#: DuckDB: what the records must say.
WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id OR page_id IS NULL AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id OR page_id IS NULL THEN top END AS refers_to FROM t
"""
