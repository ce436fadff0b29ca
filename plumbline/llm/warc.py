"""WARC archives with a two-level capture index.

Writing: payload digests are computed in the scan and counted before anything is shuffled; each task then writes its
records, one compressed member each, to archive files of its own in the shared folder, and reports where they are. The
report is a written table: only files it names count, so a task that is run again leaves nothing behind that is read.

Index: captures sorted by reversed-host key are dealt into shards by range. A shard is one file: compressed blocks of
``block_rows`` captures, then a sparse directory with the first key of each block. Lookups sort their keys the same
way; a task finds the shard by binary search in the list of shards (one row for each million captures or so), the
block by binary search in the shard's directory, and reads only those ranges. Records are then read by range too.

Defined cases: a null or empty page is an empty payload; null urls have an empty key and no target header; control
characters in urls are percent-encoded in the header; of equal payloads of at least ``min_bytes`` the row with the
largest id is the response, and so is every row that repeats this id and payload; null ids are smaller than all others;
an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_path, spread_join, table, written
from plumbline.registry import query

DATE = "2000-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20
ENTRY = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
SHARD = pa.schema([("first", pa.string()), ("path", pa.string()), ("directory_at", pa.int64()), ("size", pa.int64()), ("captures", pa.int64())])
RECORD = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} { {'string': 'string', 'int64': 'long', 'binary': 'binary'}[str(f.type)] }" for f in schema)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def digest_header(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def capture_key(url: str = "url", page_id: str = "page_id") -> F.Column:
    """Reversed host, closing bracket, rest of the url; then the page id, which makes captures of one url distinct."""
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    after = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), after, F.lit(" "), F.coalesce(F.col(page_id).cast("string"), F.lit("-")))


def to_write(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Rows (page_id, url, key, payload, digest, refers_to), the payload null for revisits."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), capture_key().alias("key"))
    large = F.octet_length("payload") >= min_bytes
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    rows = spread_join(rows, groups.where("n > 1").select("digest", "response"), ["digest"], "left")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.select("page_id", "url", "key", F.when(~again, F.col("payload")).alias("payload"), "digest", F.when(again, F.col("response")).alias("refers_to"))


def safe_uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, level: int) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {digest_header(digest)}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe_uri(url)}")
    if payload is None:
        head += [
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple:
    """(page_id, record_type, hex digest, refers_to, target_uri, payload) of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:20]!r}")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(named["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {named['WARC-Record-ID']} does not end where it says")
    payload = rest[:size].partition(b"\r\n\r\n")[2] if named["WARC-Type"] == "response" else None
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda k: int(named[k]) if named.get(k) else None
    return number("X-Page-Id"), named["WARC-Type"], digest, number("X-Refers-To-Page-Id"), named.get("WARC-Target-URI"), payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, archive_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Writes all pages (page_id, url, html) as records; the written table of captures (key, file, offset, length)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                done = []
                for r in batch.to_pylist():
                    if out is None or at > archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], level)
                    out.write(member)
                    done.append((r["key"], name, at, len(member)))
                    at += len(member)
                yield rows_of(ENTRY, done)
        finally:
            if out is not None:
                out.close()

    return written(to_write(pages, min_bytes).mapInArrow(write, ddl(ENTRY)), "captures")


def build_index(captures: DataFrame, folder: str, block_rows: int = 1000, shard_rows: int = 1_000_000) -> DataFrame:
    """Writes the index shards; the written list of shards in key order."""
    shards = max(1, math.ceil(captures.count() / shard_rows), captures.sparkSession.sparkContext.defaultParallelism)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        held: list[tuple] = []
        out, path, at, total, directory = None, f"{root}/{uuid.uuid4().hex}.idx", 0, 0, []

        def close_block() -> None:
            nonlocal out, at, total
            if out is None:
                out = files.open_output_stream(path, compression=None)
            block = zlib.compress(json.dumps(held).encode())
            out.write(block)
            directory.append((held[0][0], at, len(block)))
            at, total = at + len(block), total + len(held)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                # captures of one key stay in one block
                if len(held) >= block_rows and held[-1][0] != r["key"]:
                    close_block()
                held.append((r["key"], r["file"], r["offset"], r["length"]))
        if held:
            close_block()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
            out.close()
            yield rows_of(SHARD, [(directory[0][0], path, at, len(tail), total)])

    placed = captures.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return written(placed.mapInArrow(write, ddl(SHARD)), "shards")


class Shards:
    """Binary search in the list of shards, then in a shard's directory, then one range read."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.files = store(folder)[0]
        self.shards = sorted(shards)
        self.firsts = [s[0] for s in self.shards]
        self.open: tuple | None = None
        self.block: tuple | None = None

    def read(self, path: str, at: int, size: int) -> list:
        with self.files.open_input_file(path) as f:
            f.seek(at)
            return json.loads(zlib.decompress(f.read(size)))

    def find(self, key: str) -> list[tuple]:
        k = bisect.bisect_right(self.firsts, key) - 1
        if k < 0:
            return []
        if self.open is None or self.open[0] != k:
            _, path, at, size = self.shards[k][:4]
            directory = self.read(path, at, size)
            self.open, self.block = (k, path, directory, [d[0] for d in directory]), None
        _, path, directory, keys = self.open
        b = bisect.bisect_right(keys, key) - 1
        if self.block is None or self.block[0] != b:
            entries = self.read(path, *directory[b][1:])
            self.block = (b, entries, [e[0] for e in entries])
        _, entries, keys = self.block
        return [tuple(e) for e in entries[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """All captures (key, file, offset, length) of the distinct keys in the column ``key``."""
    listed = [tuple(r) for r in shards.select("first", "path", "directory_at", "size").collect()]
    parts = max(len(listed), 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Shards(folder, listed)
        for batch in batches:
            yield rows_of(ENTRY, [e for key in batch.column("key").to_pylist() for e in index.find(key)])

    return keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(find, ddl(ENTRY))


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of the captures, read by range in file order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        name, source = None, None
        try:
            for batch in batches:
                out, held = [], 0
                for r in batch.to_pylist():
                    if r["file"] != name:
                        if source is not None:
                            source.close()
                        name, source = r["file"], files.open_input_file(f"{root}/{r['file']}")
                    source.seek(r["offset"])
                    out.append(parse(source.read(r["length"])))
                    held += len(out[-1][-1] or b"")
                    if held > BATCH_BYTES:
                        yield rows_of(RECORD, out)
                        out, held = [], 0
                yield rows_of(RECORD, out)
        finally:
            if source is not None:
                source.close()

    parts = captures.sparkSession.sparkContext.defaultParallelism
    return captures.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, ddl(RECORD))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN last ON p.payload_digest = last.payload_digest
"""


@query("op10_warc", SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, builds the index, looks every page up and reads its record back."""
    pages, folder = table(spark, sf_dir, "pages"), fresh_path(spark, "warc")
    shards = build_index(write_archives(pages, f"{folder}/archive"), f"{folder}/index")
    found = look_up(pages.select(capture_key().alias("key")), shards, f"{folder}/index")
    records = read_records(found, f"{folder}/archive")
    records = records.select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").alias("own_bytes"), F.sha1("payload").alias("own_digest"))
    records = written(records, "records")
    responses = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("own_digest").alias("payload_digest"), F.col("own_bytes").alias("response_bytes")).distinct()
    both = spread_join(records, responses, ["refers_to", "payload_digest"], "left")
    return both.select(
        "page_id", F.coalesce("own_bytes", "response_bytes").cast("long").alias("payload_bytes"), F.coalesce("own_digest", "payload_digest").alias("payload_digest"),
        "record_type", "refers_to")
