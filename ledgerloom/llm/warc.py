"""WARC archives with a two-level capture index.

Tasks write records, each a gzip member of its own, into archives of bounded size in the shared
folder; only archives that a finished task names count, so a lost or repeated task leaves no
wrong ones. Archives are read back as streams, record by record. The index holds one line for each
capture in order of its reversed-host URL key, in compressed blocks; a sparse directory has one
row for each block. A look-up bisects the directory, opens the blocks that can hold its key, bisects
their lines, and reads the records' byte ranges, and nothing else of the archives. What a revisit
refers to is found by a second look-up, of the URL that its header names.

Archives are opened with pyarrow's file systems, which know local and shared folders, HDFS and
the usual object stores.
"""

from __future__ import annotations

import base64
import bisect
import contextlib
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .common import keep, new_path

BLOCK = 512
#: An archive ends with the record that brings it to so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Rows of the directory that may be sent to the tasks; beyond it every n-th row is, and n blocks are opened.
DIRECTORY_ROWS = 100_000
#: Keys that look into one block in one task.
KEYS = 20_000
#: Bytes of an archive whose ranges are read in one task.
RANGE_BYTES = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_BREAK = "\r\n\r\n"
_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ENTRY = "surt string, page_id long, url string, record_type string, refers_to long, refers_to_url string, payload_bytes long, payload_digest string, archive string, offset long, length long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]
LONGS = {x.split()[0] for x in ENTRY.split(", ") if x.endswith(" long")}


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, from its hex digits: five of them make four of base 32."""
    digest = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def surt(url: Column) -> Column:
    """Reversed-host key, as `com,example)/path`; empty for null, and the url itself without `://`."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(url)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(value): each page as a WARC record."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    # Ids, digests and urls alone are grouped, never payloads.
    ids = rows.select("digest", "page_id", "url").where(F.col("n") >= least_bytes)
    largest = ids.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("largest"), F.max_by("url", "page_id").alias("largest_url"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    again = ids.join(largest, ids["digest"] == largest["of"]).where(~F.col("page_id").eqNullSafe(F.col("largest"))).select("of", F.col("page_id").alias("id"), "largest", "largest_url").distinct()
    again = keep(again, "revisits")
    rows = rows.join(again, (rows["digest"] == again["of"]) & rows["page_id"].eqNullSafe(again["id"]), "left")
    revisit = F.col("of").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    uri = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.concat(F.lit(_OK), F.when(revisit, "").otherwise(F.col("html")))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
            line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", uri(F.col("url"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("WARC-Refers-To", F.when(revisit, urn(F.col("largest")))), line("WARC-Refers-To-Target-URI", F.when(revisit, uri(F.col("largest_url")))),
            line("Payload-Length", F.col("n").cast("string")), line("URL-Key", F.base64(F.encode(surt(F.col("url")), "UTF-8"))),
            F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body, F.lit(_BREAK),
        ).alias("value")
    )


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, bytes): write every page as a record of some archive.

    Of the pages with equal payloads of `least_bytes` or more, that with the largest page_id
    is a response and the others revisit it; smaller payloads are responses. Null html is an
    empty payload. Rows that repeat the largest page_id are all responses; a row without an id
    revisits if another has one. Null urls have no target line. Payloads are taken whole; an empty
    table gives no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            done = []
            for value in batch.column("value"):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    files, at = opened(path)
                    files.create_dir(at.rsplit("/", 1)[0])
                    out = files.open_output_stream(at, compression=None)
                size += out.write(zlib.compress(value.as_py().encode(), LEVEL, wbits=31))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
            if done:
                yield listed(done)
        if out is not None:
            out.close()
            yield listed([(path, n, size)])

    def listed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])

    return keep(records(pages, least_bytes).mapInArrow(run, "archive string, records long, bytes long"), "archives")


def fields_of(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def _id(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def _url(uri: str | None) -> str | None:
    return uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def payload_of(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; a response's payload must be that of its header."""
    head, _, rest = record.partition(_BREAK.encode())
    fields = fields_of(head)
    payload = rest[: int(fields["Content-Length"])].split(_BREAK.encode(), 1)[1]
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
        if (found, len(payload)) != (fields["WARC-Payload-Digest"][5:], int(fields["Payload-Length"])):
            raise ValueError(f"the payload of {fields.get('WARC-Record-ID')} isn't that of its header")
    return fields, payload


def entry_of(record: bytes, archive: str, offset: int, length: int) -> tuple:
    """An index line."""
    f = fields_of(record.partition(_BREAK.encode())[0])
    return (
        base64.b64decode(f["URL-Key"]).decode(), _id(f.get("WARC-Record-ID")), _url(f.get("WARC-Target-URI")), f["WARC-Type"], _id(f.get("WARC-Refers-To")), _url(f.get("WARC-Refers-To-Target-URI")),
        int(f["Payload-Length"]), f["WARC-Payload-Digest"][5:], archive, offset, length,
    )


def members(stream: io.IOBase, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream; one member is held at a time."""
    at, data = 0, stream.read(chunk)
    while data:
        inflate, parts, used = zlib.decompressobj(wbits=31), [], 0
        while not inflate.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
            parts.append(inflate.decompress(data))
            used += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        yield at, used, b"".join(parts)
        at += used
        data = data or stream.read(chunk)


def scan_archives(archives: DataFrame) -> DataFrame:
    """Read archives (archive, ...) as streams, record by record, into index lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, at = opened(archive)
                with files.open_input_stream(at, compression=None) as stream:
                    rows = []
                    for offset, length, record in members(stream):
                        rows.append(entry_of(record, archive, offset, length))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    spark = archives.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(run, ENTRY)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in LONGS else pa.string()) for c, n in zip(columns, NAMES, strict=True)], names=NAMES)


def build_index(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(no, first, last, n, lines): index lines in order of (surt, page_id), in compressed blocks, numbered in that order. One row is one line of the directory."""
    spark = entries.sparkSession
    ship(spark)
    entries = keep(entries, "captures")  # its order is sampled before it is sorted
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def packed(rows: list[list]) -> pa.RecordBatch:
            lines = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)], pa.int64()), pa.array([lines], pa.binary())], names=["first", "last", "n", "lines"])

        for batch in batches:
            held += [list(r) for r in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True)]
            while len(held) >= block:
                yield packed(held[:block])
                held = held[block:]
        if held:
            yield packed(held)

    blocks = keep(ordered.mapInArrow(run, "first string, last string, n long, lines binary").withColumn("at", F.monotonically_increasing_id()), "blocks")
    return blocks.select(F.col("at").alias("no"), "first", "last", "n", "lines")


def captures(index: DataFrame) -> DataFrame:
    """All index lines, out of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in batch.column("lines").to_pylist():
                yield _batch([tuple(json.loads(x)) for x in zlib.decompress(lines).split(b"\n")])

    return index.select("lines").mapInArrow(run, ENTRY)


def find(index: DataFrame, keys: DataFrame, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """Index lines, each once, of the keys in `keys` (key): directory, then block, by bisection."""
    spark = index.sparkSession
    ship(spark)
    n = index.count()
    stride = max(1, -(-n // directory_rows))
    # Numbers rise with the keys, from 0 in each part of the index (see build_index). Every stride-th block of a
    # part stands for itself and those that follow it, and is sent: directory_rows and one a part at most.
    group = F.col("no") - F.pmod(F.col("no").bitwiseAND((1 << 33) - 1), F.lit(stride))
    narrow = index.select("no", "first", "last", group.alias("group"))
    sparse = narrow.where(F.col("no") == F.col("group")).orderBy("no").select("no", "first").collect()
    sent = spark.sparkContext.broadcast(([r["no"] for r in sparse], [r["first"] for r in sparse]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nos, firsts = sent.value
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist() if nos else ():
                # From the last line below the key, whose blocks may end with it, to the last one not above it.
                lo = max(0, bisect.bisect_left(firsts, key) - 1)
                rows += [(key, no) for no in nos[lo : max(lo + 1, bisect.bisect_right(firsts, key))]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["key", "group"])

    def look(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for lines in blocks["lines"]:
            found = [tuple(json.loads(x)) for x in zlib.decompress(lines).split(b"\n")]
            surts = [r[0] for r in found]
            for k in set(wanted["key"]):
                rows += found[bisect.bisect_left(surts, k) : bisect.bisect_right(surts, k)]
        return _batch(rows).to_pandas(types_mapper=lambda t: pd.Int64Dtype() if t == pa.int64() else None)

    spans = keys.select("key").distinct().mapInArrow(place, "key string, group long")
    placed = keep(spans.join(narrow, "group").where("key >= first and key <= last").select("key", "no"), "placed")
    # Each block is a group with its keys, divided where these are many.
    busy = placed.groupBy("no").agg(F.ceil(F.count(F.lit(1)) / KEYS).cast("int").alias("parts"))
    placed = placed.join(busy, "no").select("key", "no", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    blocks = index.join(busy, "no").select(F.col("no").alias("of"), "lines", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    return placed.groupBy("no", "part").cogroup(blocks.groupBy("of", "piece")).applyInPandas(look, ENTRY)


def read_ranges(hits: DataFrame, columns: str, take) -> DataFrame:
    """Rows that `take` makes of (hit as a dict, payload), from the byte ranges that `hits` (archive, offset, length, ...) names; no other byte is read."""
    ship(hits.sparkSession)
    schema = to_arrow_schema(T._parse_datatype_string(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        with contextlib.ExitStack() as held:  # one archive at a time is open
            for batch in batches:
                rows = []
                for hit in batch.to_pylist():
                    if hit["archive"] != path:
                        held.close()
                        path = hit["archive"]
                        files, at = opened(path)
                        file = held.enter_context(files.open_input_file(at))
                    file.seek(hit["offset"])
                    rows.append(take(hit, *payload_of(zlib.decompress(file.read(hit["length"]), wbits=31))))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # Neighbours in an archive are read in a row; a large archive is divided.
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = hits.repartition(parts, "archive", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(run, columns)


def lookup(index: DataFrame, urls: DataFrame, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """The captures of each url in `urls` (one column): query, the index line, and the response's payload.

    A revisit's payload is that of the response it refers to. Null urls find captures without
    one. Repeated urls are looked up once; urls without captures give no row.
    """
    queries = urls.select(F.col(urls.columns[0]).cast("string").alias("query")).distinct().withColumn("key", surt(F.col("query")))
    lines = find(index, queries.select("key"), directory_rows)
    hits = keep(queries.join(lines, queries["key"] == lines["surt"]).where(F.col("query").eqNullSafe(F.col("url"))).select("query", *NAMES), "hits")
    again = hits.where("record_type = 'revisit'").select("refers_to", "refers_to_url", "payload_digest").distinct()
    sources = find(index, again.select(surt(F.col("refers_to_url")).alias("key")), directory_rows).where("record_type = 'response'")
    own = hits.where("record_type = 'response'").select("archive", "offset", "length", F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"))
    others = sources.join(again, (sources["page_id"] == again["refers_to"]) & (sources["payload_digest"] == again["payload_digest"]), "left_semi")
    ranges = own.unionByName(others.select("archive", "offset", "length", F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"))).distinct()
    payloads = read_ranges(ranges, "id long, digest string, payload binary", lambda hit, fields, payload: {"id": hit["id"], "digest": hit["digest"], "payload": payload}).dropDuplicates(["id", "digest"])
    return hits.join(payloads, F.coalesce("refers_to", "page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest"))).select("query", *NAMES, "payload")


def verified(index: DataFrame, urls: DataFrame, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """One row for each capture of the urls in `urls` (one column), from its own record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's bytes and digest are counted from its payload, a revisit's stand in its header.
    """
    queries = urls.select(F.col(urls.columns[0]).cast("string").alias("url")).distinct()
    lines = find(index, queries.select(surt(F.col("url")).alias("key")), directory_rows)

    def take(hit: dict, f: dict[str, str], payload: bytes) -> dict:
        response = f["WARC-Type"] == "response"
        digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() if response else f["WARC-Payload-Digest"][5:]
        return {
            "page_id": _id(f.get("WARC-Record-ID")), "url": _url(f.get("WARC-Target-URI")), "payload_bytes": len(payload) if response else int(f["Payload-Length"]),
            "payload_digest": digest, "record_type": f["WARC-Type"], "refers_to": _id(f.get("WARC-Refers-To")),
        }

    # Two urls may share a key: only captures of an asked url are read.
    hits = lines.join(queries.hint("shuffle_hash"), lines["url"].eqNullSafe(queries["url"]), "left_semi").select("archive", "offset", "length")
    return read_ranges(hits, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long", take)
