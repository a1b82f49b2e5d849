"""Operator 3: legacy ARC archives converted to WARC, and both read back.

ARC files begin with a version block whose own header line names the version and whose body names the fields of every later header line:

* version 1: URL, IP address, date, content type, length;
* version 2: URL, IP address, date, content type, result code, checksum, location, offset, file name, length.

A record is its header line, then as many bytes as the line declares, then a line end. The converter reads each file's version block, parses its
header lines by that version and synthesises WARC records: identifiers are name-based UUIDs, dates become ISO 8601, `filedesc:` blocks become warcinfo,
to which the records of their file point, HTTP messages response or revisit, and block and payload digests are SHA-1 in base32. Of records with equal
payloads of at least `min_bytes` the one with the smallest number is the response; the others revisit it and carry headers only. Readers check every
digest, and resolve a revisit through the identifier in its WARC-Refers-To.

Each record is a gzip member of its own. Files are written by Spark's text writer, whose line separator is set to an empty gzip member, so what stands
between two records is valid too, and read as binary files, so any file system that Spark knows will do. A file has some FILE_BYTES; a reader holds its
compressed bytes and one record. Equal payloads are grouped by digest with the smallest number pre-aggregated, over a written table without payloads;
payloads are shuffled once at most, by record number, so that a payload which a third of all records share is no single task.

Defined results: a null payload is empty; a null URL is `about:blank`, blanks in URLs are percent-encoded; repeated numbers are not expected (the page id is the
key), and a row without one isn't archived;
empty tables give empty archives and no rows; extra columns are left alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm.common import scratch_path, written

#: The field lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NUMBER = "X-Archive-Record"
#: Bytes of records in a file, about, and most records in one.
FILE_BYTES, FILE_RECORDS = 64 << 20, 4000
#: Level of compression.
LEVEL = 2
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RECORD = "file string, number long, url string, ip string, date string, status int, head string, payload string, payload_bytes long, digest string, block_digest string, head_digest string"
WARC = "record_id string, warc_type string, target_uri string, warc_date string, number long, payload_bytes long, payload_digest string, refers_to_id string, warcinfo_id string, payload string"


def write_members(rows: DataFrame, path: str, records_per_file: int) -> None:
    """rows (value binary) as files of gzip members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                members = [gzip.compress(v.as_buffer(), LEVEL, mtime=0) for v in batch.column(0).slice(a, 100)]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])

    text = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path)


def members(data: memoryview) -> Iterator[bytes]:
    """The members of a file that hold anything, one at a time."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        parts = [d.decompress(data[at : at + (1 << 20)])]
        fed = min(len(data), at + (1 << 20))
        while not d.eof:
            if fed == len(data):
                raise ValueError("a gzip member is cut off")
            parts.append(d.decompress(data[fed : fed + (1 << 20)]))
            fed = min(len(data), fed + (1 << 20))
        at = fed - len(d.unused_data)
        whole = b"".join(parts)
        if whole:
            yield whole


def records_per_file(total_bytes: int, rows: int) -> int:
    """As many records as make FILE_BYTES on average."""
    return max(1, min(FILE_RECORDS, FILE_BYTES * rows // max(1, total_bytes)))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.when(F.trim(url) != "", url), F.lit("about:blank")), r"[\s\x00-\x20]", "%20")


def write_arc(pages: DataFrame, path: str, version: int = 1, start: int = 1_230_768_000) -> None:
    """pages (number, url, payload) as ARC files of a version, one version block at the head of each file's records.

    Archive dates are synthetic: a second per number from `start` (Unix time) on, and so are addresses. Every task's rows begin with the block; a further
    file of the same task repeats it.
    """
    size = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes")).first()
    most = records_per_file(size["bytes"] + 300 * size["n"], size["n"])
    code = "" if version == 1 else " 200 - - 0 archive"
    body = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{NUMBER}: "), F.col("number").cast("string"), F.lit("\r\n\r\n"), F.coalesce("payload", F.lit("")))
    date = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(F.col("number") % 500_000_000 + start).cast("timestamp_ntz")), "yyyyMMddHHmmss")
    ip = F.concat_ws(".", F.lit("10"), *(F.shiftright(F.col("number"), k).bitwiseAND(F.lit(255)).cast("string") for k in (16, 8, 0)))
    line = F.concat(clean_url(F.col("url")), F.lit(" "), ip, F.lit(" "), date, F.lit(f" text/html{code} "), F.octet_length("body").cast("string"))
    rows = pages.withColumn("body", body).select(F.concat(line, F.lit("\n"), F.col("body"), F.lit("\n")).cast("binary").alias("value"))
    block = f"{version} 0 archive\n{FIELDS[version]}\n"
    head = f"filedesc://archive.arc 0.0.0.0 {datetime.fromtimestamp(start, UTC):%Y%m%d%H%M%S} text/plain{code} {len(block)}\n{block}\n".encode()

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            column = batch.column(0)
            while len(column):
                if n % most == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([head], column.type)], names=["value"])
                    n += 1
                part = column.slice(0, max(1, most - n % most))
                yield pa.RecordBatch.from_arrays([part], names=["value"])
                n += len(part)
                column = column.slice(len(part))

    most = max(2, most)  # the version block and a record at least
    write_members(rows.mapInArrow(headed, "value binary"), path, most)


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_arc(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, block) of each record of a file that comes in parts of whole records; ValueError where a header line or a length doesn't fit."""
    names = None
    for data in parts:
        at = 0
        while at < len(data):
            end = data.index(b"\n", at)
            line = data[at:end].decode()
            if not line:
                at = end + 1
                continue
            values = line.split(" ")
            size = int(values[-1])
            block = data[end + 1 : end + 1 + size]
            if len(block) < size:
                raise ValueError(f"a record declares {size} bytes; {len(block)} are there")
            if line.startswith("filedesc:"):
                version = int(block.split(b" ", 1)[0])
                names = block.split(b"\n")[1].decode().split(" ")
                if version not in FIELDS or names != FIELDS[version].split(" "):
                    raise ValueError(f"unknown ARC version block {block[:80]!r}")
            if names is None:
                raise ValueError("no version block before the first record")
            if len(values) < len(names):
                raise ValueError(f"{len(values)} fields where {len(names)} are named")
            # Content types may hold blanks: the fields to their right are counted from the end.
            k, after = names.index("Content-type"), len(names) - names.index("Content-type") - 1
            fields = [*values[:k], " ".join(values[k : len(values) - after]), *values[len(values) - after :]]
            yield dict(zip(names, fields, strict=True)), block
            at = end + 1 + size + 1


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"a record declares {size} bytes; its end isn't there")
        yield fields, block
        at = end + 8 + size


def file_rows(spark: SparkSession, path: str, row, schema: str, step: int = 200) -> DataFrame:
    """row(file name, members) over each file below path, in Arrow batches of `step` rows."""

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    into = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in row(name.rsplit("/", 1)[-1], members(memoryview(content.as_buffer()))):
                    rows.append(r)
                    if len(rows) == step:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), into, strict=True)], schema=into)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), into, strict=True)], schema=into)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)


def _arc_rows(name: str, parts: Iterable[bytes]) -> Iterator[tuple]:
    """HTTP records, and the version block with a null number, its text as payload."""
    for fields, block in parse_arc(parts):
        date = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        if fields["URL"].startswith("filedesc:"):
            info = f"software: ARC converter\r\nformat: WARC File Format 1.1\r\ndescription: {' | '.join(block.decode().splitlines())}\r\n"
            yield name, None, fields["URL"], fields["IP-address"], date, None, None, info, len(info.encode()), None, base32(info.encode()), None
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield name, int(lines[NUMBER]), fields["URL"], fields["IP-address"], date, int(head.split(b" ", 2)[1]), head.decode(), payload.decode(), len(payload), base32(payload), base32(block), base32(head + b"\r\n\r\n")


def _arc_index(name: str, parts: Iterable[bytes]) -> Iterator[tuple]:
    for fields, block in parse_arc(parts):
        if not fields["URL"].startswith("filedesc:"):
            head, _, payload = block.partition(b"\r\n\r\n")
            yield int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])[NUMBER]), base32(payload), len(payload)


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """(number, digest, payload_bytes) of the HTTP records of ARC files."""
    return file_rows(spark, path, _arc_index, "number long, digest string, payload_bytes long", 4000)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files; version blocks have a null number."""
    return file_rows(spark, path, _arc_rows, RECORD)


def record_id(kind: str, name: Column) -> Column:
    h = F.sha1(F.concat(F.lit(f"archive-records/{kind}/"), name))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_warc(records: DataFrame, path: str, min_bytes: int = 0, index: DataFrame | None = None, most: int = 2_000_000) -> None:
    """Records (as of read_arc) as WARC files, with their index (as of index_arc; else it is taken from them), which is written and grouped by digest.

    Up to `most` revisits (two numbers each) are broadcast, so payloads aren't shuffled; beyond, payloads move once, by their own numbers.
    """
    slim = written(index if index is not None else records.where("number is not null").select("number", "digest", "payload_bytes"), "records")
    size = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes")).first()
    long = slim.where(F.col("payload_bytes") >= min_bytes)
    firsts = long.groupBy("digest").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    # Only what revisits is joined by digest, without payloads.
    revisits = written(long.select("number", "digest").join(firsts.where("n > 1"), "digest").where("number <> first").select("number", "first"), "revisits")
    rows = records.join(F.broadcast(revisits) if revisits.count() <= most else revisits.hint("merge"), "number", "left")
    info, again = F.col("number").isNull(), F.col("first").isNotNull()
    block = F.when(info, F.col("payload")).otherwise(F.concat(F.col("head"), F.lit("\r\n\r\n"), F.when(again, F.lit("")).otherwise(F.col("payload"))))

    def field(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))

    def when(condition: Column, *fields: Column) -> Column:
        return F.when(condition, F.concat(*fields)).otherwise(F.lit(""))

    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(info, "warcinfo").when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.when(info, record_id("info", F.col("file"))).otherwise(record_id("page", F.col("number").cast("string")))),
        field("WARC-Date", F.col("date")),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))),
        when(info, field("WARC-Filename", F.col("file")), field("Content-Type", F.lit("application/warc-fields"))),
        when(
            ~info,
            field("WARC-Target-URI", F.col("url")), field("WARC-IP-Address", F.col("ip")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            field("WARC-Warcinfo-ID", record_id("info", F.col("file"))), field("Content-Type", F.lit("application/http; msgtype=response")),
        ),
        when(again, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", record_id("page", F.col("first").cast("string")))),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )
    write_members(rows.select(text.cast("binary").alias("value")), path, records_per_file(size["bytes"] + 800 * size["n"], size["n"]))


def _warc_rows(name: str, parts: Iterable[bytes], payloads: bool = True) -> Iterator[tuple]:
    for part in parts:
        for fields, block in parse_warc(part):
            kind, ident = fields["WARC-Type"], fields["WARC-Record-ID"]
            if base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
                raise ValueError(f"block digest of {ident} doesn't fit")
            if kind == "warcinfo":
                yield ident, kind, None, fields["WARC-Date"], None, None, None, None, None, block.decode()
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            again, digest = kind == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if not again and base32(payload) != digest:
                raise ValueError(f"payload digest of {ident} doesn't fit")
            size, text = (None, None) if again else (len(payload), payload.decode() if payloads else None)
            yield ident, kind, fields["WARC-Target-URI"], fields["WARC-Date"], int(lines[NUMBER]), size, digest, fields.get("WARC-Refers-To"), fields["WARC-Warcinfo-ID"], text


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files, their blocks and payloads checked against their digests; warcinfo records have a null number, revisits a null payload, and so
    have all without payloads."""
    return file_rows(spark, path, partial(_warc_rows, payloads=payloads), WARC, 200 if payloads else 4000)


def resolved(records: DataFrame, payloads: bool = True, most: int = 2_000_000) -> DataFrame:
    """The pages' records, with refers_to, the number of the response that each revisit names, and its payload_bytes from there; without payloads the files
    are read once only, as all else is in a written index.

    Referents are made distinct before they are looked up, and broadcast where they are few, so one page that a third of all others revisit is no single task.
    """
    index = written(records.where("number is not null").drop("payload"), "index")
    pages = records.where("number is not null") if payloads else index
    asked = index.where("warc_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    found = index.where("warc_type = 'response'").select("record_id", "number", "payload_bytes", "payload_digest").join(asked, "record_id", "left_semi")
    found = written(found.toDF("refers_to_id", "refers_to", "_bytes", "_digest"), "referents")
    out = pages.join(F.broadcast(found) if found.count() <= most else found, "refers_to_id", "left")
    sound = F.col("warc_type") == "response"
    sound = sound | (F.col("_digest") == F.col("payload_digest"))
    size = F.when(F.coalesce(sound, F.lit(False)), F.coalesce("payload_bytes", "_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response fits "), F.col("record_id"))))
    return out.withColumn("payload_bytes", size.cast("long")).drop("_bytes", "_digest")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    write_warc(read_arc(spark, arc_path), warc_path, min_bytes, index_arc(spark, arc_path))


def round_trip(pages: DataFrame, number: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """pages through ARC (version 1 for even numbers, 2 for odd ones) and WARC files in the shared folder; the pages' WARC records read back and resolved."""
    spark = pages.sparkSession
    rows = pages.select(F.col(number).cast("long").alias("number"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(rows.where("number % 2 = 0"), f"{arc}/version=1", 1)
    write_arc(rows.where("number % 2 <> 0"), f"{arc}/version=2", 2)
    convert(spark, arc, warc, min_bytes)
    return resolved(read_warc(spark, warc, payloads), payloads)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
bits AS (SELECT h, string_agg(lpad(bin(CAST('0x' || substr(h, k, 1) AS INT)), 4, '0'), '' ORDER BY k) AS s FROM (SELECT DISTINCT h FROM d), range(1, 41) r(k) GROUP BY h),
b32 AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(s, 5 * k + CAST(j AS INT), 1) AS INT) * (1 << CAST(5 - j AS INT)))) AS INT), 1), '' ORDER BY k) AS digest FROM bits, range(0, 32) r(k) GROUP BY h),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN b32 USING (h) JOIN f USING (h)
"""
