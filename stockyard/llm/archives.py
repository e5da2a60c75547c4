"""Legacy ARC archives to WARC: parse version-specific header lines and declared lengths, synthesise what WARC asks for, read back.

ARC version 1 record:  URL IP-address Archive-date Content-type Archive-length
ARC version 2 record:  URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length
A file starts with a filedesc:// record whose body names the version and these fields. After each record's declared length comes \\n.

Archives are written and read by Spark (text writer with the records as raw bytes, binaryFile reader), so any file system will do. An
archive file is one unit of parsing: `archive_bytes` bounds its size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import common as C

#: Payloads from this size on are revisits of an equal one.
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
_FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URL namespace
_SPACES = re.compile(rb"[ \t\r\n]+")


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC


def _arc_header(version: int, name: str, date: str) -> bytes:
    body = b"%d 0 Stockyard\n%s\n" % (version, _FIELDS[version])
    url = b"filedesc://" + name.encode()
    if version == 1:
        return b"%s 0.0.0.0 %s text/plain %d\n%s" % (url, date.encode(), len(body), body)
    return b"%s 0.0.0.0 %s text/plain 200 - - 0 %s %d\n%s" % (url, date.encode(), name.encode(), len(body), body)


def arc_record(version: int, url: str | None, content: bytes, date: str, name: str = "-", offset: int = 0, mime: str = "text/html") -> bytes:
    """A record without the \\n that follows it. White space in the url is percent-encoded, a null url becomes -."""
    at = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._").encode() if url else b"-"
    if version == 1:
        return b"%s 0.0.0.0 %s %s %d\n%s" % (at, date.encode(), mime.encode(), len(content), content)
    check = b"%08X" % zlib.crc32(content)
    return b"%s 0.0.0.0 %s %s 200 %s - %d %s %d\n%s" % (at, date.encode(), mime.encode(), check, offset, name.encode(), len(content), content)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one archive in order, the filedesc:// record first with its version; ValueError where lengths or fields are wrong."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at {at}")
        fields = data[at:end].split(b" ")
        if version is None and not data[at:end].startswith(b"filedesc://"):
            raise ValueError("no filedesc record")
        n = int(fields[-1])
        body = data[end + 1 : end + 1 + n]
        if len(body) != n:
            raise ValueError(f"the record at {at} declares {n} bytes, {len(body)} are left")
        first = version is None
        if first:
            version = int(body.split(b" ", 1)[0])
        if version not in _FIELDS or len(fields) != len(_FIELDS[version].split(b" ")):
            raise ValueError(f"version {version} and {len(fields)} fields at {at}")
        got = {"version": version, "kind": "filedesc" if first else "record", "offset": at, "url": fields[0], "ip": fields[1].decode(), "date": fields[2].decode(), "mime": fields[3].decode("latin-1"), "content": body}
        if version == 2:
            got |= {"status": fields[4].decode(), "checksum": fields[5].decode(), "location": fields[6].decode("latin-1"), "filename": fields[8].decode()}
            if fields[5] not in (b"-", b"%08X" % zlib.crc32(body)):
                raise ValueError(f"wrong checksum at {at}")
        yield got
        at = end + 1 + n
        if data[at : at + 1] == b"\n":
            at += 1


# HTTP inside records


def http_message(payload: bytes, page_id: int | None) -> bytes:
    more = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n%s" % (len(payload), more, payload)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The head with its blank line, and the payload; a content that is no HTTP response is all payload."""
    if content.startswith(b"HTTP/") and (end := content.find(b"\r\n\r\n")) >= 0:
        return content[: end + 4], content[end + 4 :]
    return b"", content


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip()
    return None


# WARC


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter date filled up, as WARC's timestamp."""
    d = (arc_date + "00010101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int, digest: str) -> str:
    """The same id for the same record in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}#{offset}#{digest}')}>"


def warc_record(kind: str, rid: str, date: str, block: bytes, content_type: str, **more: str | None) -> bytes:
    """One WARC/1.1 record without the two line ends that close it."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v), f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of every record, by declared lengths; ValueError where they are wrong."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) != n or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the block that ends at {at} isn't as long as declared")
        at += 4
        yield fields, block


# The job


def _one(archive: bytes) -> pa.RecordBatch:
    """A row that the text writer makes one file."""
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["value"])


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), date: str = "20080430204825", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages (page_id, url, html) as ARC archives of archive_bytes, or one record if that is larger: one record a row in UTF-8, null html empty.

    A task deals its rows to one open archive of each version in turn.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, turn = "stockyard.arc", {v: [] for v in versions}, dict.fromkeys(versions, 0), 0
        for b in batches:
            for pid, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = versions[turn % len(versions)]
                turn += 1
                if not out[v]:
                    out[v].append(_arc_header(v, name, date))
                    size[v] = len(out[v][0]) + 1
                out[v].append(arc_record(v, url, http_message(html.as_buffer().to_pybytes() if html.is_valid else b"", pid), date, name, size[v]))
                size[v] += len(out[v][-1]) + 1
                if size[v] >= archive_bytes:
                    yield _one(b"\n".join(out[v]))
                    out[v] = []
        for rest in out.values():
            if rest:
                yield _one(b"\n".join(rest))

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    lines = rows.mapInArrow(archives, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter(F.col("length") > 0).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _inflated(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, digest, payload_bytes) of the records of ARC archives; digest: raw SHA-1 of the payload."""

    def index(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for r in parse_arc(_inflated(content.as_buffer())):
                    if r["kind"] == "record":
                        head, payload = split_http(r["content"])
                        pid = http_field(head, b"X-Page-Id")
                        rows.append((file, r["offset"], None if pid is None else int(pid), hashlib.sha1(payload).digest(), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["file", "offset", "page_id", "digest", "payload_bytes"])

    return _files(spark, path).mapInArrow(index, "file string, offset bigint, page_id bigint, digest binary, payload_bytes bigint")


#: Records of one payload that a task takes, and over how many tasks at most the rest is dealt.
DEALT, SALT = 1000, 1000


def revisits(index: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(file, offset, to_page, to_file, to_offset) of the records that repeat a payload; the largest page_id, then place, is the one they repeat."""
    rows = index.filter(F.col("payload_bytes") >= least)
    # Summed before the shuffle; a payload of many records is dealt to several tasks.
    best = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "file", "offset")).alias("best")).filter("n > 1")
    best = best.select("digest", "best", F.explode(F.sequence(F.lit(0), (F.least("n", F.lit(SALT * DEALT)) / DEALT).cast("int"))).alias("_salt"), (F.least("n", F.lit(SALT * DEALT)) / DEALT).cast("int").alias("_last"))
    many, _ = C.written(best, "arc-repeated")
    heavy = C.small_or_not(many.filter("_last > 0 AND _salt = 0").select("digest", "_last"))
    rows = rows.join(heavy, "digest", "left").withColumn("_salt", F.pmod(F.xxhash64("file", "offset"), F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")
    got = rows.join(many.drop("_last"), ["digest", "_salt"]).filter((F.col("file") != F.col("best.file")) | (F.col("offset") != F.col("best.offset")))
    return got.select("file", "offset", F.col("best.page_id").alias("to_page"), F.col("best.file").alias("to_file"), F.col("best.offset").alias("to_offset"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT) -> None:
    """ARC archives at arc_path as WARC archives at warc_path, one for one.

    Each file's list of revisits (a few numbers a record, so bounded by the file) is joined by file name to the file. The payloads go
    through memory a file at a time and are shuffled never.
    """
    index, index_path = C.written(arc_index(spark, arc_path), "arc-index")
    again = revisits(index, least).groupBy("file").agg(F.collect_list(F.struct("offset", "to_page", "to_file", "to_offset")).alias("again"))
    again, again_path = C.written(again, "arc-revisits")

    def records(batches):
        for b in batches:
            for file, content, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                to = {x["offset"]: x for x in again or []}
                out, info = [], None
                for r in parse_arc(_inflated(content.as_buffer())):
                    date = warc_date(r["date"])
                    if r["kind"] == "filedesc":
                        info = record_id(file, r["offset"], "")
                        body = f"software: stockyard\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{r['version']}\r\n".encode()
                        out.append(warc_record("warcinfo", info, date, body, "application/warc-fields", WARC_Filename=file))
                        continue
                    head, payload = split_http(r["content"])
                    digest = sha1_32(payload)
                    uri = r["url"].decode("latin-1")
                    more = {"WARC_Target_URI": None if uri == "-" else uri, "WARC_IP_Address": r["ip"], "WARC_Warcinfo_ID": info, "WARC_Payload_Digest": digest}
                    rid = record_id(file, r["offset"], digest)
                    if x := to.get(r["offset"]):
                        more |= {"WARC_Refers_To": record_id(x["to_file"], x["to_offset"], digest), "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X_Refers_To_Page": None if x["to_page"] is None else str(x["to_page"])}
                        out.append(warc_record("revisit", rid, date, head, "application/http;msgtype=response", **more))
                    elif head:
                        out.append(warc_record("response", rid, date, r["content"], "application/http;msgtype=response", WARC_Block_Digest=sha1_32(r["content"]), **more))
                    else:
                        out.append(warc_record("resource", rid, date, payload, r["mime"], WARC_Block_Digest=digest, **more))
                if out:  # the writer leaves an empty file where there is no row
                    yield _one(b"\r\n\r\n".join(out))

    joined = _files(spark, arc_path).join(F.broadcast(again) if again.count() <= 1000 else again, "file", "left").select("file", "content", "again")
    lines = joined.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(warc_path)
    for p in (index_path, again_path):
        C.drop_path(spark, p)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, record_id, url, date, payload_digest, payload_bytes, refers_to) of response, resource and revisit records.

    Digests of what is there are computed again and must equal the declared ones; a revisit's are the declared ones, of the full payload.
    """

    def rows_of(batches):
        names = ["page_id", "record_type", "record_id", "url", "date", "payload_digest", "payload_bytes", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for content in b.column(1):
                rows = []
                for f, block in parse_warc(_inflated(content.as_buffer())):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block) if "application/http" in f["content-type"] else (b"", block)
                    pid = http_field(head, b"X-Page-Id")
                    size = len(payload)
                    if f["warc-type"] == "revisit":
                        size = int(http_field(head, b"Content-Length") or 0)
                    elif sha1_32(payload) != f["warc-payload-digest"]:
                        raise ValueError(f"{f['warc-record-id']} has another payload digest")
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    uri = f.get("warc-target-uri")
                    rows.append((None if pid is None else int(pid), f["warc-type"], f["warc-record-id"], uri and unquote_to_bytes(uri).decode("utf-8", "replace"), f["warc-date"], digest, size, int(x) if (x := f.get("x-refers-to-page")) else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return _files(spark, path).mapInArrow(rows_of, "page_id bigint, record_type string, record_id string, url string, date string, payload_digest string, payload_bytes bigint, refers_to bigint")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = C.new_path(spark, "arc"), C.new_path(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, warc)
    C.drop_path(spark, arc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_arc_to_warc": op3_arc_to_warc}
ORACLE_SQL = {
    "op3_arc_to_warc": f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> best THEN best END AS refers_to
FROM m
""",
}
