"""ARC to WARC: parse legacy web archives by version and declared length, write WARC records, read them back.

``write_arc`` lands pages as ARC version 1 or 2 files (one gzip member per record), the legacy input.
``convert`` reads each file by the field names of its own version block, takes exactly the declared
number of bytes per record and writes a WARC/1.1 file next to others in the target folder, with
synthesised record ids, dates, types and digests.  Of records with equal payloads of at least
``least`` bytes, the one with the largest page id stays a response and the others become revisits
that refer to it.  ``read_warc`` reads the records back.

Spark deals files to tasks; a task streams one record at a time.  The payloads never shuffle: a first
pass over the files indexes (file, ordinal, digest, page id), the largest page id per digest is a
pre-aggregated maximum, and each file gets the list of its own revisits, bounded by ``ROLL_BYTES`` a file.
A task writes files under names of its own and returns their paths as rows; only files in
the written list of paths count, so a lost or repeated task leaves at most an unlisted file behind.

Defined cases: null html is an empty payload, a null url is ``urn:none``, white space and control characters
in urls are percent-encoded, a null page id stays null; repeated rows are records of their own (equal
page ids: the later file and ordinal count as larger); a record that ends before its declared length
is kept with ``WARC-Truncated``; header lines that do not parse are skipped and counted; an empty table gives no records;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.session import scratch_dir, ship_package, written

ROLL_BYTES = 128 << 20  # payload bytes after which a task starts another file
LEVEL = 1
#: ARC record fields by version (fixed values of the format)
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class _Writer:
    """gzip members to one file in any file system that Arrow opens."""

    def __init__(self, path: str):
        system, where = _file_system(path)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self.out, self.path, self.records, self.raw = system.open_output_stream(where, compression=None), path, 0, 0

    def add(self, record: bytes) -> None:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(c.compress(record) + c.flush())
        self.records, self.raw = self.records + 1, self.raw + len(record)

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "records": self.records, "raw": self.raw}


def _opened(path: str):
    system, where = _file_system(path)
    return gzip.GzipFile(fileobj=io.BufferedReader(system.open_input_stream(where, compression=None), 1 << 20))


def _line(stream) -> bytes:
    """The next line, or what is left of a cut file."""
    try:
        return stream.readline()
    except (EOFError, zlib.error):
        return b""


def _take(stream, n: int) -> bytes:
    parts = []
    try:
        while n > 0 and (part := stream.read(n)):
            parts.append(part)
            n -= len(part)
    except (EOFError, zlib.error):
        pass
    return b"".join(parts)


# ---- ARC ---------------------------------------------------------------------------------------

def arc_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: quote(m[0]), url) if url else "urn:none"


def arc_head(version: int, name: str, date: str = "20200101000000") -> bytes:
    block = f"{version} 0 haze\n{FIELDS[version]}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", date, "text/plain"]
    fields += ["200", "-", "-", "0", name] if version == 2 else []
    return f"{' '.join(fields)} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, name: str, offset: int, page_id, url: str | None, payload: bytes, date: str) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += f"{PAGE_HEADER}: {page_id}\r\n" if page_id is not None else ""
    body = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [arc_url(url), "192.0.2.1", date, "text/html"]
    fields += ["200", "-", "-", str(offset), name] if version == 2 else []
    return f"{' '.join(fields)} {len(body)}\n".encode() + body + b"\n"


def parse_arc(stream) -> Iterator[dict]:
    """Records of one ARC stream: url, ip, date, mime, body, truncated; ``bad`` lines skipped before each."""
    names, bad = FIELDS[1].split(), 0
    while line := _line(stream):
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        about = line.startswith(b"filedesc:")
        size = line.rstrip().rsplit(b" ", 1)[-1]
        if not size.isdigit() or (len(parts) != len(names) and not about):
            bad += 1
            continue
        body = _take(stream, int(size))
        if about:
            rows = body.decode("utf-8", "replace").split("\n")
            if len(rows) > 1 and rows[0][:1] in ("1", "2"):
                names = (rows[1].strip() or FIELDS[int(rows[0][:1])]).split()
            continue
        r = dict(zip(names, parts))
        yield {"url": r["URL"], "ip": r.get("IP-address", ""), "date": r.get("Archive-date", ""),
               "mime": r.get("Content-type", ""), "body": body, "truncated": len(body) < int(size), "bad": bad}
        bad = 0


# ---- WARC --------------------------------------------------------------------------------------

def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head (with its empty line) and payload; null if the body is no HTTP response."""
    if not body.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[:m.end()], body[m.end():]) if m else (body, b"")


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def iso_date(arc: str) -> str:
    """An ARC date of 4 to 14 digits as WARC-Date; missing parts are the first of their kind."""
    d = arc if re.fullmatch(r"\d{4}(\d\d){0,5}", arc) else "1970"
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(path: str, ordinal: int, url: str, date: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {ordinal} {url} {date}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, ident: str, date: str, headers: list[tuple[str, str]], block: bytes, mime: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *headers,
             ("WARC-Block-Digest", _sha1(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def converted(path: str, ordinal: int, r: dict, refers: dict | None) -> bytes:
    """One ARC record as a WARC record."""
    ident, date = record_id(path, ordinal, r["url"], r["date"]), iso_date(r["date"])
    http = split_http(r["body"])
    common = [("WARC-Target-URI", r["url"])]
    common += [("WARC-IP-Address", r["ip"])] if re.fullmatch(r"[0-9a-fA-F.:]+", r["ip"]) and r["ip"] != "0.0.0.0" else []
    common += [("WARC-Truncated", "unspecified")] if r["truncated"] else []
    if http is None:
        return warc_record("resource", ident, date, common, r["body"], r["mime"] or "application/octet-stream")
    common.append(("WARC-Payload-Digest", _sha1(http[1])))
    if refers is None:
        return warc_record("response", ident, date, common, r["body"], "application/http; msgtype=response")
    common += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers["id"]),
               ("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", iso_date(refers["date"]))]
    return warc_record("revisit", ident, date, common, http[0], "application/http; msgtype=response")


def parse_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, block) of every record of one WARC stream."""
    while line := _line(stream):
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := _line(stream)).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, _take(stream, int(head.get("content-length") or 0))


# ---- Spark -------------------------------------------------------------------------------------

def _dealt(files: DataFrame, n: int) -> DataFrame:
    """One file per partition; a partition count that is asked for is not coalesced at run time."""
    return files.repartitionByRange(max(1, n), "path")


def write_arc(pages: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) as ARC files under ``root``; without ``version``, tasks take 1 and 2 in turn."""
    ship_package(pages.sparkSession)

    def land(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        kind, out = version or 1 + task % 2, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html")]
            for page_id, url, html in zip(*cols):
                if out is None:
                    name = f"{task:06d}-{uuid.uuid4().hex}.arc.gz"
                    out = _Writer(f"{root}/{name}")
                    out.add(arc_head(kind, name))
                out.add(arc_record(kind, name, out.raw, page_id, url, (html or "").encode("utf-8", "replace"),
                                   f"20200101{out.records // 3600 % 24:02d}{out.records // 60 % 60:02d}{out.records % 60:02d}"))
                if out.raw >= ROLL_BYTES:
                    yield pa.RecordBatch.from_pylist([out.close()])
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_pylist([out.close()])

    return written(pages.select("page_id", "url", "html").mapInArrow(land, "path string, records long, raw long"), "arc-files")


def index_arc(files: DataFrame, n: int) -> DataFrame:
    """path, ordinal, page_id, url, date, id, sha1 (hex) and bytes of the payload of every record."""
    def scan(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _opened(path) as stream:
                    for k, r in enumerate(parse_arc(stream)):
                        http = split_http(r["body"])
                        page = header(http[0], PAGE_HEADER) if http else None
                        rows.append({"path": path, "ordinal": k, "page_id": int(page) if page else None, "url": r["url"],
                                     "date": r["date"], "id": record_id(path, k, r["url"], r["date"]),
                                     "sha1": hashlib.sha1(http[1]).hexdigest() if http else None,
                                     "bytes": len(http[1]) if http else 0})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        ("path", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("date", pa.string()), ("id", pa.string()), ("sha1", pa.string()), ("bytes", pa.int64())]))

    return _dealt(files.select("path"), n).mapInArrow(
        scan, "path string, ordinal long, page_id long, url string, date string, id string, sha1 string, bytes long")


def convert(files: DataFrame, root: str, least: int = 1000) -> DataFrame:
    """The ARC ``files`` (path) as WARC files under ``root``: path, records, raw."""
    ship_package(files.sparkSession)
    n = files.count()
    index = written(index_arc(files, n), "arc-index")
    large = index.where((F.col("bytes") >= least) & F.col("sha1").isNotNull())
    first = large.groupBy("sha1").agg(
        F.max(F.struct("page_id", "path", "ordinal", "id", "url", "date")).alias("keep"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("sha1", "keep")
    again = large.select("sha1", "path", "ordinal").join(first, "sha1").where(
        (F.col("path") != F.col("keep.path")) | (F.col("ordinal") != F.col("keep.ordinal")))
    plans = again.groupBy("path").agg(F.collect_list(F.struct("ordinal", "keep.id", "keep.url", "keep.date")).alias("again"))

    def rewrite(batches):
        for batch in batches:
            for path, listed in zip(batch.column("path").to_pylist(), batch.column("again").to_pylist()):
                refers = {r["ordinal"]: r for r in listed or ()}
                out = _Writer(f"{root}/{path.rsplit('/', 1)[-1].removesuffix('.arc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz")
                info = f"software: haze\r\nformat: WARC file version 1.1\r\nconverted-from: {path.rsplit('/', 1)[-1]}\r\n"
                out.add(warc_record("warcinfo", record_id(path, -1, "", ""), iso_date("2020"), [], info.encode(),
                                    "application/warc-fields"))
                with _opened(path) as stream:
                    for k, r in enumerate(parse_arc(stream)):
                        out.add(converted(path, k, r, refers.get(k)))
                yield pa.RecordBatch.from_pylist([out.close()])

    todo = files.select("path").join(plans, "path", "left")
    return written(_dealt(todo, n).mapInArrow(rewrite, "path string, records long, raw long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """type, id, refers, page_id, url, payload_bytes and payload_digest (hex) of every response, revisit and resource."""
    ship_package(files.sparkSession)

    def scan(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _opened(path) as stream:
                    for head, block in parse_warc(stream):
                        if head.get("warc-type") not in ("response", "revisit", "resource"):
                            continue
                        top, payload = split_http(block) or (b"", block)
                        page, revisit = header(top, PAGE_HEADER), head["warc-type"] == "revisit"
                        named = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append({
                            "type": head["warc-type"], "id": head.get("warc-record-id"), "refers": head.get("warc-refers-to"),
                            "page_id": int(page) if page else None, "url": head.get("warc-target-uri"),
                            "payload_bytes": int(header(top, "Content-Length") or 0) if revisit else len(payload),
                            "payload_digest": base64.b32decode(named).hex() if revisit else hashlib.sha1(payload).hexdigest()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        ("type", pa.string()), ("id", pa.string()), ("refers", pa.string()), ("page_id", pa.int64()),
                        ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

    return _dealt(files.select("path"), files.count()).mapInArrow(
        scan, "type string, id string, refers string, page_id long, url string, payload_bytes long, payload_digest string")


def pages_through_archives(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Land ``pages`` as ARC, convert to WARC, read back; revisits carry the page id of their response."""
    root = scratch_dir(spark, "archives")
    warc = convert(write_arc(pages, f"{root}/arc"), f"{root}/warc", least)
    records = written(read_warc(warc), "warc-records")
    used = records.where(F.col("type") == "revisit").select(F.col("refers").alias("id")).distinct()
    target = records.where(F.col("type") == "response").join(used, "id", "left_semi").select(
        F.col("id").alias("target"), F.col("page_id").alias("refers_to"))
    return records.join(target, F.col("refers") == F.col("target"), "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
