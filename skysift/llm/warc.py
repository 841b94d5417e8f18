"""Legacy web archives (ARC) to WARC, and writing, reading and deduplicating WARC files.

ARC files begin with a version block that names the fields of every later header line; version 1 has five fields,
version 2 ten. A record's extent is its declared length. Conversion synthesises what ARC lacks: record identifiers
(name-based UUIDs), ISO timestamps, record types and payload digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._common import Scratch, prepare

FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Bytes of payload in one archive file before the next begins, and of the table of repeated payloads that is broadcast.
FILE_BYTES, BROADCAST_BYTES, SALTS = 32 << 20, 32 << 20, 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


class BadArchive(ValueError):
    """The bytes are no archive of the kind that was asked for."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)
    version: int = 1


@dataclass
class WarcRecord:
    headers: dict[str, str]
    body: bytes

    def text(self) -> str:
        """The record without its closing blank lines, as text (its bytes must be UTF-8)."""
        return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers.items()) + "\r\n" + self.body.decode()

    def encode(self) -> bytes:
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers.items()) + "\r\n").encode() + self.body + END.encode()


def _plain(value: str) -> str:
    """A header field's value: ARC fields are split by spaces, so these and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


def write_arc(records: Iterable[ArcRecord], name: str, version: int = 1, date: str = "20000101000000") -> bytes:
    """An ARC file of the given version: the version block, then the records."""
    about = f"{version} 0 skysift\n{' '.join(FIELDS[version])}\n\n".encode()
    head = [f"filedesc://{_plain(name)}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", _plain(name)] if version == 2 else [])
    out = [f"{' '.join(head)} {len(about)}\n".encode(), about, b"\n"]
    for r in records:
        line = [_plain(r.url), _plain(r.ip), r.date, _plain(r.mime)]
        if version == 2:
            line += [_plain(r.extra.get(k, "-")) for k in FIELDS[2][4:9]]
        out += [f"{' '.join(line)} {len(r.body)}\n".encode(), r.body, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file (plain, or gzip members), the version block first as text/plain.

    The number of fields follows the version block; a URL may itself hold spaces, so fields are counted from the right.
    A record cut short, or a header line that isn't one, raises BadArchive after the records before it.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, names = 0, FIELDS[1]
    if data and not data.startswith(b"filedesc://"):
        raise BadArchive("no version block")
    first = True
    version = 1
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise BadArchive(f"header line cut short at byte {at}")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        if first:
            version = 2 if len(line.split(" ")) >= len(FIELDS[2]) else 1
            names = FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise BadArchive(f"no header line at byte {at}")
        size = int(parts[-1])
        body = data[stop + 1 : stop + 1 + size]
        if len(body) < size:
            raise BadArchive(f"record cut short at byte {at}")
        if first:
            declared = body.split(b" ", 1)[0]
            if declared not in (b"1", b"2"):
                raise BadArchive("unknown version")
            if int(declared) != version:
                raise BadArchive("header line and version disagree")
        by = dict(zip(names, parts, strict=True))
        yield ArcRecord(by["URL"], by["IP-address"], by["Archive-date"], by["Content-type"], body, {k: by[k] for k in names[4:-1]}, version)
        first = False
        at = stop + 1 + size


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """Header block (with its blank line) and payload of an HTTP response; None if it is none."""
    if not re.match(rb"HTTP/\d", body):
        return None
    found = re.search(rb"\r?\n\r?\n", body)
    return (body, b"") if found is None else (body[: found.end()], body[found.end() :])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: str) -> str:
    """ARC's 14 digits (or fewer, or with a fraction) as ISO 8601 in UTC; what is no date is the epoch."""
    digits = re.match(r"\d*", date)[0][:14]
    if len(digits) < 4:
        return "1970-01-01T00:00:00Z"
    full = digits + "00000101000000"[len(digits) :]
    y, mo, d, h, mi, s = full[:4], *(full[i : i + 2] for i in range(4, 14, 2))
    ok = 1 <= int(mo) <= 12 and 1 <= int(d) <= 31 and int(h) < 24 and int(mi) < 60 and int(s) < 61
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z" if ok else "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    """A name-based identifier: the same parts give the same one on any machine and after any retry."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def convert(record: ArcRecord, identity: str, original: str | None = None) -> WarcRecord:
    """The WARC equivalent of an ARC record.

    identity names the record; original, if given, names the record whose payload this one repeats, which makes it a
    revisit: HTTP headers and digests stay, the payload goes.
    """
    http = split_http(record.body)
    payload = http[1] if http else record.body
    kind = "warcinfo" if record.url.startswith("filedesc://") else "response" if http else "resource"
    mime = {"warcinfo": "application/warc-fields", "response": "application/http;msgtype=response"}.get(kind, record.mime)
    body = record.body
    if kind == "warcinfo":
        body = f"software: skysift\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {record.version}\r\n".encode()
    headers = {"WARC-Type": kind, "WARC-Record-ID": identity, "WARC-Date": iso_date(record.date)}
    if kind == "warcinfo":
        headers["WARC-Filename"] = record.url.removeprefix("filedesc://")
    else:
        headers["WARC-Target-URI"] = record.url
        if record.ip not in ("-", "0.0.0.0"):
            headers["WARC-IP-Address"] = record.ip
        headers["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    if original is not None and http:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": original, "X-Payload-Length": str(len(payload))}
        body = http[0]
    headers["WARC-Block-Digest"] = f"sha1:{digest(body)}"
    headers |= {"Content-Type": mime, "Content-Length": str(len(body))}
    return WarcRecord(headers, body)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file (plain, or gzip members), by their declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise BadArchive(f"no record at byte {at}")
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise BadArchive(f"header cut short at byte {at}")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["Content-Length"])
        body = data[stop + 4 : stop + 4 + size]
        if len(body) < size:
            raise BadArchive(f"record cut short at byte {at}")
        yield WarcRecord(headers, body)
        at = stop + 4 + size


def _page_record(page: int | None, url: str | None, html: str | None) -> ArcRecord:
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
    return ArcRecord(url or "-", "0.0.0.0", "20000101000000", "text/html", head + payload, {"Result-code": "200"})


def page_identity(page: int | None, url: str | None, payload_digest: str) -> str:
    return record_id("page", "" if page is None else page, url or "-", payload_digest)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as WARC files (gzip) under folder, one subfolder a file.

    Each batch is first laid out as a legacy ARC archive, of either version in turn, and converted record by record.
    Of pages with equal payloads the one with the largest key is stored whole, the others revisit it; a null key is
    stored whole only if no other page has that payload. Repeated rows with that largest key are all stored whole.
    Records are named by key, URL and payload, so repeated and null keys have names of their own; wholly equal rows
    have equal records. A file ends with the record that brings its payloads to FILE_BYTES.

    Payloads aren't moved to find equal ones: digests are grouped, and the groups of two or more are broadcast if small,
    else joined with the pages of each dealt over SALTS parts, so that a payload of a third of all pages is no one's task.
    """
    prepare(spark)
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    hashed = lambda df: df.withColumn("h", F.sha1("html")).withColumn("z", F.octet_length("html"))
    narrow = hashed(rows).select("page", "url", "h", "z")
    again = narrow.groupBy(F.col("h").alias("gh"), F.col("z").alias("gz")).agg(F.max(F.struct("page", "url")).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = Scratch(spark, "warc-again").write(again, "groups")
    same = (F.col("h") == F.col("gh")) & (F.col("z") == F.col("gz"))
    size = again.agg(F.sum(F.octet_length("original.url") + 80)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = hashed(rows).join(F.broadcast(again), same, "left")
    else:
        spread = again.withColumn("gs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hashed(rows).withColumn("s", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int")).join(spread, same & (F.col("s") == F.col("gs")), "left")
    joined = joined.select("page", "url", "html", F.col("gh").isNotNull().alias("many"), F.col("original.page").alias("to_page"), F.col("original.url").alias("to_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, size = TaskContext.get().partitionId(), 0, 0
        for n, b in enumerate(batches):
            page, links, texts, many, to_page, to_url = (c.to_pylist() for c in b.columns)
            version = 1 + n % 2
            name = f"part-{part}-batch-{n}.arc"
            arc = write_arc(map(_page_record, page, links, texts), name, version)
            out, files = [], []
            for k, r in enumerate(read_arc(arc)):
                if k == 0:
                    record = convert(r, record_id("archive", name))
                else:
                    p, found = page[k - 1], digest(texts[k - 1].encode())
                    revisit = many[k - 1] and p != to_page[k - 1]
                    record = convert(r, page_identity(p, links[k - 1], found), page_identity(to_page[k - 1], to_url[k - 1], found) if revisit else None)
                    if revisit:
                        record.headers["X-Refers-To-Page-Id"] = str(to_page[k - 1])
                out.append(record.text())
                files.append(part * 1_000_000 + file)
                size += len(record.body)
                if size >= FILE_BYTES:
                    file, size = file + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(files, pa.int64())], names=["value", "file"])

    joined.mapInArrow(run, "value string, file long").write.mode("overwrite").partitionBy("file").option("lineSep", END).option("compression", "gzip").text(folder)


def convert_archives(spark: SparkSession, source: str, target: str, pattern: str = "*.arc*") -> DataFrame:
    """Convert a folder of ARC files (plain or gzip, either version) to WARC files of the same names in target.

    Rows (source, target, records, problem), one for each file. Each record becomes a gzip member. A damaged file gives
    the records before the damage and says what was wrong; one that is no archive gives no file. Bytes are copied as
    they are, whatever their encoding. An ARC file is read whole, so it may not exceed 2 GB. Files are written by their
    task under a name of its own and then moved, so a task that runs twice does no harm. target must be a path or URI
    that all executors can write to.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
        system.create_dir(root, recursive=True)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = re.sub(r"\.arc(\.gz)?$", "", path.rsplit("/", 1)[-1]) + ".warc.gz"
                mine, n, problem = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}", 0, None
                with system.open_output_stream(mine, compression=None) as out:
                    try:
                        for r in read_arc(content.as_buffer().to_pybytes()):
                            out.write(gzip.compress(convert(r, record_id(name, n)).encode(), 6, mtime=0))
                            n += 1
                    except (BadArchive, OSError, EOFError) as e:
                        problem = str(e)
                if n:
                    system.move(mine, f"{root}/{name}")
                else:
                    system.delete_file(mine)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{target}/{name}" if n else None], pa.string()), pa.array([n], pa.int64()), pa.array([problem], pa.string())], names=["source", "target", "records", "problem"])

    # written before it is returned: reading the rows twice converts nothing twice
    return Scratch(spark, "arc").write(files.mapInArrow(run, "source string, target string, records long, problem string"), "report")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (record_id, record_type, url, date, page_id, payload_bytes, payload_digest, refers_to_id, refers_to_page) of the WARC files in a folder.

    Digests and lengths of whole records are computed from what was read; those of revisits are the declared ones.
    A whole record whose declared digest differs from its payload's raises.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").option("recursiveFileLookup", True).load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in read_warc(content.as_py()):
                    h = r.headers
                    if h["WARC-Type"] not in ("response", "resource", "revisit"):
                        continue
                    http = split_http(r.body)
                    head, payload = http if http else (b"", r.body)
                    declared = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size, found = int(h.get("X-Payload-Length", len(payload))), declared
                    if h["WARC-Type"] != "revisit":
                        found = digest(payload)
                        if found != declared:
                            raise BadArchive(f"{h['WARC-Record-ID']}: payload digest {found}, declared {declared}")
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    rows.append((h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Date"], int(page[1]) if page else None, size, found, h.get("WARC-Refers-To"), None if (to := h.get("X-Refers-To-Page-Id")) is None else int(to)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["record_id", "record_type", "url", "date", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "refers_to_page"])

    return files.mapInArrow(run, "record_id string, record_type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_page long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder, read them back: rows (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    scratch = Scratch(spark, "warc")
    archive_pages(spark, pages, f"{scratch.root}/pages")
    scratch.names.append("pages")
    found = read_archives(spark, f"{scratch.root}/pages")
    return scratch.keep(found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to")))
