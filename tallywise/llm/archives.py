"""Legacy web archives (ARC, versions 1 and 2) converted to WARC 1.0.

An ARC file opens with a version block (``filedesc://``): its second line gives the
version, its third names the fields of a record line, of which version 1 has five and
version 2 ten.  Each record is such a line, whose last field declares how many bytes
follow.  ``read_arc`` parses lines by the version of their file and takes blocks by the
declared length; ``convert`` synthesises what WARC asks for and ARC lacks:

* **identifiers**: name-based UUIDs of archive, offset and URL, the same at each attempt;
* **timestamps**: the 14-digit date as ISO 8601; shorter ones are filled up, and one
  that is no date is replaced by that of the version block;
* **types**: the version block becomes ``warcinfo``, HTTP answers ``response``, names
  resolved ``response`` of ``text/dns``, anything else ``resource``;
* **digests**: SHA-1 of block and payload (the block behind its HTTP headers).

Of HTTP answers with equal payloads of at least ``least`` bytes, one stays a response
and the others become ``revisit`` records that refer to it.

Scale.  An archive is a file of about ``ARCHIVE_BYTES``, written and read by Spark
itself, so any store will do.  Only digests are compared across archives: they are
grouped by digest and salt first, so a payload in a third of all records meets no single
task.  Each archive then meets the list of its own revisits and is rewritten whole; no
payload is shuffled but in its compressed archive.  All names are derived from content
and place, so a lost executor's work is repeated with the same result.

Defined cases.  A URL without a scheme, or null, is written as ``urn:unknown``; blanks, controls and other than
ASCII characters in URLs are percent-encoded.  A null payload is empty.  A record line
that cannot be parsed is skipped up to the next line that can, and a block that ends
early is taken as far as it goes: both yield a row with ``problem``, and no record is
lost behind them.  Rows that repeat are records of their own; of equal ranks the one
last in archive and offset stays the response.  A payload above 2 GiB is more than one
cell holds.  Of the given table only the named columns are read, so others cannot clash.
No rows yield no archives, and no archives yield no rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import look_up, materialise

ARCHIVE_BYTES = 16 << 20
LEAST_REVISIT = 1000
SALTS = 64

# Fixed values of the ARC format: the fields of a record line by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"],
}
# Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URL_SAFE = "!#$%&'()*+,-./:;=?@[]_~"
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")

ARC_ROW = ("archive string, at long, version int, url string, ip string, date string, mime string, status string, "
           "type string, record_id string, head string, payload_bytes long, payload_sha1 string, problem string")
WARC_ROW = ("archive string, at long, type string, record_id string, uri string, date string, headers map<string,string>, "
            "head string, payload_bytes long, payload_sha1 string, problem string")


def _plain(content: bytes) -> bytes:
    """A file as it was before compression; files of several members and plain files too."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(rest) + member.flush())
        rest = member.unused_data
    return b"".join(parts)


def _body_at(block: bytes) -> int:
    """Where the payload of an HTTP answer begins; 0 for other blocks."""
    if not block.startswith(b"HTTP/"):
        return 0
    crlf, lf = block.find(b"\r\n\r\n"), block.find(b"\n\n")
    if crlf >= 0 and (lf < 0 or crlf < lf):
        return crlf + 4
    return lf + 2 if lf >= 0 else len(block)


def iso_date(digits: str, otherwise: str | None = None) -> str | None:
    """``YYYYMMDDhhmmss``, or its first 4 to 12 digits, as ISO 8601."""
    for text in (digits, otherwise or ""):
        if re.fullmatch(r"\d{4}(\d\d){0,5}", text):
            full = text + "00000101000000"[len(text):]
            try:
                return dt.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
            except ValueError:
                continue
    return None


def _record_id(archive: str, at: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {at} {url}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------- ARC

def _filedesc(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 tallywise\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
              "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def _target(url: str | None) -> str:
    """A URL as a record line can hold it; what has no scheme gets one."""
    text = quote(url or "", safe=URL_SAFE)
    return text if SCHEME.match(text) else f"urn:unknown:{text}".rstrip(":")


def _arc_files(batches: Iterator[pa.RecordBatch], versions: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def file() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array([b"".join(held)], pa.binary())})

    for batch in batches:
        for r in batch.to_pylist():
            if not held:
                version, name = versions[number % len(versions)], f"part-{part:05d}-{number:05d}.arc"
                held, size = [_filedesc(name, version, r["date"] or "19960101000000")], 0
            block = r["block"] or b""
            values = {"URL": _target(r["url"]), "IP-address": r["ip"] or "0.0.0.0",
                      "Archive-date": r["date"] or "-", "Content-type": r["mime"] or "no-type", "Result-code": "200",
                      "Checksum": hashlib.md5(block).hexdigest() if version == 2 else "-", "Location": "-",
                      "Offset": str(size), "Filename": name, "Archive-length": str(len(block))}
            line = " ".join(values[f].replace(" ", "") for f in ARC_FIELDS[version]).encode()
            held += [line, b"\n", block, b"\n"]
            size += len(line) + len(block) + 2
            if size >= ARCHIVE_BYTES:
                yield file()
                held, number = [], number + 1
    if held:
        yield file()


def write_arc(records: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Write ``url, ip, date, mime, block`` as ARC files, the versions in turn."""
    files = records.select("url", "ip", "date", "mime", "block").mapInArrow(lambda b: _arc_files(b, versions), "file binary")
    # These files are read once or twice and go; the WARC files stay.
    _write_files(files, path, "\n", "BEST_SPEED")


def _write_files(files: DataFrame, path: str, end: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """One compressed file a row; ``end`` is what the format puts behind a file's last record."""
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1) \
        .option("compression", "gzip").option("zlib.compress.level", level).option("lineSep", end).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path) \
        .select(F.regexp_extract("path", r"([^/]*)$", 1).alias("archive"), "content")


def _line(text: str, fields: list[str]) -> dict[str, str] | None:
    """A record line by the fields of its version; a URL may hold blanks, since the others cannot."""
    parts = text.rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[-1].isdecimal() or not SCHEME.match(parts[0]):
        return None
    return dict(zip(fields, parts))


def arc_records(archive: str, data: bytes) -> Iterator[dict]:
    """The records of one ARC file, each with the bytes of its block."""
    at, version, fields, opened, lost = 0, 1, ARC_FIELDS[1], "", None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        text = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not text.strip():
            at = end + 1
            continue
        line = _line(text, fields)
        if text.startswith("filedesc://"):
            # The version decides how all lines behind it are read, and may differ from the fields of this one.
            head = data[end + 1:end + 400].split(b"\n", 2)
            version = 2 if head[0].startswith(b"2") else 1
            named = head[1].decode("ascii", "replace").split() if len(head) > 1 else []
            fields = named if named and named[0] == "URL" and named[-1] == "Archive-length" else ARC_FIELDS[version]
            line = _line(text, fields) or _line(text, ARC_FIELDS[1])
            opened = line["Archive-date"] if line else ""
        if line is None:
            lost = at if lost is None else lost
            at = end + 1
            continue
        if lost is not None:
            yield _bad(archive, lost, version, "no record line")
            lost = None
        size = int(line["Archive-length"])
        block = data[end + 1:end + 1 + size]
        yield {"archive": archive, "at": at, "version": version, "url": line["URL"], "ip": line["IP-address"],
               "date": iso_date(line["Archive-date"], opened), "mime": line["Content-type"],
               "status": line.get("Result-code"), "record_id": _record_id(archive, at, line["URL"]), "block": block,
               "body_at": _body_at(block), "type": _type(line["URL"], block),
               "problem": None if len(block) == size else "block ends early"}
        at = end + 1 + size
    if lost is not None:
        yield _bad(archive, lost, version, "no record line")


def _bad(archive: str, at: int, version: int, problem: str) -> dict:
    return {"archive": archive, "at": at, "version": version, "url": None, "ip": None, "date": None, "mime": None, "status": None,
            "record_id": None, "block": b"", "body_at": 0, "type": None, "problem": problem}


def _type(url: str, block: bytes) -> str:
    if url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if block.startswith(b"HTTP/") or url.startswith("dns:") else "resource"


def _indexed(records: Iterator[dict], row: str) -> pa.RecordBatch:
    """What is compared and reported of records: all but the bytes."""
    rows = []
    for r in records:
        block = r["block"]
        payload = block[r["body_at"]:]
        rows.append(r | {"head": block[:r["body_at"]].decode("utf-8", "replace") if r["body_at"] else None,
                         "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()})
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [f.split(" ") for f in row.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), _plain(batch.column(1)[i].as_py())


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ARC files in a folder, without their bytes."""
    return _files(spark, path).mapInArrow(
        lambda batches: (_indexed(arc_records(name, data), ARC_ROW) for name, data in _each(batches)), ARC_ROW)


# ------------------------------------------------------------------ WARC

def _warc_record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def _converted(archive: str, data: bytes, revisits: dict[int, dict]) -> bytes:
    """The WARC file of one ARC file; its last record's end is left to the writer."""
    out = []
    for r in arc_records(archive, data):
        if r["record_id"] is None:
            continue
        block, body_at, url = r["block"], r["body_at"], r["url"]
        earlier, http = revisits.get(r["at"]), block.startswith(b"HTTP/")
        headers = {"WARC-Type": "revisit" if earlier else r["type"], "WARC-Record-ID": r["record_id"],
                   "WARC-Date": r["date"] or "1996-01-01T00:00:00Z"}
        if r["type"] == "warcinfo":
            headers |= {"WARC-Filename": re.sub(r"\.arc$", ".warc", url.removeprefix("filedesc://")),
                        "Content-Type": "application/warc-fields"}
            block = f"software: tallywise\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC/{r['version']}\r\n".encode()
        else:
            headers |= {"WARC-Target-URI": url, "WARC-IP-Address": r["ip"] if r["ip"] not in ("-", "0.0.0.0") else None,
                        "WARC-Payload-Digest": _sha1(block[body_at:]), "WARC-Truncated": "length" if r["problem"] else None,
                        "Content-Type": "application/http; msgtype=response" if http else r["mime"]}
        if earlier:
            headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": earlier["record_id"],
                        "WARC-Refers-To-Target-URI": earlier["url"], "WARC-Refers-To-Date": earlier["date"],
                        "X-Payload-Length": str(len(block) - body_at)}
            block = block[:body_at]
        out.append(_warc_record(headers | {"WARC-Block-Digest": _sha1(block)}, block))
    return b"\r\n\r\n".join(out)


def warc_records(archive: str, data: bytes) -> Iterator[dict]:
    """The records of one WARC file, each with the bytes of its block."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        top = data.find(b"\r\n\r\n", at)
        lines = data[at:top].decode("utf-8", "replace").split("\r\n") if top >= 0 else []
        headers = dict(h.split(": ", 1) for h in lines[1:] if ": " in h)
        size = headers.get("Content-Length", "")
        row = {"archive": archive, "at": at, "type": headers.get("WARC-Type"), "record_id": headers.get("WARC-Record-ID"),
               "uri": headers.get("WARC-Target-URI"), "date": headers.get("WARC-Date"), "headers": list(headers.items())}
        if not size.isdecimal():
            yield row | {"block": b"", "body_at": 0, "problem": "no length"}
            at = data.find(b"\nWARC/", at) + 1 or len(data)
            continue
        block = data[top + 4:top + 4 + int(size)]
        yield row | {"block": block, "body_at": _body_at(block), "problem": None if len(block) == int(size) else "block ends early"}
        at = data.find(b"WARC/", top + 4 + int(size))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files in a folder, without their bytes."""
    return _files(spark, path).mapInArrow(
        lambda batches: (_indexed(warc_records(name, data), WARC_ROW) for name, data in _each(batches)), WARC_ROW)


def revisits(index: DataFrame, rank: Column, least: int = LEAST_REVISIT) -> DataFrame:
    """``archive, at`` of answers whose payload another one keeps, and which one that is (``kept``).

    ``index`` is what ``read_arc`` returns; the answer of the greatest ``rank`` is kept.
    """
    answers = index.filter((F.col("type") == "response") & (F.col("payload_bytes") >= least) & F.col("head").isNotNull())
    kept = F.struct(rank.alias("rank"), "archive", "at", "record_id", "url", "date")
    salted = answers.withColumn("_salt", F.pmod(F.xxhash64("archive", "at"), F.lit(SALTS))).withColumn("kept", kept)
    firsts = salted.groupBy("payload_sha1", "_salt").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    best = firsts.groupBy("payload_sha1").agg(F.max("kept").alias("kept"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    asked = firsts.select("payload_sha1", "_salt").join(best, "payload_sha1")
    return salted.drop("kept").join(asked, ["payload_sha1", "_salt"]) \
        .filter("archive <> kept.archive OR at <> kept.at").select("archive", "at", "kept")


def convert(spark: SparkSession, arc_path: str, warc_path: str, rank: Column | None = None,
            least: int = LEAST_REVISIT) -> None:
    """Write the WARC files of a folder of ARC files.

    ``rank`` (over the columns of ``read_arc``) says which of several equal payloads
    stays a response: the greatest; by default the earliest capture.
    """
    index = materialise(read_arc(spark, arc_path), "arc-index")
    if rank is None:
        rank = -F.unix_timestamp(F.to_timestamp("date"))
    lists = revisits(index, rank, least).groupBy("archive").agg(F.collect_list(F.struct(
        "at", F.col("kept.record_id").alias("record_id"), F.col("kept.url").alias("url"), F.col("kept.date").alias("date"))).alias("revisits"))
    # Each archive beside its own list, which is shorter than the archive has records.
    files = _files(spark, arc_path).join(lists.hint("shuffle_hash"), "archive", "left").select("archive", "content", "revisits")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content, found = (batch.column(c)[i].as_py() for c in range(3))
                file = _converted(name, _plain(content), {r["at"]: r for r in found or []})
                yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.binary())})

    _write_files(files.mapInArrow(rewritten, "file binary"), warc_path, "\r\n\r\n")


def answers_of(pages: DataFrame) -> DataFrame:
    """Pages (``page_id, url, html``) as the HTTP answers a crawler would have stored."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\nX-Page-Id: "),
                    F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n\r\n"))
    captured = F.timestamp_seconds(F.lit(820454400) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    return pages.select("url", F.lit("192.0.2.1").alias("ip"), F.date_format(captured, "yyyyMMddHHmmss").alias("date"),
                        F.lit("text/html").alias("mime"), F.concat(F.encode(head, "UTF-8"), payload).alias("block"))


def page_id() -> Column:
    """The page a record's HTTP headers name; null where they name none."""
    found = F.regexp_extract("head", r"\r\nX-Page-Id: (-?\d+)", 1)
    return F.when(found != "", found.cast("bigint"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Each page as the WARC files hold it, after writing ARC files, converting and reading."""
    spark = pages.sparkSession
    arc, warc = shared_dir(spark, "llm-arc"), shared_dir(spark, "llm-warc")
    write_arc(answers_of(pages), arc)
    convert(spark, arc, warc, F.coalesce(page_id(), F.lit(-(1 << 63))))
    held = materialise(read_warc(spark, warc).filter("type IN ('response', 'revisit')"), "warc-index")
    digits = F.regexp_extract(F.col("headers")["WARC-Payload-Digest"], "sha1:([A-Z2-7]+)", 1)
    records = held.select("archive", "at", page_id().alias("page_id"), F.col("type").alias("record_type"), "record_id",
                          F.col("headers")["WARC-Refers-To"].alias("refers_id"), digits.alias("base32"),
                          F.coalesce(F.col("headers")["X-Payload-Length"].cast("bigint"), F.col("payload_bytes")).alias("payload_bytes"))
    kept = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return look_up(records, ["refers_id"], ["archive", "at"], kept).select(
        "page_id", "payload_bytes", _hex("base32").alias("payload_digest"), "record_type", "refers_to")


def _hex(base32: str) -> Column:
    """32 base-32 digits as 40 hexadecimal ones."""
    bits = F.translate(F.col(base32), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv")
    # Eight digits of base 32 are ten of base 16.
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, i, 8), 32, 16)), 10, "0") for i in range(1, 33, 8)])


def oracle(least: int = LEAST_REVISIT) -> str:
    """The rows of ``round_trip`` in DuckDB SQL."""
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, CASE WHEN size >= {least} THEN row_number() OVER (PARTITION BY digest, size >= {least}
  ORDER BY page_id DESC NULLS LAST) ELSE 1 END AS k, max(page_id) OVER (PARTITION BY digest, size >= {least}) AS kept FROM p)
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN kept END AS refers_to FROM m"""
