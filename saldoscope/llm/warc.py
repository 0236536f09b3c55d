"""WARC archives: a writer with revisit records, and a salvage reader.

``plan_records`` decides response or revisit by payload digest: of equal payloads, the row
with the largest id is the response. Digests are grouped as narrow rows, combined before the
shuffle; payloads never travel by digest, so a payload shared by a third of all pages is no
hot task.

``write_archives`` makes one gzip member per record and lets Spark's text writer store the
members one after the other; its line separator is an empty gzip member, so each file is an
ordinary multi-member archive. A file holds one partition of the records; adaptive execution
sizes partitions by bytes (spark.sql.adaptive.advisoryPartitionSizeInBytes).

``read_archives`` reads files as bytes. It checks each gzip member (header, checksum, length)
and each record (version line, headers, content length, block end, payload digest). After a
failed check it searches for the next gzip member or version line that gives a valid record,
goes on there, and logs the bytes between as a quarantined gap (file, start, end, reason).
Plain files, and files that change between plain and compressed, are read in the same way.

A member may hold many records. The search for the next version line goes on inside it, also
when the member fails its checksum, is cut off or cannot be unpacked to its end: what was
unpacked until then is read like a plain file, and only the rest is given up. In such a member
a record without a payload digest to check (a revisit) counts if all its headers are well
formed. Bounds of gaps inside a member are those of the compressed pieces around them.

Defined results: a null payload is empty. Rows repeated with the same id and payload are
answered row by row. A record cut off at the end of a file is a gap.
"""

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .base import tune

EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), revisits (the response's id, or null)."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    digest = rows.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    equal = digest.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    revisits = digest.where(F.col("size") >= min_revisit_bytes).join(equal, "sha1").where("page_id != last").select("page_id", "sha1", "last").distinct()
    # rows that repeat an id may have several payloads: look the payload up among those of the id
    of_page = revisits.groupBy(F.col("page_id").alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("sha1", "last"))).alias("_m"))
    rows = rows.join(of_page, F.col("page_id") == F.col("_p"), "left")
    return rows.select("page_id", "url", "payload", F.col("_m")[F.sha1("payload")].alias("revisits"))


def record(page_id, url: str | None, payload: bytes, revisits: int | None) -> bytes:
    """One WARC record. The payload's length is kept in an extension field, for revisits."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if revisits is None else "revisit"
    block = payload if revisits is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if revisits is not None:
        lines += [f"WARC-Refers-To: <urn:page:{revisits}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str | None = None, compressed: bool = True) -> str:
    """Write planned records below ``path`` (default: the shared folder) and return the path."""
    spark = tune(records.sparkSession)
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisits")]
            made = (record(*r) for r in zip(*cols))
            # the text writer ends each value with the separator: the record's last blank line, or an empty member
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r, 6, mtime=0) if compressed else r[:-4] for r in made], pa.binary())], names=["value"])

    packed = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    separator = EMPTY_MEMBER.decode("latin-1") if compressed else "\r\n\r\n"
    packed.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)
    return path


# -- reading ------------------------------------------------------------------------------

_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
#: What ends the headers, or shows that they have no end: the next version line.
_STOP = re.compile(rb"\r\n\r\n|\nWARC/\d+\.\d+\r?\n")
_NAME = re.compile(rb"[!-9;-~]+")
_LINE = re.compile(rb"(?:[!-9;-~]+:|[ \t])[^\x00-\x08\x0a-\x1f\x7f]*")
_NEEDED = ("warc-type", "warc-record-id", "warc-date")


class Broken(Exception):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``at``, or Broken."""
    version = _VERSION.match(data, at)
    if not version:
        raise Broken("no version line")
    last = _STOP.search(data, version.end() - 2)  # headers may be of any length
    if not last or last[0] != b"\r\n\r\n":
        raise Broken("no end of headers")
    stop = last.start()
    head = {}
    for line in data[version.end():stop].split(b"\n"):
        name, colon, value = line.removesuffix(b"\r").partition(b":")
        if colon and _NAME.fullmatch(name):
            head[name.decode("latin-1").lower()] = value.strip(b" \t").decode("utf-8", "replace")
    if not all(head.get(name) for name in _NEEDED):
        raise Broken("a mandatory header is missing")
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    begin = stop + 4
    end = begin + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Broken("block is cut off" if end + 4 > len(data) else "block does not end where it should")
    block = data[begin:end]
    claimed = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and claimed.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != claimed[5:]:
            raise Broken("digest does not match")
    return head, block, end + 4


class Member:
    """The gzip member at ``at``: its content as far as it can be unpacked, where it ends, and
    what is wrong with it (null: nothing)."""

    def __init__(self, data: bytes, at: int, step: int = 1 << 16):
        self.fault, parts, pos, size = None, [], at, 0
        self.marks = [(at, 0)]  # (place in the file, bytes of content until there)
        unzip = zlib.decompressobj(31)
        while not unzip.eof and pos < len(data):
            before = unzip.copy() if pos > at else None
            try:
                part = unzip.decompress(data[pos:pos + step])
            except zlib.error as e:
                self.fault = f"gzip: {e}"[:80]
                part, step = _until_error(before or zlib.decompressobj(31), data[pos:pos + step])
            parts.append(part)
            pos, size = min(pos + step, len(data)), size + len(part)
            self.marks.append((pos, size))
            if self.fault:
                break
        self.content = b"".join(parts)
        if not unzip.eof and not self.fault:
            self.fault = "gzip member is cut off"
        self.end = pos if self.fault else pos - len(unzip.unused_data)
        self.marks[-1] = (self.end, size)

    def before(self, place: int) -> int:
        """A place in the file at or before a place in the content."""
        return self.marks[bisect.bisect_right(self.marks, place, key=lambda m: m[1]) - 1][0] if place else self.marks[0][0]


def _until_error(unzip, piece: bytes) -> tuple[bytes, int]:
    """What a piece gives before the byte that cannot be unpacked, and the bytes before that."""
    out = []
    for i in range(len(piece)):
        try:
            out.append(unzip.decompress(piece[i:i + 1]))
        except zlib.error:
            return b"".join(out), i
    return b"".join(out), len(piece)


def _well_formed(data: bytes, at: int, head: dict) -> bool:
    """Whether a record proves itself: by its payload digest, or else by headers of the right form."""
    if head["warc-type"] == "response" and head.get("warc-payload-digest", "").startswith("sha1:"):
        return True  # compared by parse_record
    lines = data[at:data.index(b"\r\n\r\n", at)].split(b"\r\n")[1:]
    try:
        return all(_LINE.fullmatch(x) and x.decode() for x in lines) and re.fullmatch(r"<[^<>]*>", head["warc-record-id"]) is not None
    except UnicodeDecodeError:
        return False


def _records(content: bytes, whole: bool) -> Iterator[tuple[int, int, dict | None, bytes, str | None]]:
    """(start, end, headers, block, None) of each record in the content of a member, and
    (start, end, None, b"", reason) of what stands between."""
    at, gap, why = 0, None, None
    while at < len(content):
        try:
            head, block, end = parse_record(content, at)
            if not whole and not _well_formed(content, at, head):
                raise Broken("headers are damaged")
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            nxt = _VERSION.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            continue
        if gap is not None:
            yield gap, at, None, b"", why
            gap = None
        yield at, end, head, block, None
        at = end
    if gap is not None:
        yield gap, len(content), None, b"", why


_START = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r?\n")


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str | None]]:
    """(start, end, headers, block, None) of each record, (start, end, None, b"", reason) of each gap."""
    at, gap, why = 0, None, None
    while at < len(data):
        if data[at:at + 2] == b"\x1f\x8b":
            member = Member(data, at)
            good = 0  # content until here is read
            for start, end, head, block, reason in _records(member.content, not member.fault):
                if head is None:
                    if gap is None:
                        gap, why = member.before(start), member.fault or reason
                    continue
                if gap is not None:
                    yield gap, max(member.before(start), gap + 1) if start else at, None, b"", why
                    gap = None
                yield at, member.end, head, block, None
                good = end
            if not member.fault:
                if gap is not None and not member.content and gap < at:
                    yield gap, at, None, b"", why
                    gap = None
                at = member.end
                continue
            if gap is None:
                gap, why = member.before(good), member.fault
            # records that were read prove the bytes before them, the next member starts behind
            nxt = _START.search(data, max(at + 1, member.before(good)))
            at = nxt.start() if nxt else len(data)
            continue
        try:
            head, block, end = parse_record(data, at)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap is not None:
            yield gap, at, None, b"", why
            gap = None
        yield at, end, head, block, None
        at = end
    if gap is not None:
        yield gap, len(data), None, b"", why


RECORD = "file string, start long, stop long, gap string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record or gap of the archives below ``path``; ``gap`` is null for records."""
    files = tune(spark).read.format("binaryFile").load(path).select("path", "content")

    def number(text: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split(" ")[1]] for f in RECORD.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for start, stop, head, block, why in salvage(content.as_py()):
                    if head is None:
                        rows.append((file, start, stop, why, None, None, None, None, None, None, None))
                    else:
                        size = head.get("warc-payload-length", "")
                        rows.append((file, start, stop, None, head.get("warc-type"), number(head.get("warc-record-id")), head.get("warc-target-uri"),
                                     int(size) if size.isdigit() else len(block), head.get("warc-payload-digest", "").removeprefix("sha1:"),
                                     number(head.get("warc-refers-to")), block if payloads else None))
                    held += len(block) + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.mapInArrow(unpack, RECORD)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write an archive of all pages, read it back: one row per page."""
    path = write_archives(plan_records(pages, min_revisit_bytes=min_revisit_bytes))
    back = read_archives(pages.sparkSession, path, payloads=False).where("gap is null")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
