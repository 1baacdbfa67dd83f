"""WARC archives: a writer with revisit records and a reader that salvages what damage has left.

Writer: every page becomes one record in a gzip member of its own. Of equal payloads of ``least`` bytes or more, the
page with the smallest key carries the payload (response) and the others refer to it (revisit); smaller payloads are
always carried. The members go through Spark's text sink, so the committer of the session keeps the archives whole when
tasks are retried, on any file system. That sink ends each line with a separator: every record is followed by an empty
gzip member, whose last byte is zero, and zero is the separator.

Reader: members and records are checked (inflation and its checksum, version line, lengths, closing line ends, payload
digest). After a failed check it looks for the next gzip member or version line that passes, goes on from there, and
reports the bytes between as a gap with the reason. A member of several records is searched alike: what was inflated
up to a fault is kept, its sound records are given, and the gap's reason names the places in the member's content.
Where only the member's checksum is wrong and no record shows the fault, records with a payload digest are given if
there are several. Archives of bare records are read alike. A task holds one archive at a time; ``records_per_file``
bounds its size.

Defined cases: a null payload is the empty payload. A null URL leaves its header out, a null key gives a record without
a page key that is never the one others refer to. Rows that repeat key and payload are written one by one, all as
response where theirs is the smallest key. An empty table gives no archives, and reading those gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.batches import bounded

VERSION = b"WARC/1.1"
LINE = b"\r\n"
# gzip members and their end
MAGIC = b"\x1f\x8b\x08"
FEED = 1 << 16
# never in header lines; the borders of stored blocks hold one
CONTROL = re.compile(rb"[\x00-\x08\x0a-\x1f\x7f]")
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FOUND = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("stated_bytes", T.LongType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("reason", T.StringType()),
    ]
)
GAP = "gap"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


def header_value(value: str) -> str:
    """Control characters, which would end a header line, as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = page if page is not None else f"unnamed:{digest}"
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + LINE + LINE + block + LINE + LINE


class Damaged(ValueError):
    """A check failed; the message says which."""


class Uninflated(Damaged):
    """A gzip member that fails its checks, with the bytes inflated up to the fault."""

    def __init__(self, message: str, content: bytes, read_to: int, checksum: bool = False, cut: bool = False):
        super().__init__(message)
        self.content, self.read_to, self.checksum, self.cut = content, read_to, checksum, cut


def inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where it ends."""
    unpacker = zlib.decompressobj(31)
    parts, fed = [], at
    try:
        while not unpacker.eof and fed < len(data):
            parts.append(unpacker.decompress(data[fed : fed + FEED]))
            fed = min(fed + FEED, len(data))
    except zlib.error:
        raise up_to_fault(data, at, fed) from None
    if not unpacker.eof:
        raise Uninflated("gzip member: cut off", b"".join(parts), fed, cut=True)
    return b"".join(parts), fed - len(unpacker.unused_data)


def up_to_fault(data: memoryview, at: int, sound: int) -> Uninflated:
    """Inflate the member again; from ``sound`` on byte by byte, as a failing call returns nothing of its bytes."""
    unpacker = zlib.decompressobj(31)
    parts = [unpacker.decompress(data[i : min(i + FEED, sound)]) for i in range(at, sound, FEED)]
    place = sound
    try:
        while True:
            parts.append(unpacker.decompress(data[place : place + 1]))
            place += 1
    except zlib.error as error:
        # wrong sums come after the last byte of the content, so they do not say where in it the fault lies
        content = b"".join(parts)
        checksum = "incorrect length check" in str(error)
        if "incorrect data check" in str(error):
            # of another length than the four bytes after the sum say, it is not what was packed
            checksum = bytes(data[place + 1 : place + 5]) == (len(content) & 0xFFFFFFFF).to_bytes(4, "little")
        return Uninflated(f"gzip member: {error}", content, place, checksum)


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    head_end = data.find(LINE + LINE, at)
    if not data.startswith(b"WARC/", at) or head_end < 0:
        raise Damaged("no version line or no end of the headers")
    first, *lines = data[at:head_end].split(LINE)
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        raise Damaged("version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        if CONTROL.search(line):
            raise Damaged("control character in the headers")
        name = name.strip().lower().decode("latin-1")
        if name in headers:
            raise Damaged("repeated header, as where two records ran together")
        headers[name] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"<[^<>\s]+>", headers.get("warc-record-id", "")) or not {"warc-type", "warc-date"} <= set(headers):
        raise Damaged("a header that every record has is missing")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        raise Damaged("content length missing")
    start = head_end + 4
    end = start + int(size)
    if data[end : end + 4] != LINE + LINE:
        raise Damaged("block is not as long as stated")
    block = data[start:end]
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and stated.startswith("sha256:"):
        if hashlib.sha256(http_payload(block)[1]).hexdigest() != stated[7:]:
            raise Damaged("payload digest")
    return headers, block, end + 4


def http_payload(block: bytes) -> tuple[int | None, bytes]:
    """(length stated by the HTTP headers, payload) of a block."""
    head, gap, payload = block.partition(LINE + LINE)
    if not gap:
        return None, block
    stated = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,15})", head)
    return int(stated[1]) if stated else None, payload


def sound_records(raw: bytes, in_step: bool = True) -> tuple[list, list[str]]:
    """The records of a member's content that pass their checks, and for each gap its place in the content and reason.

    Where the content is not ``in_step`` with what was packed, it ends at the first fault, and at the last proven record.
    """
    found, faults = [], []
    at, gap_at, reason = 0, None, ""
    while at < len(raw):
        try:
            headers, block, end = parsed(raw, at)
        except Damaged as error:
            if gap_at is None:
                gap_at, reason = at, str(error)
            if not in_step:
                break
            following = raw.find(b"WARC/", at + 1)
            at = following if following >= 0 else len(raw)
            continue
        if gap_at is not None:
            faults.append(f"bytes {gap_at} to {at} of the content: {reason}")
            gap_at = None
        found.append((headers, block))
        at = end
    if gap_at is not None:
        faults.append(f"bytes {gap_at} to {len(raw)} of the content: {reason}")
    while not in_step and found and not has_digest(found[-1][0]):
        found.pop()
    return found, faults


def has_digest(headers: dict[str, str]) -> bool:
    return headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha256:")


def entry_at(data: bytes, view: memoryview, at: int) -> tuple[list, int | None, str | None, int]:
    """The sound records of the member or bare record at ``at``, where it ends if that is known, the reason if it is
    damaged, and how far it was read."""
    if not data.startswith(MAGIC, at):
        try:
            headers, block, end = parsed(data, at)
        except Damaged as error:
            return [], None, str(error), at
        return [(headers, block)], end, None, end
    try:
        raw, end = inflated(view, at)
    except Uninflated as error:
        # after a broken symbol copies come from wrong places, so that later headers may be made of others; stored
        # content and content up to a cut has no such copies
        stored = len(error.content) >= 0.99 * (error.read_to - at) - 64 and len(error.content) < error.read_to - at
        found, faults = sound_records(error.content, error.checksum or error.cut or stored)
        if error.checksum and not faults:
            # the fault is in a header, which no digest covers, or in the sums; a lone record is then the one in doubt
            found = [r for r in found if has_digest(r[0])] if len(found) > 1 else []
            faults = ["not shown by any record, headers unproven"]
        return found, None, "; ".join([str(error), *faults]), error.read_to
    found, faults = sound_records(raw)
    return found, end, "; ".join(faults) or None, end


def salvaged(data: bytes):
    """(offset, length, records, reason) over all bytes: records of a sound entry, or a gap with its reason.

    A gap that starts with a damaged member has the sound records of that member, and their faults in the reason. The
    bytes that were read as the member's are not read as bare records again: a member that is stored, not deflated, shows
    its content in them, with block borders between. Whole members among them are taken, as a member that was cut is read
    on into the next. Bare records after them go to the same gap, which ends at the next sound member.
    """
    view = memoryview(data)
    start = re.compile(re.escape(MAGIC) + b"|WARC/")
    at, gap_at, reason, kept, read_to = 0, None, "", [], 0

    def onward() -> int:
        following = start.search(data, at + 1)
        return following.start() if following else len(data)

    while at < len(data):
        packed = data.startswith(MAGIC, at)
        if not packed and at < read_to:
            at = onward()
            continue
        records, end, fault, reach = entry_at(data, view, at)
        if fault is None:
            if read_to and not packed:
                kept = kept + records
            elif records:
                if gap_at is not None:
                    yield gap_at, at - gap_at, kept, reason
                    gap_at, kept, read_to = None, [], 0
                yield at, end - at, records, None
            # an empty member inside a gap says nothing about the bytes before it
            at = end
            continue
        if gap_at is not None and records and kept:
            # members that follow each other, each with sound records, are logged one by one
            yield gap_at, at - gap_at, kept, reason
            gap_at, kept, read_to = None, [], 0
        alone = gap_at is None
        if alone:
            gap_at, reason = at, fault
        elif records:
            reason = f"{reason}; {fault} (member at {at})"
        kept = kept + records
        if end is None:
            # what is no member has been read as far as its own place
            read_to = max(read_to, reach) if packed and (records or alone) else read_to
            at = onward()
            continue
        at = end
        if alone or records:
            yield gap_at, at - gap_at, kept, reason
            gap_at, kept, read_to = None, [], 0
    if gap_at is not None:
        yield gap_at, len(data) - gap_at, kept, reason


def write(pages: DataFrame, key: str, url: str, payload: str, folder: str, least: int = 100, records_per_file: int = 2000):
    """Write one record per row to archives in ``folder``."""
    rows = pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    small = rows.select("key", "digest", F.octet_length("payload").alias("bytes")).filter(F.col("bytes") >= least)
    firsts = small.groupBy("digest").agg(F.min("key").alias("first"))
    # equal payloads meet as keys and digests alone; only the revisits go on, to join the payloads by page
    repeats = (
        small.join(firsts, "digest")
        .filter(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")))
        .select(F.col("key").alias("repeat_key"), F.col("digest").alias("repeat_digest"), "first")
        .distinct()
    )
    same = F.col("key").eqNullSafe(F.col("repeat_key")) & (F.col("digest") == F.col("repeat_digest"))
    marked = rows.join(repeats, same, "left").select(
        F.col("key").cast("string"),
        "url",
        "payload",
        "digest",
        F.col("first").cast("string").alias("refers_to"),
    )

    def members(batches):
        for batch in batches:
            out = [
                gzip_member(record(k, u, p, d, r)) + EMPTY_MEMBER[:-1]
                for k, u, p, d, r in zip(*(c.to_pylist() for c in batch.columns))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    lines = bounded(marked).mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").option("maxRecordsPerFile", records_per_file).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of FOUND: one per record, and one of kind ``gap`` per quarantined range of bytes."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                found = []
                for offset, length, records, reason in salvaged(content.as_py()):
                    place = {"path": path.as_py(), "offset": offset, "length": length}
                    if reason is not None:
                        found.append({**place, "kind": GAP, "reason": reason})
                    for headers, block in records:
                        size, data = http_payload(block)
                        kind = headers.get("warc-type")
                        found.append(
                            {
                                **place,
                                "kind": kind,
                                "page": page_name(headers.get("warc-record-id")),
                                "url": headers.get("warc-target-uri"),
                                "refers_to": page_name(headers.get("warc-refers-to")),
                                "stated_bytes": size,
                                "stated_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                "payload": data if kind != "revisit" else None,
                            }
                        )
                    if len(found) >= 256:
                        yield pa.RecordBatch.from_pylist(found, ARROW_FOUND)
                        found = []
                yield pa.RecordBatch.from_pylist(found, ARROW_FOUND)

    return files.mapInArrow(rows, FOUND)


ARROW_FOUND = pa.schema(
    [
        (f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()])
        for f in FOUND
    ]
)


def page_name(record_id: str | None) -> str | None:
    name = re.fullmatch(r"<urn:page:(?!unnamed:)(.*)>", record_id or "")
    return name[1] if name else None


def records(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind") != GAP)


def gaps(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind") == GAP).select("path", "offset", "length", "reason")
