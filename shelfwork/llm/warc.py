"""WARC archives: a writer through Spark's text sink and a salvaging reader.

Writer. Each record is one gzip member. The sink ends each row by a NUL byte, which is the last byte of a member anyway
(the length of its content, little-endian, below 16 MB; a longer record gets an empty member behind it), so the files
are plain ``.warc.gz``-style archives in any file system that Spark can write to. Of equal payloads the one with the
largest id is a ``response``, the others are ``revisit`` records without payload that refer to it.

A file is closed after FILE_BYTES, so that it can be read as one row.

Reader. Files are read as binary rows and scanned in one pass; members are inflated piece by piece, and no more is held
of one than an unfinished record, whose head may be long, and records that wait for the member's checks. After a record whose head, length or
payload digest is wrong, the reader searches on for the next version line, inside the member or the plain file, and
after a member that can't be inflated for the next member or version line. Of a member whose checks fail, records count
whose own payload digest is right. What it had to leave is a quarantined gap: a row with the file, the offsets and the
reason, and in a member that was read also the offsets inside its content. Gaps and records come in order and don't
overlap.

Defined results: a null payload is empty; equal payloads of fewer than ``least`` bytes are all responses; rows with the
same id and payload are all of the kind the first one is; an empty table gives no archive and no rows; other columns
don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwork.llm import buffers
from shelfwork.llm.storage import new_path, short_batches, stash

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Bytes of a file, about: a file is one row to the reader.
FILE_BYTES = 32 << 20


def digest(payload: bytes) -> str:
    """SHA-1 in base 32, as WARC has it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member, or two, whose last byte is 0."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def record(page_id: int, url: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    clean = re.sub(r"[\r\n\s]+", "%20", url)
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <urn:page:{page_id}>".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + clean.encode(), f"WARC-Payload-Digest: sha1:{payload_digest}".encode(),
    ]
    body = payload
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), f"WARC-Payload-Length: {len(payload)}".encode()]
        body = b""
    head.append(f"Content-Length: {len(body)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _digests(batches):
    for batch in batches:
        data, at = buffers.raw(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()), pa.array(at[1:] - at[:-1])], names=["page_id", "digest", "n"])


def _members(batches):
    from pyspark import TaskContext

    file, filled = 0, 0
    name = lambda n: pa.array([f"{TaskContext.get().partitionId():07d}-{file:05d}"] * n)
    for batch in batches:
        ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        data, at = buffers.raw(batch.column(2))
        out, held = [], 0
        for i, page in enumerate(ids):
            payload = data[at[i] : at[i + 1]].tobytes()
            out.append(member(record(page, urls[i] or "", payload, digest(payload), refers[i]))[:-1])
            held += len(out[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), name(len(out))], names=["value", "file"])
                filled += held
                file, filled = (file + 1, 0) if filled >= FILE_BYTES else (file, filled)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), name(len(out))], names=["value", "file"])
            filled += held
            file, filled = (file + 1, 0) if filled >= FILE_BYTES else (file, filled)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = stash(rows.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, n long"), "digests")
    again = known.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = stash(known.where(F.col("n") >= least).join(again, "digest").where("page_id < keep").select("page_id", F.col("digest").alias("d"), "keep").distinct(), "revisits")
    # ids are few and narrow beside the pages: only where there are revisits must pages meet them
    if not revisits.isEmpty():
        hexed = F.sha1(F.col("html").cast("binary"))
        marks = revisits.mapInArrow(_hexed, "page_id long, h string, keep long")
        rows = rows.withColumn("h", hexed).join(marks, ["page_id", "h"], "left").select("page_id", "url", "html", F.col("keep").alias("refers_to"))
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    packed = rows.mapInArrow(_members, "value binary, file string").select(F.col("value").cast("string").alias("value"), "file")
    packed.write.option("lineSep", "\0").partitionBy("file").text(path)


def _hexed(batches):
    for batch in batches:
        d = [base64.b32decode(x).hex() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.string()), batch.column(2)], names=["page_id", "h", "keep"])


#: The part of a head that is there already: a version line and fields, the last of which may not be whole.
_FIELDS = re.compile(rb"WARC/1\.(?:[01](?:\r(?:\n(?:[^\r\n:]+:[^\r\n]*\r\n)*+[^\r\n]*\r?)?)?)?\Z")
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | str:
    """(fields, body, end) of the record at ``at``, or what is wrong with it."""
    head = _HEAD.match(data, at)
    if not head:
        return "head"
    fields = {}
    for line in head[1].split(b"\r\n")[:-1]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "length"
    end = head.end() + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "length"
    body = data[head.end() : end]
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != f"sha1:{digest(body)}":
        return "digest"
    return fields, body, end + 4


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_ZEROS = re.compile(rb"\x00+")


class Member:
    """The gzip member of ``data`` at ``at``: ``pieces`` gives its content; then ``bad`` says what is wrong with it, if
    anything, and ``end`` where it ends, or where its bytes stop making sense. ``read`` is where the last piece's bytes start."""

    STEP = 1 << 14

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end, self.bad, self.read = data, at, at, None, at + 1

    def _body(self) -> int | None:
        """Where the deflated bytes begin: behind the head's optional fields."""
        data, flags, at = self.data, self.data[self.at + 3 : self.at + 4], self.at + 10
        if not flags or flags[0] & 0xE0:
            return None
        if flags[0] & 4:
            at += 2 + int.from_bytes(data[at : at + 2], "little")
        for bit in (8, 16):
            if flags[0] & bit:
                at = data.find(b"\0", at) + 1
                if not at:
                    return None
        return at + 2 * bool(flags[0] & 2)

    def pieces(self):
        at = self._body()
        if at is None:
            self.bad = "member"
            return
        z, view, crc, size, step = zlib.decompressobj(-15), memoryview(self.data), 0, 0, self.STEP
        while not z.eof:
            if at >= len(view):
                self.bad, self.end = "truncated", len(view)
                return
            before, piece = z.copy(), view[at : at + step]
            try:
                out = z.decompress(piece)
            except zlib.error:
                if step > 64:  # what comes before the damage is read in small steps
                    z, step = before, 64
                    if len(piece) > 64:
                        continue
                self.bad, self.end = "member", at
                return
            crc, size = zlib.crc32(out, crc), size + len(out)
            self.read = max(at, self.at + 1)
            at += len(piece) - len(z.unused_data)
            if out:
                yield out
        self.end = at + 8
        trailer = self.data[at : at + 8]
        if len(trailer) < 8:
            self.bad, self.end = "truncated", len(view)
        elif trailer != crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
            self.bad = "crc"


def contents(pieces):
    """('record', start, end, fields, body) and ('gap', start, end, reason, None) of a member's content, by its offsets."""
    held, base, gap, why, pieces, over = bytearray(), 0, None, "", iter(pieces), False
    while True:
        one = _first(held, over) if held or not over else None
        if one == "more":
            piece = next(pieces, None)
            over = piece is None
            held += piece or b""
            continue
        if one is None:
            break
        if not isinstance(one, str):
            if gap is not None:
                yield "gap", gap, base, why, None
                gap = None
            yield "record", base, base + one[2], one[0], one[1]
            used = one[2]
        else:
            if gap is None:
                gap, why = base, one
            used = held.find(VERSION, 1)
            if used < 0:  # the line may go on in the next piece
                used = len(held) if over else max(1, len(held) - len(VERSION) + 1)
        del held[:used]
        base += used
    if gap is not None:
        yield "gap", gap, base, why, None


def _first(held: bytearray, over: bool):
    """The record at the start of what is held, "more" if it isn't all there yet, or what is wrong with it."""
    if not over and len(held) < len(VERSION):
        return "more"
    if not held.startswith(VERSION):
        return "head"
    end = held.find(b"\r\n\r\n")
    if end < 0:  # a head may have any length, as long as its lines are fields
        return "head" if over or not _FIELDS.match(held) else "more"
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", bytes(held[: end + 2]), re.IGNORECASE)
    if length and not over and len(held) < end + 8 + int(length[1]):
        return "more"
    return parse(bytes(held[: end + 8 + int(length[1])])) if length else parse(bytes(held[: end + 4]))


def _sure(fields: dict) -> bool:
    """Whether the record's own digest was checked."""
    return fields.get("warc-type") == "response"


def salvage(data: bytes):
    """('record' or 'gap', offset, end, inner, inner_end, fields or reason, body) of a file, in order and without overlap.
    Offsets are those of the member or of the plain record; inner ones, in a member that was read, those of its content.
    Records, gaps, and padding of zero bytes and empty members, which are passed over, cover the file."""
    at, gap, why = 0, None, ""
    while at < len(data):
        if zeros := _ZEROS.match(data, at):
            if gap is None:
                at = zeros.end()
                continue
            bad, search, plain = "no record", zeros.end(), 0
        elif data.startswith(MAGIC, at):
            member, held, started, search, plain = Member(data, at), [], False, at + 1, 0
            for one in contents(member.pieces()):
                held.append(one)
                if one[0] == "record" and all(x[0] == "gap" or _sure(x[3]) for x in held):
                    if gap is not None:
                        yield "gap", gap, at, None, None, why, None
                        gap = None
                    started, search = True, member.read
                    for kind, a, b, what, body in held:
                        yield kind, at, None, a, b, what, body
                    held = []
                elif one[0] == "record" and _sure(one[3]):
                    search = member.read
            bad = member.bad
            if bad is None or search > at + 1 or started or any(x[0] == "record" and _sure(x[3]) for x in held):
                if gap is not None:
                    yield "gap", gap, at, None, None, why, None
                    gap = None
                for kind, a, b, what, body in held:
                    if kind == "record" and bad and not _sure(what):
                        kind, what, body = "gap", bad, None
                    yield kind, at, None, a, b, what, body
                if bad is None:
                    at = member.end
                    continue
                # damage may have swallowed the next members, so these are looked for behind the last good record;
                # what looks like a version line there may be part of it
                at, plain = member.end, member.end
        elif data.startswith(VERSION, at):
            one = parse(data, at)
            if not isinstance(one, str):
                if gap is not None:
                    yield "gap", gap, at, None, None, why, None
                    gap = None
                yield "record", at, one[2], None, None, one[0], one[1]
                at = one[2]
                continue
            bad, search, plain = one, at + 1, 0
        else:
            bad, search, plain = "no record", at + 1, 0
        found = _NEXT.search(data, search)
        while found and found[0] != MAGIC and found.start() < plain:
            found = _NEXT.search(data, found.end())
        after = found.start() if found else len(data)
        if gap is None and after > at:
            gap, why = at, bad
        at = after
    if gap is not None and gap < len(data):
        yield "gap", gap, len(data), None, None, why, None


_RECORD = "path string, offset long, end long, inner long, inner_end long, kind string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"
_NAMES = [c.split()[0] for c in _RECORD.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
_URN = re.compile(r"<urn:page:(-?\d+)>$")


def _number(text: str | None) -> int | None:
    m = _URN.match(text or "")
    return int(m[1]) if m else None


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for kind, at, end, a, b, fields, body in salvage(content.as_py() or b""):
                    if kind == "gap":
                        rows.append((path, at, end, a, b, kind, None, None, None, None, None, None, None, fields))
                    else:
                        revisit = fields.get("warc-type") == "revisit"
                        size = int(fields["warc-payload-length"]) if revisit and fields.get("warc-payload-length", "").isdigit() else len(body)
                        rows.append((path, at, end, a, b, kind, _number(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"), size, fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(fields.get("warc-refers-to")), body if payloads else None, None))
                        held += len(body) if payloads else 0
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives under ``path``: kind is ``record`` or ``gap``. ``end`` is null for what is inside a
    member, where ``inner`` and ``inner_end`` say which part of its content it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), _RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    short_batches(pages)
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    found = read(pages.sparkSession, path, payloads=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
