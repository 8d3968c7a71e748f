"""Web archives: writing page records as compressed members, and a reader that salvages what it can from damaged files.

Archives are written by the text sink, so any file system that Spark knows will do. A row is one compressed member, and
the line separator is an empty member, which readers of such files pass over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks, utf8
from tracewright.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
ROWS_PER_FILE = 64
NEXT_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_name(key) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def record(kind: str, key, url: str | None, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record. A revisit keeps the HTTP head of the full payload and names the record that holds it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", page_name(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def with_record_types(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(key, url, payload, digest, size, kind, head) of every page: of equal payloads of `least_bytes` the smallest id is the response.

    Repeated rows of that id are responses too. A null html is an empty payload; pages without id never are the head
    of others. Digests are grouped before pages meet them, so a payload that a third of the pages share is one row there.
    """
    raw = pages.select(F.col("page_id").alias("key"), "url", utf8(F.col("html")).alias("payload"))
    raw = raw.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    heads = raw.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("key").alias("head"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    out = raw.join(heads, "digest", "left")
    again = F.col("head").isNotNull() & ~F.col("key").eqNullSafe(F.col("head"))
    return out.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("head", F.when(again, F.col("head")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> None:
    """Archives of all pages in `folder`, each of about `file_bytes`, or of one larger member and what was before it.

    The sink starts a new file after a number of rows. A row holds members of 1/64 of a file together; a larger member
    is followed by as many empty rows as make up its size, of which the file has nothing but separators.
    """
    share = max(1, file_bytes // ROWS_PER_FILE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for row in batch.slice(at, 200).to_pylist():
                    made = gzip.compress(record(row["kind"], row["key"], row["url"], row["payload"], row["digest"], row["size"], row["head"], date), 3, mtime=0)
                    if members and held + len(made) > share:
                        rows.append(b"".join(members))
                        members, held = [], 0
                    members.append(made)
                    held += len(made)
                    if held > share:
                        rows += [made] + [b""] * min((held - 1) // share, ROWS_PER_FILE - 1)
                        members, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["member"])
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["member"])

    members = by_tasks(with_record_types(pages, least_bytes), work, "member binary")
    rolled = members.select(F.col("member").cast("string").alias("value")).write.option("maxRecordsPerFile", ROWS_PER_FILE)
    rolled.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


class Damaged(Exception):
    """A check failed; `end` is where the damage certainly ends, if known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def can_check(wanted: str) -> bool:
    return wanted.partition(":")[0].lower() in ("sha1", "sha256", "md5")


def digest_fits(wanted: str, data: bytes) -> bool:
    """Is this the digest of the data? Unknown kinds of digests can't be checked and pass."""
    name, _, value = wanted.partition(":")
    if not can_check(wanted):
        return True
    found = hashlib.new(name.lower(), data)
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The checked record at a place, and the place after it."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    fields = {}
    line_start = data.find(b"\n", at) + 1
    while (stop := data.find(b"\r\n", line_start)) > line_start:
        name, colon, value = data[line_start:stop].partition(b":")
        if not colon:
            raise Damaged("head line without colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        line_start = stop + 2
    if stop < 0:
        raise Damaged("head does not end")
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damaged("no content length")
    start, end = stop + 2, stop + 2 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[start:end]
    if not digest_fits(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs", end + 4)
    payload, length = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("HTTP head does not end", end + 4)
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        length = int(told[1]) if told else len(payload)
    kind = fields.get("warc-type", "")
    if kind == "response" and length == len(payload) and not digest_fits(fields.get("warc-payload-digest", ""), payload):
        raise Damaged("payload digest differs", end + 4)
    return {"kind": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest"), "payload_length": length, "payload": payload, "checked": can_check(fields.get("warc-block-digest", ""))}, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int | None, int, str | None]:
    """The content of the compressed member at a place, the place after it, how far its bytes were read, and the failed check, if any.

    Of a damaged member the content is what comes before the damage, and its end is not known.
    """
    engine, out, here = zlib.decompressobj(31), [], at
    while not engine.eof and here < len(data):
        before = engine.copy()
        try:
            out.append(engine.decompress(data[here : here + 65536]))
            here += 65536
        except zlib.error as error:
            # The failed call keeps its output to itself: take its bytes one by one.
            try:
                while True:
                    out.append(before.decompress(data[here : here + 1]))
                    here += 1
            except zlib.error:
                pass
            return b"".join(out), None, here, f"member: {error}"
    if not engine.eof:
        return b"".join(out), None, len(data), "member is cut off"
    end = min(here, len(data)) - len(engine.unused_data)
    return b"".join(out), end, end, None


def unit(data: bytes, at: int) -> tuple[list[dict], int | None, int]:
    """The checked records of the member or plain record at a place, the place after it (if known), and how far its bytes were read.

    Damage inside a member leaves its other records: its content is searched for the next version line, and a gap among
    the records names the bytes of the content that were passed over. Where the member's own check fails, a record holds
    only by its block digest. A member of one record
    stands and falls with it. If nothing holds, the check is raised.
    """
    if data[at : at + 3] != MAGIC:
        found, end = parse(data, at)
        return [found | {"offset": at, "length": end - at}], end, end
    plain, end, reach, reason = inflate(data, at)
    rows, here, gap, first = [], 0, None, None
    # A failed sum puts every byte in doubt, a cut only those that are missing.
    failed = reason is not None and reason.startswith("member: ")

    def passed(to: int) -> dict:
        why = reason if reason and to == len(plain) else first
        return {"kind": "gap", "offset": at, "reason": f"{why} (bytes {gap} to {to} of the member's content)"}

    while here < len(plain):
        try:
            found, after = parse(plain, here)
            if failed and not found["checked"]:
                raise Damaged("record without digest in a damaged member", after)
        except Damaged as damage:
            if gap is None:
                gap, first = here, str(damage)
            onward = VERSION.search(plain, damage.end if damage.end is not None else here + 1)
            here = onward.start() if onward else len(plain)
            continue
        if gap is not None:
            rows.append(passed(here))
            gap = None
        rows.append(found | {"offset": at})
        here = after
    if gap is not None:
        rows.append(passed(len(plain)))
    elif reason:
        rows.append({"kind": "gap", "offset": at, "reason": f"{reason} (after {len(plain)} bytes of the member's content)"})
    held = sum(r["kind"] != "gap" for r in rows)
    if rows and not held or reason and held == 1 and not VERSION.search(plain, 1):
        raise Damaged(reason or first, end)
    if end is not None:
        rows = [r | {"length": end - at} for r in rows]
    return rows, end, reach


def salvage(data: bytes) -> Iterator[dict]:
    """Records of one archive in order, and a row for each gap of quarantined bytes.

    Where a check fails, the next place that starts a member or record with something valid is looked for; the bytes before
    it are the gap. Records and gaps inside one member all have the member's place and length.
    """
    at, known = 0, None
    while at < len(data):
        start, rows, reason = at, [], None
        try:
            rows, end, reach = known or unit(data, at)
        except Damaged as damage:
            end, reach, reason = None, at, str(damage)
            at = damage.end if damage.end is not None else at + 1
        known = None
        if end is not None:
            yield from rows
            at = end
            continue
        # Records of a member without end may lie bare in its bytes too, where it is stored uncompressed.
        told = [content(r) for r in rows if r["kind"] != "gap"]
        at = max(at, start + 1)
        while at < len(data):
            found = NEXT_START.search(data, at)
            at = found.start() if found else len(data)
            if found:
                try:
                    known = unit(data, at)
                except Damaged as damage:
                    at += 1
                    continue
                if data[at : at + 3] != MAGIC and content(known[0][0]) in told:
                    at, known = known[1], None
                    continue
                break
        # A member cut inside a stored block runs on into the bytes of the next one, whose records are told there.
        rows = [r for r in rows if not r.get("payload") or data.find(r["payload"], at, reach) < 0]
        yield from [r | {"length": at - start} for r in rows] or [{"kind": "gap", "offset": start, "length": at - start, "reason": reason or "member is damaged"}]


def content(row: dict) -> tuple:
    return tuple(row.get(c) for c in ("kind", "record_id", "uri", "refers_to", "payload_digest", "payload_length", "payload"))


COLUMNS = ("kind", "offset", "length", "record_id", "uri", "refers_to", "payload_digest", "payload_length", "payload", "reason")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives of a folder: (file, kind, offset, length, ..., payload, reason).

    A gap has kind `gap` and the reason of its first failed check. A file is one value of one task, so files hold at most
    what Spark's binary reader admits (2 GB) and should be cut to some ten MB by their writer; larger ones are an error.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows: list[tuple] = []
                for row in salvage(content.as_py()):
                    if not payloads:
                        row["payload"] = None
                    rows.append((name.as_py(), *[row.get(c) for c in COLUMNS]))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", *COLUMNS])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", *COLUMNS])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return by_tasks(files, work, "file string, kind string, offset long, length long, record_id string, uri string, refers_to string, payload_digest string, payload_length long, payload binary, reason string")


def page_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back: one row per page.

    An empty table gives no rows. Archives are rolled at about 64 MB. They stay in the folder of the run, as the rows are read from them.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, least_bytes)
    found = read_archives(pages.sparkSession, folder, payloads=False)
    return found.filter(F.col("kind").isin("response", "revisit")).select(
        page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("kind").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "file", "offset",
    )
