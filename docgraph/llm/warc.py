"""WARC archives in Zstandard: one frame a record behind a frame that holds the dictionary.

An archive begins with a skippable frame whose content is the dictionary, itself
compressed; then every record is a frame of its own, so a reader can start at
any. Frames are written as lines of Spark's text writer whose line end is an
empty skippable frame, which decoders pass over: so archives lie in any store
Spark writes to, appear when their task is committed, and a lost executor costs
its tasks alone. A partition begins a new archive after so many bytes.

Payloads that repeat are stored once: of the pages with equal payloads that of
the largest id is a response, the others are revisits of it, which keep the HTTP
header, and so the length, and the digest.

Nulls and edge cases: a null html is an empty payload, payloads of no bytes are
equal to each other. Rows that repeat the largest id of their payload are each a
response. A null page_id is below all others; where all of a payload's are null,
those are responses. A null url leaves its field out, spaces and control
characters in a url are written as %XX. An empty table gives no archive. Other
columns, of any name, are ignored. Payloads of any length are a record; a worker
holds one record and about 1 MB of others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.storage import shared_dir

from .common import Batches, broadcast_if_small, frugal, in_pieces, join_by_key, materialize

#: Fixed values of the formats: magic numbers of the dictionary's frame, of other skippable frames, of a frame, and of a dictionary.
DICTIONARY_FRAME, SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528, 0xEC30A437
#: An empty skippable frame.
PAUSE = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = {"WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length"}

#: Bytes of frames after which a partition begins another archive.
ARCHIVE_BYTES = 32 << 20
#: Pages, and bytes of each, that the dictionary is made from; it has no part in what is read back.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 14, 1 << 16

FRAMES = "archive int, seq long, frame binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, fault string"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train(pages: DataFrame, total: int) -> bytes | None:
    """A dictionary from about SAMPLE_PAGES pages that a hash of the id and payload picks; None if there are too few."""
    picked = F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, total // SAMPLE_PAGES))) == 0
    samples = [r[0].encode() for r in pages.where(picked).select(F.substring("html", 1, SAMPLE_BYTES)).limit(4 * SAMPLE_PAGES).collect() if r[0]]
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # the samples are too small or too much alike
        return None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block, b"", b""])


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, least: int = 0) -> None:
    """Writes archives of the pages (page_id, url, html) below ``path``; payloads of fewer than ``least`` bytes are all responses."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("key"), F.octet_length(html).alias("size"))
    groups = p.groupBy("key").agg(F.count("*").alias("key_rows"), F.max("page_id").alias("first"), F.max("size").alias("size"))
    groups = materialize(groups, "warc-groups")
    several = groups.where((F.col("key_rows") > 1) & (F.col("size") >= least)).select("key", "first")
    near = broadcast_if_small(several)
    met = p.join(near, "key", "left") if near is not several else join_by_key(p, several, ["key"], "left", sizes=groups.select("key", "key_rows"))
    dictionary = train(p, groups.agg(F.sum("key_rows")).first()[0] or 0)

    def run(batches: Batches) -> Batches:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
        archive, size, seq = 0, 0, 0
        head = struct.pack("<II", DICTIONARY_FRAME, len(stored := zstandard.ZstdCompressor(write_checksum=True).compress(dictionary))) + stored if dictionary else None
        for piece in in_pieces(batches, 2):
            rows = []
            for page_id, url, body, first in zip(*(piece.column(c).to_pylist() for c in range(4)), strict=True):
                if size >= archive_bytes:
                    archive, size = archive + 1, 0
                if not size and head:
                    rows.append((archive, seq, head))
                    seq += 1
                body = body.encode()
                frame = pack.compress(record(page_id, url, body, digest_of(body), first, first is not None and first != page_id, date))
                rows.append((archive, seq, frame))
                size, seq = size + len(frame), seq + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["archive", "seq", "frame"])

    frames = met.select("page_id", "url", "html", "first").mapInArrow(frugal(run), FRAMES).sortWithinPartitions("archive", "seq")
    frames.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", PAUSE.decode("ascii")).text(path)


class Fault(ValueError):
    """An archive or a record breaks its format."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its header and its blocks' headers."""
    info = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    to = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = False
    while not last:
        if to + 3 > len(data):
            raise Fault("frame is cut off")
        head = int.from_bytes(data[to : to + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        to += 3 + (1 if kind == 1 else size)
    to += 4 * info.has_checksum
    if to > len(data):
        raise Fault("frame is cut off")
    return to


def loaded(content: memoryview) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading frame: compressed or as it is."""
    magic = int.from_bytes(content[:4], "little")
    if magic == FRAME:
        return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(bytes(content)))
    if magic == DICTIONARY:
        return zstandard.ZstdCompressionDict(bytes(content))
    raise Fault("leading frame holds no dictionary")


def records_of(archive: bytes) -> Iterator[bytes]:
    """The content of each frame of an archive."""
    data, at, known = memoryview(archive), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise Fault("frame is cut off")
        magic, size = struct.unpack("<II", data[at : at + 8])
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise Fault("frame is cut off")
            if magic == DICTIONARY_FRAME:
                if at:
                    raise Fault("dictionary isn't at the start")
                known = loaded(data[8 : 8 + size])
            at += 8 + size
        elif magic == FRAME:
            try:
                to = frame_end(data, at)
                content = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[at:to])
            except zstandard.ZstdError as e:
                raise Fault(f"frame can't be decoded: {e}") from e
            yield content
            at = to
        else:
            raise Fault("neither a frame nor a skippable frame")


def headers_of(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip() or name in out:
            raise Fault(f"bad header line {name!r}")
        out[name] = value.strip()
    return out


def split_at(data: bytes, mark: bytes, what: str) -> tuple[bytes, bytes]:
    head, found, rest = data.partition(mark)
    if not found:
        raise Fault(f"{what} has no end")
    return head, rest


def number_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not m:
        raise Fault(f"{name!r} is no page")
    return int(m[1]) if m[1] else None


def parsed(content: bytes) -> tuple:
    """RECORDS without the fault; every header and length must agree with what the frame holds."""
    head, rest = split_at(content, b"\r\n\r\n", "record header")
    version, fields = split_at(head, b"\r\n", "first line")
    if version != VERSION:
        raise Fault(f"version {version[:20]!r}")
    h = headers_of(fields)
    if missing := sorted(NEEDED - h.keys()):
        raise Fault(f"no {missing[0]}")
    if not h["Content-Length"].isdigit() or len(rest) != int(h["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Fault("record isn't as long as its header says")
    block = rest[:-4]
    if h.get("WARC-Block-Digest", "") not in ("", f"sha1:{digest_of(block)}"):
        raise Fault("block differs from its digest")
    http, payload = split_at(block, b"\r\n\r\n", "HTTP header")
    sized = headers_of(split_at(http, b"\r\n", "status line")[1]).get("Content-Length", "")
    digest, kind = h.get("WARC-Payload-Digest", ""), h["WARC-Type"]
    if not sized.isdigit() or not digest.startswith("sha1:"):
        raise Fault("payload has no length or digest")
    if kind == "response":
        if len(payload) != int(sized) or digest != f"sha1:{digest_of(payload)}":
            raise Fault("payload differs from its length or digest")
    elif kind != "revisit" or payload or h.get("WARC-Profile") != REVISIT or "WARC-Refers-To" not in h:
        raise Fault("neither a response nor a revisit of an equal payload")
    revisit = kind == "revisit"
    return (
        number_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, number_of(h["WARC-Refers-To"]) if revisit else None, int(sized), digest[5:], None if revisit else payload, None,
    )


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives below ``path``; a record or archive that breaks its format is a row that has nothing but a ``fault``.

    After a faulty record the next frame is read; after a faulty frame no more of that archive.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")

    def run(batches: Batches) -> Batches:
        nothing = (None,) * 7
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                contents = records_of(content.as_py())
                while True:
                    try:
                        content_of = next(contents, None)
                        if content_of is None:
                            break
                        row = parsed(content_of)
                    except (Fault, UnicodeDecodeError) as e:
                        row = (*nothing, f"{name}: {e}")
                    rows.append(row if payloads else (*row[:6], None, row[7]))
                    held += len(row[6] or b"") + 200
                    if held > 1 << 20:
                        yield framed(rows)
                        rows, held = [], 0
                if rows:
                    yield framed(rows)

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    return files.mapInArrow(frugal(run), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of every revisit: that of the response of its digest."""
    bodies = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.any_value("payload").alias("body"))
    return records.join(bodies, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "body")).drop("body")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages' archives, written to the shared folder and read back; a fault raises."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    r = read(spark, path, payloads=False)
    checked = F.when(F.col("fault").isNotNull(), F.raise_error("fault").cast("long")).otherwise(F.col("page_id"))
    return r.select(checked.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
