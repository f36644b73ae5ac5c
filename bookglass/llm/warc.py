"""WARC archives in Zstandard frames: written by Spark tasks, read back with validation."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.llm.common import prepare, written

#: Magic of the skippable frame that holds an archive's dictionary, and of a data frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which a task begins another archive; dictionary size; records a dictionary is trained on.
ARCHIVE_BYTES, DICT_BYTES, DICT_RECORDS = 4 * 1024 * 1024, 16 * 1024, 200
#: Payloads below this many bytes are stored again and again.
MIN_REVISIT = 1000
#: Bytes of an archive that go to the decoder at once; bytes of payloads that a task holds; revisits that may be broadcast.
CHUNK, HELD, BROADCAST_ROWS = 1 << 16, 4 * 1024 * 1024, 200_000
#: Pieces that the rows of one digest are dealt in.
SALTS = 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A frame, header, length or digest that is not as it must be."""


def _clean(value: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in value.encode("utf-8")) if not value.isprintable() or " " in value else value


def _name(page_id: int | None, payload: bytes) -> str:
    """A record's id: the page's, or for a page without one, one made of its payload."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(payload).hexdigest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response with the payload, or a revisit of an earlier response with its headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id, payload)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url or "about:blank")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()),
        ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A dictionary in a leading skippable frame, then a frame per record. Every archive has one: trained on its records, or, where
    these are too few or too much alike to train on, the beginnings of the records themselves."""
    samples = records[:: max(1, len(records) // DICT_RECORDS)]
    try:
        lead = zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        each = max(64, DICT_BYTES // max(1, len(samples)))
        lead = zstandard.ZstdCompressionDict(b"".join(x[:each] for x in samples)[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=lead, write_content_size=True, write_checksum=True)
    raw = lead.as_bytes()
    return struct.pack("<II", DICT_MAGIC, len(raw)) + raw + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame of an archive, after its dictionary is loaded. Other skippable frames are passed over."""
    at, trained = 0, None
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("the archive ends inside a frame's head")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise WarcError("the archive ends inside a skippable frame")
            if magic == DICT_MAGIC and at == 0:
                trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame begins at byte {at}")
        unpack = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        content, begin = [], at
        try:
            while not unpack.eof and at < len(data):  # in chunks, as the decoder copies what it has not used
                content.append(unpack.decompress(view[at : at + CHUNK]))
                at = min(at + CHUNK, len(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {begin} can't be decoded: {e}") from e
        if not unpack.eof:
            raise WarcError("the archive ends inside a frame")
        at -= len(unpack.unused_data)
        yield b"".join(content)


def parse(raw: bytes) -> dict:
    """Headers and payload of a frame's one record, after checks of version, headers, lengths and digests."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"header {name!r} is malformed or repeated")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"header {name} is missing")
    if not fields["content-length"].isdigit() or (n := int(fields["content-length"])) + 4 != len(rest) or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't match the record")
    block = rest[:n]
    if fields.get("warc-block-digest", "sha1:" + (d := hashlib.sha1(block).hexdigest())) != "sha1:" + hashlib.sha1(block).hexdigest():
        raise WarcError("the block's digest doesn't match")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise WarcError("no HTTP Content-Length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (sizes[0] != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
        raise WarcError("the payload's length or digest doesn't match")
    if fields["warc-type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("a revisit has a payload or refers to nothing")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x.startswith("<urn:page:") else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload": payload, "payload_bytes": sizes[0], "payload_digest": digest, "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None}


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of min_bytes and more, all but the largest page_id refer to it.

    Digests alone are dealt, those that occur twice in SALTS pieces, so a payload of a third of all pages is no task's
    own; what they yield, the pages that refer to another, is broadcast up to BROADCAST_ROWS and else joined by page_id.
    A page without page_id is a response of its own, refers to nothing and isn't referred to. Rows that repeat a page_id
    don't refer to it; if their payloads differ, each goes by its own.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary")))
    slim = p.select("page_id", digest.alias("digest")).where("page_id is not null and digest is not null")
    again = slim.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("keeper > least")
    pieces = again.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(pieces, ["digest", "salt"]).where("page_id < keeper")
    refers = written(met.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), F.col("keeper").alias("refers_to")).distinct(), "revisits")
    if refers.count() <= BROADCAST_ROWS:
        refers = F.broadcast(refers)
    return p.join(refers, (F.col("page_id") == F.col("__page")) & (digest == F.col("__digest")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records): zstd archives of about archive_bytes of payload each, one WARC record per page.

    Null html is an empty payload and a null url about:blank. A page of any size is one record; a record is held whole.
    A page without page_id has a record id made of its payload, and is read back without page_id. Rows that repeat a
    page_id are written each; a page_id never refers to itself. Other columns are not read, so their names may be any.
    No pages give no archives. Write the table out, or its ``archive`` column as files.
    """
    prepare(pages.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary()), pa.array([len(held)], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for page, url, html, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held.append(record(page, url, html or b"", refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return with_revisits(pages).mapInArrow(task, "archive binary, records long")


def read_archives(archives: DataFrame, column: str = "archive", *, payloads: bool = False) -> DataFrame:
    """A row per record of archives held in a binary column, such as spark.read.format("binaryFile") gives as content.

    Columns page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked for (empty for
    revisits). Rows leave as they are read, with at most HELD bytes of payloads in hand besides the archive. A faulty
    archive raises WarcError; a null or empty one has no records.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for x in frames(data.as_py() or b""):
                    r = parse(x)
                    rows.append({n: r[n] for n in names})
                    held += 200 + len(r["payload"]) * payloads
                    if held >= HELD:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return archives.select(column).mapInArrow(task, schema)
