"""Dictionary-compressed WARC archives.

An archive is a file: one leading skippable frame that holds a Zstandard dictionary, built
from the archive's own first records, and then one frame per record, each compressed with
that dictionary and readable alone.  Spark's text writer puts the frames, as bytes, into
any store it can reach and writes them again when an executor is lost; what it sets after
each row as a line end is an empty skippable frame, so the file is a plain Zstandard
stream.  Archives are read as byte streams: the dictionary by magic and length, then
record after record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, arrow_rows, join_counted
from tessera.plans.storage import shared_path, shared_table

#: Magic numbers of the dictionary's frame and of the empty frame after each row.
SKIPPABLE, EMPTY = 0x184D2A5D, 0x184D2A50
#: Records and bytes of an archive, records and bytes that its dictionary is built from.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1000, 16 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 400, 4 << 20, 64 << 10
_FRAMES = pa.schema([("archive", pa.string()), ("seq", pa.int32()), ("frame", pa.binary())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has no block; its target is named by page id."""
    revisit = refers_to is not None
    name = "none" if page_id is None else str(page_id)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'tessera:{name}:{digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()) or "about:blank",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-Id": name,
        "WARC-Payload-Length": str(size),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To-Page-Id"] = str(refers_to)
    else:
        head["Content-Type"] = "text/html; charset=utf-8"
    block = b"" if revisit else payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(stream: io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a decompressed archive."""
    held = bytearray()

    def have(n: int) -> bool:
        while len(held) < n:
            more = stream.read(max(chunk, n - len(held)))
            if not more:
                return False
            held.extend(more)
        return True

    while have(1):
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not have(seen + 1):
                raise ValueError("an archive ends within a record's header")
        lines = held[:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        if not have(start + size + 4) or held[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield head, bytes(held[start : start + size])
        del held[: start + size + 4]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; raw sample content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    if not raw:
        return None
    full = raw[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records: list[bytes]) -> Iterator[bytes]:
    """Frames of one archive: the dictionary's, then one for each record."""
    samples, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        if size + len(r) <= SAMPLE_BYTES:
            samples.append(r)
            size += len(r)
    trained = _dictionary(samples) if samples else b""
    yield struct.pack("<II", SKIPPABLE, len(trained)) + trained
    loaded = _loaded(trained)
    packer = zstandard.ZstdCompressor(level=6, write_content_size=True, **({"dict_data": loaded} if loaded else {}))
    for r in records:
        yield packer.compress(r)


def read_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of an archive file."""
    magic, size = struct.unpack_from("<II", raw) if len(raw) >= 8 else (0, 0)
    if magic != SKIPPABLE or len(raw) < 8 + size:
        raise ValueError("an archive starts with its dictionary frame")
    loaded = _loaded(raw[8 : 8 + size])
    opener = zstandard.ZstdDecompressor(**({"dict_data": loaded} if loaded else {}))
    yield from parse_records(opener.stream_reader(io.BytesIO(raw), read_across_frames=True))


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to); payload is null for revisits.

    The response of equal payloads is the row with the smallest page_id (null ids last);
    rows that repeat that id are responses too, as a record cannot revisit itself.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    own = own.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    groups = own.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    several = shared_table(groups.where("n > 1"), "revisits")
    joined = join_counted(own, several, "sha1", several.agg(F.sum("n")).first()[0] or 1, "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    out = joined.withColumn("refers_to", F.when(F.col("size") >= least, refers))
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "sha1", "size", "refers_to")


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None) -> str:
    """Writes archives of all pages below `folder` (a new one in the shared folder, where
    none is named), each as the one file of a folder named for it; returns the folder.

    Records of equal payloads of at least `least` bytes become one response and
    revisits.  Archives hold at most ARCHIVE_RECORDS records and about ARCHIVE_BYTES.
    """
    roles = _roles(pages, least)
    names = ["page_id", "url", "payload", "sha1", "size", "refers_to"]

    def run(batches):
        def frames() -> Iterator[tuple]:
            held: list[bytes] = []
            size = 0

            def flush() -> Iterator[tuple]:
                name = hashlib.sha256(b"".join(hashlib.sha256(r).digest() for r in held)).hexdigest()[:32]
                for seq, frame in enumerate(archive_frames(held)):
                    yield f"{name}.warc.zst", seq, frame

            for page_id, url, payload, sha1, n, refers_to in arrow_rows(batches, *names):
                held.append(record_bytes(page_id, url, payload or b"", base64.b32encode(sha1).decode(), n, refers_to))
                size += len(held[-1])
                if len(held) >= ARCHIVE_RECORDS or size >= ARCHIVE_BYTES:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        return arrow_batches(frames(), _FRAMES)

    folder = folder or shared_path(pages.sparkSession, "warc")
    ordered = roles.select(*names).mapInArrow(run, "archive string, seq int, frame binary").sortWithinPartitions("archive", "seq")
    after = struct.pack("<II", EMPTY, 0).decode("ascii")
    ordered.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", after).text(folder)
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives below a folder: page_id, payload (null for revisits),
    payload_bytes, payload_digest, record_type, refers_to.  A response's block is checked
    against its digest and length."""
    schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        def records() -> Iterator[tuple]:
            for path, raw in arrow_rows(batches, "path", "content"):
                for head, block in read_archive(raw):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size, kind = int(head["WARC-Payload-Length"]), head["WARC-Type"]
                    if kind == "response" and (len(block) != size or payload_digest(block) != digest):
                        raise ValueError(f"{path}: a payload does not match its digest")
                    page = head["WARC-Page-Id"]
                    to = head.get("WARC-Refers-To-Page-Id")
                    yield None if page == "none" else int(page), block if kind == "response" else None, size, digest, kind, None if to is None else int(to)

        return arrow_batches(records(), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(
        run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to archives, reads these back, and returns what they say per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty; empty payloads are equal payloads too (with least = 0).
    A null page_id is the largest; it is kept as null.  Rows repeating a page_id are
    records of their own.  Other columns are ignored; an empty table gives an empty
    result.
    """
    return read_archives(pages.sparkSession, write_archives(pages, least)).drop("payload")
