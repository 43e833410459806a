"""WARC archives in Zstandard: a writer and the reader.

An archive begins with a skippable frame that holds the dictionary, followed by
one frame for each record. The reader takes the dictionary from there, decodes
frame by frame and checks what each record says of itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D  # magic number of the frame that holds a dictionary
FRAME = 0xFD2FB528  # magic number of a Zstandard frame
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MIN_REVISIT_BYTES = 100  # smaller payloads are never revisits
DICTIONARY_ROWS = 400  # bound on the pages that the dictionary is trained from, and on the bytes of each
DICTIONARY_ROW_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 15
ARCHIVE_BYTES = 16 << 20  # an archive is closed when it has grown to this
LEVEL = 3
RECORD = "urn:page:"


def train_dictionary(pages: DataFrame, html: str = "html", page_id: str = "page_id", rows: int = DICTIONARY_ROWS) -> bytes:
    """A dictionary of a bounded sample of pages, chosen by hash of the page_id; empty if there are too few to train one."""
    count = pages.count()
    share = (4 * rows + 64) / max(count, 1)
    sample = (pages.filter((F.pmod(F.xxhash64(page_id), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)) + 1) & (F.octet_length(html) > 0))
              .select(F.substring(F.col(html).cast("binary"), 1, DICTIONARY_ROW_BYTES).alias("head"))
              .orderBy(F.xxhash64("head")).limit(rows).collect())
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["head"]) for r in sample]).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike
        return b""


def mark_revisits(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: of pages with equal payloads all but the smallest page_id refer to it.

    Only digests are grouped; the smallest id is found before the shuffle, and adaptive execution splits the join for a
    payload that many pages have. Payloads below ``MIN_REVISIT_BYTES`` refer to nothing, nor do pages without an id or
    rows that repeat the smallest id.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = (rows.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    return (rows.join(first, "digest", "left")
            .select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record (the HTTP header without its payload) if it refers to another page."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"{RECORD}{name}"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD}{name}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{RECORD}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, and the folder's path there."""
    if re.match(r"file:/", folder):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_archives(marked: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes ``mark_revisits`` rows to ``folder`` (shared by all executors) and returns the number of records.

    A task writes one archive after another, each under a hidden name that becomes the final one when it's whole.
    A repeated task replaces its archives.
    """
    def write(batches) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        options = {"level": LEVEL, "write_content_size": True, "write_checksum": True}
        if dictionary:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(**options)
        lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
        frames: list[bytes] = []
        size = serial = total = 0

        def close() -> None:
            nonlocal frames, size, serial
            hidden, final = f"{path}/.{task:05d}-{serial:04d}-{attempt}.tmp", f"{path}/part-{task:05d}-{serial:04d}.warc.zst"
            with store.open_output_stream(hidden, compression=None) as out:
                for frame in (lead, *frames):
                    out.write(frame)
            store.move(hidden, final)
            frames, size, serial = [], 0, serial + 1

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                frames.append(packer.compress(record(*(v.as_py() for v in row))))
                size += len(frames[-1])
                total += 1
                if size >= archive_bytes:
                    close()
        if frames:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    ordered = marked.sortWithinPartitions("page_id", "digest", "url")  # so that a repeated task writes the same archives
    return ordered.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def frames_of(archive: bytes) -> Iterator[bytes]:
    """The decoded content of every frame, one after another, after the dictionary is loaded from a leading skippable frame."""
    view, at, unpacker = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"cut off at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIPPABLE & ~0xF == magic & ~0xF:
            if at + 8 + size > len(view):
                raise ValueError(f"skippable frame at byte {at} is cut off")
            if magic == SKIPPABLE and at == 0:
                content = bytes(view[8:8 + size])
                if content[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        frame, parts, fed = unpacker.decompressobj(), [], at
        while not frame.eof:
            piece = view[fed:fed + (1 << 14)]
            if not piece:
                raise ValueError(f"frame at byte {at} is cut off")
            parts.append(frame.decompress(piece))
            fed += len(piece)
        yield b"".join(parts)
        at = fed - len(frame.unused_data)


def parse(content: bytes) -> dict:
    """One record's page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload; ValueError if it isn't valid."""
    head, found, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    lacking = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(k)]
    if lacking:
        raise ValueError(f"header lacks {', '.join(lacking)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {max(0, len(rest) - 4)} bytes, header says {size}")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^content-length:[ \t]*(\d+)", http)
    if not found or not http.startswith(b"HTTP/") or not length:
        raise ValueError("no HTTP header")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha256:[0-9a-f]{64}", digest):
        raise ValueError("no payload digest")
    digest = digest.removeprefix("sha256:")
    refers_to = fields.get("warc-refers-to")
    if kind == "response":
        if len(payload) != int(length[1]) or hashlib.sha256(payload).hexdigest() != digest or refers_to:
            raise ValueError("payload differs from its header")
    elif kind != "revisit" or payload or not refers_to:
        raise ValueError(f"not a valid {kind} record")

    def page(name: str) -> str | None:
        m = re.fullmatch(rf"<{RECORD}(.+)>", name)
        if not m:
            raise ValueError(f"record id {name}")
        return None if m[1] == "null" else m[1]

    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(length[1]),
            "payload_digest": digest, "record_type": kind, "refers_to": page(refers_to) if refers_to else None, "payload": payload}


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` of every record, ids as strings.

    Archives are read whole, one at a time. A frame or record that isn't valid fails the query. ``payloads`` adds
    the payload (empty for revisits). A folder without archives has no rows.
    """
    types = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.string())] + [("payload", pa.binary())] * payloads

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for frame in frames_of(content.as_buffer().to_pybytes()):
                    rows.append(parse(frame))
                    size += len(rows[-1]["payload"]) if payloads else 0
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(types))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(types))

    shape = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in types)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(read, shape)
