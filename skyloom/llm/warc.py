"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is its frames followed by
a seek table (a skippable frame with the compressed and plain size of every
frame and a fixed footer).  Writing returns an index that maps record ids to
bundle, frame and offset within the frame, so one record is read by one seek.
Records with equal payloads are stored once: that with the largest page_id is a
response, the others are revisits that refer to it.

A task writes to a name of its own attempt and moves it into place when it is
complete; only names in the index of successful tasks are ever read, so lost
executors and repeated attempts leave no trace in the result.

Edge cases: a null html is an empty payload (a null url an empty one); rows that
repeat a page_id and payload are each written, as the same type and under the same
record id, being the same record; a null page_id is kept and, being no largest id, is a revisit where a non-null one exists; an
empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import fresh_folder, partitions_for, stored, table

#: Plain bytes of a frame and of a bundle (a record larger than either has its own).
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27
#: Payloads of fewer bytes are never stored as revisits.
MIN_REVISIT_BYTES = 0
#: Compressed bytes that one task reads back, about.
READ_BYTES = 8 << 20
#: Copies of a payload are looked up in this many slices.
SALTS = 16

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "record_id string, bundle string, frame bigint, frame_offset bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(record: str) -> int | None:
    tail = record.rpartition(":")[2]
    return int(tail) if tail else None


def _plain(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def make_record(page_id: int | None, url: str, payload: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP header, with the length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_plain(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at offset {at}")
        yield fields, block
        at = end + 8 + size


class BundleWriter:
    """Appends records to frames; ``close`` adds the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.level, self.frames, self.buffer, self.members, self.size, self.plain = stream, level, [], [], [], 0, 0
        self.waiting = 0

    def add(self, name: str, record: bytes) -> list[tuple]:
        """Index entries of the frame that this record completed, if any."""
        done = self._flush() if self.waiting and self.waiting + len(record) > FRAME_BYTES else []
        self.members.append((name, self.waiting, len(record)))
        self.buffer.append(record)
        self.waiting += len(record)
        self.plain += len(record)
        return done

    def _flush(self) -> list[tuple]:
        if not self.buffer:
            return []
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(b"".join(self.buffer))
        self.stream.write(packed)
        entries = [(name, len(self.frames), self.size, len(packed), at, n) for name, at, n in self.members]
        self.frames.append((len(packed), self.waiting))
        self.size += len(packed)
        self.buffer, self.members, self.waiting = [], [], 0
        return entries

    def close(self) -> list[tuple]:
        done = self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        return done


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame, from the footer."""
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    stream.seek(size - 9 - width * n - 8)
    skip, length = struct.unpack("<II", stream.read(8))
    if skip != SKIPPABLE_MAGIC or length != width * n + 9:
        raise ValueError("broken seek table")
    body, out, at = stream.read(width * n), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, width * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(stream, offset: int, packed: int, plain: int) -> bytes:
    stream.seek(offset)
    return zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=max(plain, 1))


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, keeper (page_id of the response a revisit refers to, else null), revisit."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("id_key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    narrow = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "id_key", "digest").withColumn("salt", F.pmod(F.xxhash64("id_key"), F.lit(SALTS)))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).drop("copies")
    marks = narrow.join(groups, ["digest", "salt"]).where(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).select("id_key", "digest", "keeper").distinct()
    return rows.join(marks, ["id_key", "digest"], "left").select("page_id", "url", "payload", "keeper", F.col("keeper").isNotNull().alias("revisit"))


def write_archives(marked: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write bundles below ``folder`` (a URI that executors share); the index of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        writer, stream, name, serial = None, None, "", 0
        names = ["record_id", "bundle", "frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes"]

        def rows(entries: list[tuple], bundle: str) -> pa.RecordBatch:
            cols = list(zip(*[(e[0], bundle, *e[1:]) for e in entries], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)], names)

        def finish() -> list[tuple]:
            entries = writer.close()
            stream.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            return entries

        for b in batches:
            for page, url, payload, keeper, revisit in zip(*(b.column(i) for i in range(5)), strict=True):
                if writer is not None and writer.plain >= BUNDLE_BYTES:
                    if entries := finish():
                        yield rows(entries, name)
                    writer = None
                if writer is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{serial:04d}-{uuid.uuid4().hex[:8]}.warc.zst"
                    serial += 1
                    stream = fs.open_output_stream(f"{root}/{name}.part", compression=None)
                    writer = BundleWriter(stream)
                page = page.as_py()
                record = make_record(page, url.as_py(), payload.as_py(), revisit.as_py(), keeper.as_py(), date)
                if entries := writer.add(record_id(page), record):
                    yield rows(entries, name)
        if writer is not None and (entries := finish()):
            yield rows(entries, name)

    return marked.mapInArrow(run, INDEX_SCHEMA)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, whole frames at a time."""
    frames = index.select("bundle", "frame", F.floor(F.col("frame_offset") / READ_BYTES).alias("slice")).distinct()
    # runs of neighbouring frames of even size, one task for each on average
    width = max(partitions_for(index.sparkSession), frames.select("bundle", "slice").distinct().count())
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        opened, stream, frames = None, None, []
        for b in batches:
            for bundle, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bundle != opened:
                    path = f"{root}/{bundle}"
                    opened, stream = bundle, fs.open_input_file(path)
                    frames = seek_table(stream, fs.get_file_info(path).size)
                out = []
                for fields, block in parse_records(read_frame(stream, *frames[frame])):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = fields["warc-type"] == "revisit"
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    out.append((page_of(fields["warc-record-id"].strip("<>")), fields["warc-target-uri"], fields["warc-type"], size, digest, page_of(fields["warc-refers-to"].strip("<>")) if revisit else None, None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = frames.repartition(width, "bundle", "slice").sortWithinPartitions("bundle", "frame")
    return dealt.select("bundle", "frame").mapInArrow(run, schema)


def read_record(index_row, folder: str) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: one seek, one frame."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{index_row['bundle']}") as stream:
        stream.seek(index_row["frame_offset"])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(stream.read(index_row["frame_bytes"]))
    at = index_row["record_offset"]
    return next(parse_records(data[at : at + index_row["record_bytes"]]))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    index = stored(write_archives(mark_revisits(table(spark, sf_dir, "pages")), folder), "warc-index")
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
