"""Capture files: their formats, and readers of whole files as a batch or as they appear in a directory.

Rows: capture (path), frame (1-based), ts, link_type, payload. Spark's own file readers list and open the files here, so
any file system that Spark knows will do; each file is one task's work, and holds less than 2 GB. See `ranges` for files
of any size, and `live` for files that grow.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialise_at, remove
from ..functions.wire import Malformed

SCHEMA = "capture string, frame int, ts timestamp, link_type int, payload binary"
#: Magic numbers, as byte order and ticks a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION = b"\x0a\x0d\x0d\x0a"
SECTION_HEADER, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ROWS_A_BATCH, BYTES_A_BATCH = 4096, 8 << 20
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

Frame = tuple[datetime | None, int | None, bytes]


def when(ticks: int, per_second: int) -> datetime:
    return _EPOCH + timedelta(seconds=ticks // per_second, microseconds=ticks % per_second * 10**6 // per_second)


def classic(data: bytes) -> Iterator[Frame]:
    """Frames of a pcap file. The last frame may be shorter than its length says."""
    order, ticks = MAGIC[bytes(data[:4])]
    link = struct.unpack_from(f"{order}I", data, 20)[0] if len(data) >= 24 else None
    at = 24
    while at + 16 <= len(data):
        seconds, part, size, _ = struct.unpack_from(f"{order}4I", data, at)
        yield when(seconds * ticks + part, ticks), link, bytes(data[at + 16 : at + 16 + size])
        at += 16 + size


def blocks(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(byte order, type, body) of a pcapng file's blocks, up to the first with a bad length. The length of a section's
    header is read in the byte order in force before it."""
    order, at = "<", 0
    while at + 12 <= len(data):
        kind, size = struct.unpack_from(f"{order}2I", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == SECTION_HEADER and len(body) >= 4:
            order = "<" if body[:4] == b"\x4d\x3c\x2b\x1a" else ">"
        yield order, kind, body
        at += size


def next_generation(data: bytes) -> Iterator[Frame]:
    """Frames of a pcapng file's enhanced and simple packet blocks."""
    links: list[int] = []
    for order, kind, body in blocks(data):
        if kind == SECTION_HEADER:
            links = []
        elif kind == INTERFACE and len(body) >= 2:
            links.append(struct.unpack_from(f"{order}H", body)[0])
        elif kind == ENHANCED and len(body) >= 20:
            interface, high, low, size = struct.unpack_from(f"{order}4I", body)
            yield when(high << 32 | low, 10**6), links[interface] if interface < len(links) else None, bytes(body[20 : 20 + size])
        elif kind == SIMPLE and len(body) >= 16:
            (size,) = struct.unpack_from(f"{order}I", body, 8)
            yield None, links[0] if links else None, bytes(body[16 : 16 + size])


def frames(data: bytes | memoryview) -> Iterator[Frame]:
    magic = bytes(data[:4])
    if magic == SECTION:
        return next_generation(data)
    if magic in MAGIC:
        return classic(data)
    raise Malformed("unsupported capture format")


KINDS = pa.schema([("capture", pa.string()), ("frame", pa.int32()), ("ts", pa.timestamp("us", "UTC")), ("link_type", pa.int32()), ("payload", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


def _batches(batches):
    for batch in batches:
        for k, path in enumerate(batch.column(0).to_pylist()):
            data = memoryview(batch.column(1)[k].as_buffer())  # no copy of the file
            rows, held = [], 0
            for number, (ts, link, payload) in enumerate(frames(data), 1):
                rows.append((path, number, ts, link, payload))
                held += len(payload)
                if len(rows) >= ROWS_A_BATCH or held >= BYTES_A_BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def packets_of(files: DataFrame) -> DataFrame:
    """Rows of Spark's binaryFile source, batch or stream, to packets."""
    return files.select("path", "content").mapInArrow(_batches, SCHEMA)


def read_whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Packets of capture files, a file each task, read by Spark itself."""
    return packets_of(spark.read.format("binaryFile").load(path))


def stream_captures(spark: SparkSession, directory: str, glob: str | None = None, files_a_batch: int = 16) -> DataFrame:
    """The same for files that appear in a directory."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return packets_of((reader.option("pathGlobFilter", glob) if glob else reader).load(directory))


def _block(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


#: What a file of Ethernet frames begins with, and how a frame is written, by format.
HEADS = {
    "pcap": struct.pack("<4sHHiIII", b"\xd4\xc3\xb2\xa1", 2, 4, 0, 0, 65535, 1),
    "pcapng": _block(SECTION_HEADER, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(INTERFACE, struct.pack("<HHI", 1, 0, 65535)),
}


def record_bytes(form: str, payload: bytes, second: int) -> bytes:
    if form == "pcap":
        return struct.pack("<4I", second, 0, len(payload), len(payload)) + payload
    return _block(ENHANCED, struct.pack("<5I", 0, 0, second, len(payload), len(payload)) + payload)


def pcap_bytes(payloads: list[bytes], seconds: int = 0) -> bytes:
    """A little-endian pcap file of Ethernet frames."""
    return HEADS["pcap"] + b"".join(record_bytes("pcap", p, seconds + k) for k, p in enumerate(payloads))


def pcapng_bytes(payloads: list[bytes]) -> bytes:
    return HEADS["pcapng"] + b"".join(record_bytes("pcapng", p, k) for k, p in enumerate(payloads))


def _write_by_driver(packets: DataFrame, directory: str, form: str) -> None:
    """By Spark's own file system, in order: rows pass through the driver one partition at a time, so it holds no more than that."""
    spark = packets.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out, current, held = None, None, bytearray()
    for row in packets.select("file", "frame", "payload").orderBy("file", "frame").toLocalIterator():
        if row["file"] != current or len(held) > 1 << 20:
            if out is not None:
                out.write(held)
            held = bytearray()
        if row["file"] != current:
            if out is not None:
                out.close()
            current = row["file"]
            target = jvm.org.apache.hadoop.fs.Path(f"{directory}/{current}.{form}")
            out = target.getFileSystem(conf).create(target, True)
            held += HEADS[form]
        held += record_bytes(form, bytes(row["payload"]), int(row["frame"]))
    if out is not None:
        out.write(held)
        out.close()


def record_size(form: str, payload_size: int) -> int:
    """How many bytes record_bytes() has."""
    return 16 + payload_size if form == "pcap" else 32 + payload_size + -payload_size % 4


def _offsets(form: str):
    """Rows (file, frame, payload, part) with `at`: the bytes of their file before them in their partition."""

    def run(batches):
        current, at = None, 0
        for batch in batches:
            out = []
            for file, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if file != current:
                    current, at = file, 0
                out.append(at)
                at += record_size(form, len(payload.as_buffer()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "at"])

    return run


def _writer(directory: str, form: str):
    """Rows (file, frame, payload, at) into their places of files that are there."""

    def run(batches):
        for batch in batches:
            held, current, start, after = bytearray(), None, 0, -1

            def flush():
                if held:
                    with open(f"{directory}/{current}.{form}", "r+b") as out:
                        out.seek(start)
                        out.write(held)
                held.clear()

            for file, frame, payload, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != current or at != after or len(held) > 1 << 20:
                    flush()
                    current, start = file, at
                held += record_bytes(form, payload, frame)
                after = start + len(held)
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def write_captures(packets: DataFrame, directory: str, form: str = "pcap") -> None:
    """packets (file, frame, payload) as capture files `<file>.<form>` of a directory. Where files can be written at any place,
    tasks write them side by side: rows are range-partitioned by file and frame, and the sizes of the partitions tell where
    each row goes, so the driver holds a row a file. Elsewhere Spark's file system writes one file after another."""
    local = re.match(r"(?:file:/*)?(/.*)|file:/+(.*)", directory)
    if not local:
        return _write_by_driver(packets, directory, form)
    name = local[1] or "/" + local[2]
    ranged = packets.select("file", F.col("frame").cast("long").alias("frame"), F.col("payload")).repartitionByRange("file", "frame").sortWithinPartitions("file", "frame")
    rows = ranged.withColumn("part", F.spark_partition_id())
    stored, path = materialise_at(rows.mapInArrow(_offsets(form), "file string, frame long, payload binary, part int, at long"))
    size = F.octet_length("payload")
    size = size + 16 if form == "pcap" else size + 32 + F.pmod(-size, F.lit(4))
    parts = stored.groupBy("file", "part").agg(F.sum(size.cast("long")).alias("size"))
    order = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.withColumn("end", F.sum("size").over(order) + len(HEADS[form]))
    os.makedirs(name, exist_ok=True)
    for file, end in ends.groupBy("file").agg(F.max("end")).collect():
        with open(f"{name}/{file}.{form}", "wb") as out:
            out.write(HEADS[form])
            out.truncate(end)
    begins = ends.select("file", "part", (F.col("end") - F.col("size")).alias("begin"))
    placed = stored.join(F.broadcast(begins), ["file", "part"]).select("file", "frame", "payload", (F.col("begin") + F.col("at")).alias("at"))
    placed.mapInArrow(_writer(name, form), "n long").agg(F.sum("n")).first()
    remove(packets.sparkSession, path)


def number_frames(df: DataFrame, order: str, capture: str = "table") -> DataFrame:
    """Rows with a payload as packets whose frame is the number in `order` plus one."""
    return df.select(F.lit(capture).alias("capture"), (F.col(order) + 1).cast("int").alias("frame"), "payload")
