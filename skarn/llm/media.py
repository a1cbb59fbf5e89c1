"""Media columns: texts stored as images in archives, written and read by a custom Spark data source.

A text's payload is its UTF-8 bytes and zeros up to a positive multiple of 64. It is stored without loss
as an 8-bit grey PNG, 64 samples wide, whose text chunk keeps the unpadded length. Images are members of
ZIP archives of bounded size in one folder; a task writes archives of its own, and the committed ones
are listed in a manifest, so that what lost or repeated tasks leave behind is never read.

Reading plans partitions of byte ranges from the manifest (paths and sizes only; the driver sees no
member). A task reads its archive's directory, takes the members that begin in its range, fetches runs
of neighbours at once and streams them as Arrow batches of bounded size. A member that can't be read or
fails its checksum is fetched again by its own offset, RETRIES times, without reading others again; if
that fails, the task fails and Spark repeats it.

The folder is opened with pyarrow's file systems (local and mounted paths, hdfs, s3, gs).

Defined results: null and empty texts have a payload of 64 zeros and n_bytes 0; texts of any length are one
member; null keys are passed on; repeated rows are members of their own, and equal texts give equal
media; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_path

WIDTH = 64
#: Stored bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Stored bytes of a read partition, and partitions of a read, about: beyond so many, ranges grow with what is stored.
RANGE_BYTES, MOST_RANGES = 16 << 20, 100_000
#: Payload bytes of an Arrow batch, about.
BATCH_BYTES = 4 << 20
RETRIES = 3
LEVEL = 1
MANIFEST = "_manifest.json"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(text: bytes) -> bytes:
    """The PNG of a text's payload."""
    samples = np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int]:
    """The samples and the unpadded length of an image that encode() made."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, packed, n_bytes, height = 8, [], None, 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("broken chunk")
        at += 12 + size
        if kind == b"IHDR":
            height = struct.unpack(">II", data[:8])[1]
        elif kind == b"tEXt":
            n_bytes = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            packed.append(data)
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that is not used here")
    return rows[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and the columns that are brighter than the mean as 64 bits in hex."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = x.sum(0, dtype=np.int64)
    total = int(columns.sum())
    squares = int((x.astype(np.int64) ** 2).sum())
    variance = squares / x.size - (total / x.size) ** 2
    bits = int.from_bytes(np.packbits(columns * WIDTH > total).tobytes(), "big")
    return f"{total / x.size:.4f}:{max(0.0, variance) ** 0.5:.4f}:{bits:016x}"


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class Written(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int]]):
        self.archives = archives


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaSource(DataSource):
    """Options: path, archive_bytes, range_bytes. Writes (key, text); reads SCHEMA."""

    SCHEMA = "key string, payload binary, n_bytes long, media_bytes long, media_sha256 string"

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options)


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, iterator) -> Written:
        files, folder = _open(self.uri)
        files.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        archive = stream = name = None
        number = 0

        def close():
            archive.close()
            stream.close()
            done.append((name, files.get_file_info(f"{folder}/{name}").size))

        for batch in iterator:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary())
            for key, text in zip(keys, texts, strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = files.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                member = f"{number:09d}.png" if key is None else f"{number:09d}-{key}.png"
                archive.writestr(zipfile.ZipInfo(member), encode(text.as_py() or b""))
                number += 1
                if stream.tell() >= self.most:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        files, folder = _open(self.uri)
        files.create_dir(folder, recursive=True)
        listed = sorted(a for m in messages if m is not None for a in m.archives)
        with files.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        files, folder = _open(self.uri)
        for m in messages:
            for name, _ in m.archives if m is not None else []:
                files.delete_file(f"{folder}/{name}")


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        files, folder = _open(self.uri)
        with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
            listed = json.loads(f.read())
        most = max(self.most, sum(size for _, size in listed) // MOST_RANGES)
        ranges = [Range(name, at, at + most) for name, size in listed for at in range(0, size, most)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        files, folder = _open(self.uri)
        path = f"{folder}/{partition.path}"
        with files.open_input_file(path) as f:
            with zipfile.ZipFile(f) as archive:
                members = sorted(archive.infolist(), key=lambda m: m.header_offset)
            members = [m for m in members if partition.start <= m.header_offset < partition.end]
            rows, size = [], 0
            for run in _runs(members):
                first, last = run[0], run[-1]
                end = last.header_offset + 30 + 2 * len(last.filename.encode()) + 64 + last.compress_size
                block = _read(f, first.header_offset, end - first.header_offset)
                for m in run:
                    payload, n_bytes, media = self._member(files, path, m, block, m.header_offset - first.header_offset)
                    key = m.filename[10:-4] if m.filename[9] == "-" else None
                    rows.append((key, payload, n_bytes, len(media), hashlib.sha256(media).hexdigest()))
                    size += len(payload)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    @staticmethod
    def _member(files, path: str, m: zipfile.ZipInfo, block: bytes, at: int) -> tuple[bytes, int, bytes]:
        """A member out of a block that was read, or read again alone from its offset."""
        problem = None
        for attempt in range(1 + RETRIES):
            try:
                if attempt:
                    with files.open_input_file(path) as f:
                        block, at = _read(f, m.header_offset, 30 + 2 * len(m.filename.encode()) + 64 + m.compress_size), 0
                head = block[at : at + 30]
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member")
                start = at + 30 + sum(struct.unpack("<HH", head[26:30]))
                media = block[start : start + m.compress_size]
                if len(media) != m.compress_size or zlib.crc32(media) != m.CRC:
                    raise ValueError("broken member")
                return (*decode(media), media)
            except (ValueError, OSError, struct.error, zlib.error) as e:
                problem = e
        raise OSError(f"{path}, member at {m.header_offset}: {problem}")


def _read(f, start: int, size: int) -> bytes:
    f.seek(start)
    return f.read(size)


def _runs(members: list[zipfile.ZipInfo], most: int = BATCH_BYTES):
    """Neighbours of about ``most`` stored bytes in all."""
    run, size = [], 0
    for m in members:
        run.append(m)
        size += m.compress_size
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "payload": pa.binary(), "n_bytes": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes every text as a member of an archive and returns the folder."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaSource)
    path = path or shared_path(spark, "media")
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    rows.write.format("media_archive").mode("append").option("path", path).option("archive_bytes", archive_bytes).save()
    return path


def load(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, payload, n_bytes, media_bytes, media_sha256) of all members."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("path", path).option("range_bytes", range_bytes).load()


def with_features(media: DataFrame) -> DataFrame:
    """Digests and the feature of each payload, in place of the payload."""
    def run(batches):
        for batch in batches:
            payloads = [p.as_buffer() for p in batch.column("payload")]
            made = {
                "payload_bytes": pa.array([p.size for p in payloads], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(memoryview(p)[-64:]) for p in payloads], pa.int64()),
                "feature": pa.array([feature(p) for p in payloads], pa.string()),
            }
            kept = [c for c in batch.schema.names if c != "payload"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + list(made.values()), kept + list(made))

    return media.mapInArrow(run, "key string, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op4_archive_source(spark, sf_dir):
    path = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = with_features(load(spark, path))
    return found.select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
