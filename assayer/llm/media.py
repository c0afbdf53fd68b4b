"""Media columns: payloads stored as images in archives, read back by a data source over byte ranges.

``store`` writes each row's payload as an 8-bit greyscale PNG into ZIP archives of a bounded size in a
shared folder. ``MediaArchives`` is a Spark data source: the driver lists the archives and cuts each into
byte ranges; a task reads the archive's own directory, takes the members whose header starts in its range
and streams them as Arrow batches. A member that can't be read is tried again by its own offset, alone, and
after the last try it comes as a row with ``error`` set, so that one bad member loses no other.

A null text is an empty payload. Repeated rows are separate members. Other columns are ignored. Texts are stored whole; a worker
holds a batch of 1 MB or one longer text, some six times over.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assayer.llm.batches import bounded
from assayer.llm.places import shared_folder

WIDTH = 576
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with bytes 255 to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image, WIDTH samples a row, every row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; raises ValueError for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, size = 8, [], (0, 0)
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            *size, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale is stored here")
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != (size[0] + 1) * size[1] or lines[:: size[0] + 1].any():
        raise ValueError("filtered or short image")
    return lines.reshape(size[1], size[0] + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy and a 16-bin histogram of the samples, in per mille, as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = int((counts * values).sum()) / int(n)
    spread = (int((counts * values * values).sum()) / int(n) - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    bins = counts.reshape(16, 16).sum(axis=1) * 1000 // n
    return f"{mean:.3f};{spread:.3f};{float(-(share * np.log2(share)).sum()):.3f};" + ",".join(map(str, bins.tolist()))


def store(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write archives below ``folder``; gives (path, members, bytes), a row for each archive.

    Names are unique to a task attempt, so only archives that the returned rows name count: write the rows
    down before use, and leftovers of lost attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sink = archive = None
        path, members, total = "", 0, 0

        def close() -> pa.RecordBatch:
            archive.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": path, "members": members, "bytes": total}])

        for b in bounded(batches, text):
            for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist()):
                if archive is None:
                    path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}")
                    archive, members, total = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, strict_timestamps=False), 0, 0
                image = to_png(payload_of(t))
                info = zipfile.ZipInfo(f"{members:09d}.png")
                info.comment = f"{'' if k is None else k};{len((t or '').encode())}".encode()
                archive.writestr(info, image)
                members, total = members + 1, total + len(image)
                if total >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return df.select(key, text).mapInArrow(run, "path string, members long, bytes long")


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{base}/MANIFEST") as f:
            names = f.read().decode().split()
        files = sorted(fs.get_file_info([f"{base}/{n}" for n in names]), key=lambda x: x.path)
        if missing := [x.path for x in files if x.type != pafs.FileType.File]:
            raise FileNotFoundError(missing[0])
        return [Range(x.path, s, s + self.step) for x in files for s in range(0, x.size, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(partition.path) as f:
            with zipfile.ZipFile(f) as archive:
                members = [(x.header_offset, x.comment, x.file_size, x.CRC) for x in archive.infolist() if partition.start <= x.header_offset < partition.stop]
            rows, size = [], 0
            for offset, comment, length, crc in sorted(members):
                key, _, n = comment.decode().rpartition(";")
                data, error = self.member(f, fs, partition.path, offset, length, crc)
                rows.append({"key": key or None, "n_bytes": int(n), "offset": offset, "media": data, "error": error})
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    @staticmethod
    def member(f, fs, path: str, offset: int, length: int, crc: int) -> tuple[bytes | None, str | None]:
        """A member's bytes by its offset; each retry opens the archive anew and reads this member alone."""
        error = ""
        for k in range(TRIES):
            try:
                with contextlib.nullcontext(f) if k == 0 else fs.open_input_file(path) as own:
                    head = own.read_at(30, offset)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member starts here")
                    name, extra = struct.unpack("<HH", head[26:30])
                    data = own.read_at(length, offset + 30 + name + extra)
                    if len(data) != length or zlib.crc32(data) != crc:
                        raise ValueError("damaged member")
                    return data, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error


ARROW = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: a row for each member of the archives in MANIFEST."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "key string, n_bytes long, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def save(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Store all rows and write MANIFEST, which names the archives of the attempts that counted."""
    spark = df.sparkSession
    written = store(df, folder, key, text)
    written.write.mode("overwrite").parquet(f"{folder}/written")
    # A name for each 64 MB of media; a task's archives are the only thing that comes to the driver.
    names = [r.path.rpartition("/")[2] for r in spark.read.parquet(f"{folder}/written").select("path").toLocalIterator()]
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/MANIFEST") as f:
        f.write("\n".join(sorted(names)).encode())


def load(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


def digests(media: DataFrame) -> DataFrame:
    """Features of stored members: (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    Fails on a member that stayed unreadable, as its row would be lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["error"]:
                    raise OSError(f"member at {r['offset']}: {r['error']}")
                p = from_png(r["media"])
                rows.append({"key": r["key"], "n_bytes": r["n_bytes"], "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-32:]), "media_bytes": len(r["media"]), "media_sha256": hashlib.sha256(r["media"]).hexdigest(), "feature": feature_of(p)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, OUT)

    return media.mapInArrow(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


OUT = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op8_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_folder(spark, "media")
    save(docs, folder)
    found = digests(load(spark, folder))
    return found.select(F.col("key").cast("long").alias("doc_id"), *found.columns[1:])
