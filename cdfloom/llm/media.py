"""Media columns: lossless 8-bit images in archives, and a data source that reads them by byte range.

`write_archives` stores payloads as grey images, one ZIP archive a task.  The
data source `media_archive` plans byte ranges over the archive files only, so
planning does not grow with the number of members; each task reads the central
directory of its archive and takes the members whose header lies in its range,
one after the other, and retries a damaged or failed member by its offset
alone.
"""

from __future__ import annotations

import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .arrow import sliced
from .common import materialize, scratch_path

WIDTH = 64  # samples a row
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---- the stored form: a grey PNG of 8-bit samples, 64 a row ----

def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(data: bytes, level: int = 1) -> bytes:
    """`data`, padded, as a PNG; the length before padding is kept in a text chunk."""
    payload = padded(data)
    height = len(payload) // WIDTH
    raw = np.zeros((height, WIDTH + 1), np.uint8)  # each row starts with filter type 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return b"".join((
        PNG_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"n_bytes\0%d" % len(data)), _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)), _chunk(b"IEND", b"")))


def decode_image(media: bytes) -> tuple[bytes, int]:
    """(payload, length before padding) of an image that encode_image wrote; checks every CRC."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, n, data, height = 8, -1, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4:at + 8], media[at + 8:at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if (width, form) != (WIDTH, [8, 0, 0, 0, 0]):
                raise ValueError("another image format")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and an average hash over an 8 by 8 grid."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    level = np.arange(256)
    mean = float(counts @ level) / len(x)
    deviation = max(0.0, float(counts @ (level * level)) / len(x) - mean * mean) ** 0.5
    by_column = x.reshape(-1, 8, 8).sum(2, dtype=np.int64)  # rows x 8 columns
    at = np.minimum(np.arange(len(by_column)) * 8 // len(by_column), 7)
    grid = np.zeros((8, 8))
    np.add.at(grid, at, by_column)
    area = np.maximum(np.bincount(at, minlength=8), 1)[:, None] * 8
    bits = (grid / area > mean).ravel()
    return f"{mean:.3f}:{deviation:.3f}:{float(-(share * np.log2(share)).sum()) + 0.0:.4f}:{np.packbits(bits).tobytes().hex()}"


# ---- archives ----

def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) or local path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's payload as an image member of a ZIP archive under `path`, one archive a task.

    Returns (archive, members, bytes), after all are written.  A null text is
    stored as the empty one.  A member's name is its number in the archive and
    its id, percent-encoded, or nothing for a null id; equal ids are separate
    members.  A task writes under a name of its own attempt and renames at the
    end, so a lost or repeated attempt leaves one whole archive.
    """
    inner = docs.select(docs[f"`{id_col}`"].cast("string").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary").alias("t"))
    jpath = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)  # there even if no task runs
    jpath.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(jpath)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        ctx = TaskContext.get()
        final = f"{folder}/part-{ctx.partitionId():06d}.zip"
        attempt = f"{folder}/_attempt-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(attempt) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as archive:
            for batch in batches:
                for part in sliced(batch, "t"):
                    for key, text in zip(part.column("id").to_pylist(), part.column("t")):
                        name = f"{n:09d}/{'' if key is None else '=' + quote(key, safe='')}.png"
                        archive.writestr(zipfile.ZipInfo(name), encode_image(text.as_py()))
                        n += 1
        size = fs.get_file_info(attempt).size
        # a task that is run again finds the archive of its first run: the same rows in the same order, so the same bytes
        if fs.get_file_info(final).type == pafs.FileType.File:
            fs.delete_file(attempt)
            size = fs.get_file_info(final).size
        else:
            fs.move(attempt, final)
        yield pa.RecordBatch.from_pydict({"archive": [final], "members": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    manifest = inner.mapInArrow(write, "archive string, members long, bytes long")
    return materialize(manifest, "media-manifest")


class ByteRange(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int) -> None:
        self.archive, self.size, self.start, self.end = archive, size, start, end


class MediaReader(DataSourceReader):
    """Options: path, splitBytes (least bytes a partition), retries (a member), batchBytes (of payload a batch)."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitBytes", 16 << 20))
        self.retries = int(options.get("retries", 3))
        self.batch = int(options.get("batchBytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        fs, folder = filesystem(self.path)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True)), key=lambda i: i.path):
            if info.is_file and info.path.endswith(".zip"):
                k = max(1, info.size // self.split)
                cuts = [info.size * i // k for i in range(k + 1)]
                out += [ByteRange(info.path, info.size, a, b) for a, b in zip(cuts, cuts[1:])]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, _ = filesystem(self.path)
        stream = fs.open_input_file(part.archive)
        try:
            with zipfile.ZipFile(_Tail(stream, part.size)) as archive:  # reads the directory at the file's end
                members = sorted((m for m in archive.infolist() if part.start <= m.header_offset < part.end), key=lambda m: m.header_offset)
            rows: list[tuple] = []
            size = 0
            for m in members:
                media, (payload, n), attempts = None, (b"", -1), 0
                while media is None:
                    attempts += 1
                    try:
                        media = self._member(stream, m)
                        payload, n = decode_image(media)
                    except (OSError, ValueError, zlib.error) as e:
                        media = None
                        if attempts > self.retries:
                            raise OSError(f"{part.archive}: member {m.filename} at offset {m.header_offset}: {e}") from e
                        time.sleep(0.05 * attempts)
                        stream.close()
                        stream = fs.open_input_file(part.archive)
                name = m.filename.partition("/")[2].removesuffix(".png")
                rows.append((unquote(name[1:]) if name else None, m.header_offset, attempts, media, n, payload, feature(payload)))
                size += len(media) + len(payload)
                if size >= self.batch:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)
        finally:
            stream.close()

    @staticmethod
    def _member(stream: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
        """A stored member's bytes, read at its offset and checked by its CRC."""
        stream.seek(m.header_offset)
        head = stream.read(30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no member here")
        name, extra = struct.unpack_from("<HH", head, 26)
        stream.seek(m.header_offset + 30 + name + extra)
        data = stream.read(m.compress_size)
        if len(data) != m.compress_size or zlib.crc32(data) != m.CRC:
            raise ValueError("damaged member")
        return data


class _Tail(io.RawIOBase):
    """The seekable file that zipfile reads the directory from."""

    def __init__(self, stream: pa.NativeFile, size: int) -> None:
        self.stream, self.size, self.at = stream, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        self.stream.seek(self.at)
        data = self.stream.read(self.size - self.at if n is None or n < 0 else n)
        self.at += len(data)
        return data


_SCHEMA = pa.schema([("id", pa.string()), ("offset", pa.int64()), ("attempts", pa.int32()), ("media", pa.binary()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("feature", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


class MediaArchiveSource(DataSource):
    """`spark.read.format("media_archive").load(path)`: members of the ZIP archives under a path."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id string, offset long, attempts int, media binary, n_bytes long, payload binary, feature string"

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """id, offset, attempts, media (stored bytes), n_bytes, payload (read back) and feature of every member."""
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(path)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored in the shared folder and read back; equal texts give equal values.

    An empty table gives an empty result.  Extra columns are not read.
    """
    path = scratch_path(docs.sparkSession, "media")
    write_archives(docs, path, id_col, text_col)
    return read_archives(docs.sparkSession, path)
