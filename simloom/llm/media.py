"""Media columns: texts as 8-bit PNG images in ZIP archives, and back.

A custom Spark data source writes each row's payload as a PNG (64 RGB pixels a
row, 192 bytes, lossless, one byte a sample) into stored ZIP members. Its reader
plans byte ranges over the archives: a task reads an archive's directory, takes
the members whose offset lies in its range and streams them as Arrow batches of
bounded size. A member that fails its checksum is read again by its own offset,
alone, a few times, before the task gives up (or, with ``on_error=keep``, gives
the row an error and a null payload).

Each write is committed by a manifest of its own, so files of failed or repeated
attempts are never read and a second write adds to the first (or, with mode
``overwrite``, takes its place). Archive directories are read with the same
retries as members.

Results for odd input: a null text is empty and makes one row of 192 blanks; a
null id comes back null; equal texts make equal bytes; an empty table makes a
manifest without archives and reads as no rows; a folder without a manifest is an
error; a very long text is one member, held whole by one task. Extra columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from simloom.llm.shared import fresh_path, open_fs, text_buffer

PIXELS, ROW = 64, 192
PAD = 32
SIGNATURE = b"\x89PNG\r\n\x1a\n"
BATCH_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
MANIFEST = re.compile(r"manifest-[0-9a-f]{32}[.]json")

# --- the PNG codec -------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """Pads with blanks to whole rows; the length before is kept in a text chunk."""
    rows = max(1, -(-len(payload) // ROW))
    scan = np.full((rows, ROW + 1), PAD, np.uint8)
    scan[:, 0] = 0  # filter type: none
    flat = np.frombuffer(payload, np.uint8)
    whole = len(flat) // ROW
    scan[:whole, 1:] = flat[: whole * ROW].reshape(whole, ROW)
    if rest := len(flat) - whole * ROW:
        scan[whole, 1 : 1 + rest] = flat[whole * ROW :]
    return b"".join(
        (
            SIGNATURE,
            _chunk(b"IHDR", struct.pack(">IIBBBBB", PIXELS, rows, 8, 2, 0, 0, 0)),
            _chunk(b"tEXt", b"n_bytes\0%d" % len(payload)),
            _chunk(b"IDAT", zlib.compress(scan, 1)),
            _chunk(b"IEND", b""),
        )
    )


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """The padded samples and the length before padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, n_bytes, shape = 8, [], None, None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[0] != PIXELS or shape[2:] != (8, 2, 0, 0, 0) or n_bytes is None:
        raise ValueError("not a PNG of this writer")
    scan = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], ROW + 1)
    if scan[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return scan[:, 1:].reshape(-1), n_bytes


# --- the data source ------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]  # name, bytes, members


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.archive_bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out = archive = None
        name, members = "", 0

        def close() -> None:
            archive.close()
            size = out.tell()
            out.close()
            done.append((name, size, members))

        for batch in iterator:
            data, offsets = text_buffer(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                if archive is None:
                    name, members = f"media-{uuid.uuid4().hex}.zip", 0
                    out = system.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{members:08d}.png")
                member.comment = b"" if key is None else str(key).encode()
                archive.writestr(member, encode_png(data[offsets[i] : offsets[i + 1]].tobytes()))
                members += 1
                if out.tell() >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        before = manifests(system, root) if self.overwrite else []
        manifest = [a for m in messages if m is not None for a in m.archives]
        with system.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(manifest).encode())
        for path in before:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        """Leaves no manifest: what was written stays unread."""


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    stop: int


def manifests(system, root: str) -> list[str]:
    """The manifests of a folder, in order of their names."""
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(f.path for f in found if MANIFEST.fullmatch(f.base_name))


def retried(read: Callable[[], bytes | list], what: str, retries: int, wait_s: float):
    """What ``read`` gives, called anew after each failure."""
    for attempt in range(retries + 1):
        try:
            return read()
        except (OSError, zipfile.BadZipFile) as e:
            error = e
            if attempt < retries:
                time.sleep(wait_s * 2**attempt)
    raise OSError(f"{what}: {error}")


def archive_members(system, path: str, retries: int = 0, wait_s: float = 0.0) -> list[zipfile.ZipInfo]:
    def read() -> list[zipfile.ZipInfo]:
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            return z.infolist()

    return retried(read, path, retries, wait_s)


def read_member(system, path: str, member: zipfile.ZipInfo, retries: int, wait_s: float) -> bytes:
    """One member by its offset."""

    def read() -> bytes:
        with system.open_input_file(path) as f:
            f.seek(member.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no member begins here")
            name_size, extra_size = struct.unpack_from("<HH", head, 26)
            f.seek(member.header_offset + 30 + name_size + extra_size)
            body = f.read(member.compress_size)
        if len(body) != member.compress_size or zlib.crc32(body) != member.CRC:
            raise OSError("checksum mismatch")
        return body

    return retried(read, f"{path} at {member.header_offset}", retries, wait_s)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))
        self.wait_s = float(options.get("wait_s", 0.2))
        self.keep_errors = options.get("on_error", "fail") == "keep"

    def partitions(self) -> list[ByteRange]:
        system, root = open_fs(self.path)
        found = manifests(system, root)
        if not found:
            raise FileNotFoundError(f"no manifest in {self.path}")
        manifest = []
        for path in found:
            with system.open_input_stream(path) as f:
                manifest += json.loads(f.read())
        ranges = [
            ByteRange(name, at, min(size, at + self.range_bytes))
            for name, size, _ in manifest
            for at in range(0, size, self.range_bytes)
        ]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        system, root = open_fs(self.path)
        path = f"{root}/{part.name}"
        rows: list[tuple[int | None, bytes | None, str | None]] = []
        held = 0
        for m in archive_members(system, path, self.retries, self.wait_s):
            if not part.start <= m.header_offset < part.stop:
                continue
            body, error = None, None
            try:
                body = read_member(system, path, m, self.retries, self.wait_s)
            except OSError as e:
                if not self.keep_errors:
                    raise
                error = str(e)
            rows.append((int(m.comment) if m.comment else None, body, error))
            held += len(body or b"")
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        ids, media, errors = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "media", "error"]
        )


class MediaArchive(DataSource):
    """Format ``simloom_media``: option ``path``, a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "simloom_media"

    def schema(self) -> str:
        return "doc_id long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


# --- the operator ----------------------------------------------------------------


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append", **options: str) -> None:
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.write.format("simloom_media").mode(mode).options(path=path, **options).save()


def read_media(spark, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("simloom_media").options(path=path, **options).load()


def feature(samples: np.ndarray) -> str:
    """Rows, mean sample in thousandths, and which of 64 equal runs lie above the mean."""
    sums = samples.reshape(64, -1).sum(1, dtype=np.int64)
    total = int(sums.sum())
    bits = int.from_bytes(np.packbits(sums * 64 > total).tobytes())
    return f"{len(samples) // ROW}:{total * 1000 // len(samples)}:{bits:016x}"


FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_features(media: DataFrame) -> DataFrame:
    """Decodes the stored bytes and describes payload and stored form."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in FEATURE_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not body.is_valid:
                    rows.append((key, *[None] * 7))
                    continue
                raw = body.as_py()
                samples, n_bytes = decode_png(raw)
                rows.append(
                    (
                        key,
                        n_bytes,
                        len(samples),
                        hashlib.sha256(samples).hexdigest(),
                        zlib.crc32(samples[-16:]),
                        len(raw),
                        hashlib.sha256(raw).hexdigest(),
                        feature(samples),
                    )
                )
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return media.select("doc_id", "media").mapInArrow(describe, FEATURE_SCHEMA)


def media_round_trip(docs: DataFrame, **columns: str) -> DataFrame:
    """Stores every text as media in the shared folder, reads it back, describes it."""
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    write_media(docs, path, **columns)
    return media_features(read_media(spark, path))
