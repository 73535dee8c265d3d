"""Media columns: payloads as 8-bit greyscale PNG images in ZIP archives, written and read by a Spark data source.

The writer streams Arrow batches into archives of bounded size (members stored, so a member's media
bytes lie there as they are) with a side file of member offsets, one about every ``range_bytes``. The
reader plans one partition for each such byte range of each committed archive, reads members in order and yields
Arrow batches of bounded bytes. A member that can't be read or whose checksum fails is read again by its
offset through a newly opened file; only after ``retries`` failures does the task fail.

Only archives named in a commit file are read, so what lost or repeated tasks leave behind doesn't count.

Defined results: a null payload counts as empty; an empty payload is padded to 64 zero bytes; null
identifiers and repeated rows are kept as they are; a very long payload is one member, held whole by its task alone; an
empty table makes an archive directory without archives; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .runtime import own, remove, settle, small_batches, work_dir

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
SCHEMA = "archive string, offset long, doc_id long, n_bytes long, media binary, payload binary, feature string"


class MemberError(ValueError):
    """A member's bytes aren't what its header says."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(text: bytes) -> bytes:
    """``text``, padded with zero bytes to a positive multiple of 64, as the samples of an image 64 wide."""
    rows = max(1, -(-len(text) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), np.uint8)  # the first of each row says: not filtered
    samples[:, 1:] = np.frombuffer(text.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[int, bytes]:
    """Unpadded length and samples of what :func:`encode_png` made; every chunk's checksum is verified."""
    if media[:8] != _SIGNATURE:
        raise MemberError("not a PNG file")
    at, found = 8, {}
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise MemberError(f"checksum of {kind!r}")
        found[kind] = found.get(kind, b"") + data
        at += 12 + size
    width, rows = struct.unpack_from(">II", found[b"IHDR"])
    samples = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    return int(found[b"tEXt"].partition(b"\0")[2]), samples[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash of eight by eight tiles."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / samples.size
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
    some = share[share > 0]
    image = samples.reshape(-1, WIDTH)
    edges = np.linspace(0, image.shape[0], 9).astype(int)
    columns = image.reshape(image.shape[0], 8, 8).sum(axis=2, dtype=np.int64)
    total = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    tiles = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(1, 8 * np.diff(edges))[:, None]
    bits = np.packbits(tiles > mean).tobytes().hex()
    return f"{mean:.4f}:{deviation:.4f}:{-float(some @ np.log2(some)):.4f}:{bits}"


def open_dir(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    archives: list[str]


class _Archive:
    """One ZIP archive being written, with the offsets of the members that begin its byte ranges."""

    def __init__(self, fs: pafs.FileSystem, path: str, range_bytes: int):
        self.fs, self.path, self.range_bytes = fs, path, range_bytes
        self.out, self.at, self.central, self.members, self.starts = fs.open_output_stream(path), 0, [], 0, [0]

    def add(self, name: bytes, media: bytes) -> None:
        if self.at - self.starts[-1] >= self.range_bytes:
            self.starts.append(self.at)
        crc, n = zlib.crc32(media), len(media)
        self.central.append(struct.pack(_CENTRAL, b"PK\1\2", 20, 20, 0, 0, 0, 33, crc, n, n, len(name), 0, 0, 0, 0, 0, self.at) + name)
        self.out.write(struct.pack(_LOCAL, b"PK\3\4", 20, 0, 0, 0, 33, crc, n, n, len(name), 0) + name)
        self.out.write(media)
        self.at += 30 + len(name) + n
        self.members += 1

    def close(self) -> None:
        directory = b"".join(self.central)
        self.out.write(directory + struct.pack(_END, b"PK\5\6", 0, 0, self.members, self.members, len(directory), self.at, 0))
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.ranges") as side:
            side.write(json.dumps({"starts": self.starts, "end": self.at}).encode())


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.archive_bytes = int(options.get("range_bytes", 16 << 20)), int(options.get("archive_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = open_dir(self.path)
        fs.create_dir(root, recursive=True)
        task, names, archive = TaskContext.get(), [], None
        for batch in iterator:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for key, text in zip(ids, texts):
                if archive is None or archive.at >= self.archive_bytes or archive.members >= 65_000:
                    if archive:
                        archive.close()
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names)}.zip")
                    archive = _Archive(fs, f"{root}/{names[-1]}", self.range_bytes)
                archive.add(f"{key.as_py()}.png".encode(), encode_png(text.as_py() or b""))
        if archive:
            archive.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_dir(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([x for m in messages if m for x in m.archives]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_dir(self.path)
        for name in (x for m in messages if m for x in m.archives):
            for path in (f"{root}/{name}", f"{root}/{name}.ranges"):
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.retries, self.batch_bytes = options["path"], int(options.get("retries", 3)), int(options.get("batch_bytes", 1 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = open_dir(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("_committed-"):
                with fs.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        out: list[InputPartition] = []
        for name in sorted(found):
            with fs.open_input_stream(f"{root}/{name}.ranges") as f:
                side = json.loads(f.read())
            bounds = [*side["starts"], side["end"]]
            out += [ByteRange(name, a, b) for a, b in zip(bounds, bounds[1:]) if a < b]
        return out or [ByteRange("", 0, 0)]

    def open(self, name: str):
        fs, root = open_dir(self.path)
        return fs.open_input_file(f"{root}/{name}")

    @staticmethod
    def member(file, at: int) -> tuple[bytes, bytes, int]:
        """Name and media of the member at an offset, and the next one's offset."""
        file.seek(at)
        head = file.read(30)
        if len(head) < 30 or head[:4] != b"PK\3\4":
            raise MemberError(f"no member at {at}")
        *_, crc, n, _, name_n, extra_n = struct.unpack(_LOCAL, head)
        body = file.read(name_n + extra_n + n)
        name, media = body[:name_n], body[name_n + extra_n :]
        if len(media) != n or zlib.crc32(media) != crc:
            raise MemberError(f"member at {at} is damaged")
        return name, media, at + 30 + len(body)

    def retried(self, file, name: str, at: int):
        """A member with its decoded content; a failure opens the file anew and reads this member alone."""
        for attempt in range(self.retries + 1):
            try:
                key, media, after = self.member(file, at)
                return file, key, media, decode_png(media), after
            except (OSError, ValueError, zlib.error, struct.error):
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)
                file.close()
                file = self.open(name)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        file, at, rows, held = self.open(partition.archive), partition.start, [], 0
        while at < partition.end:
            file, key, media, (n, payload), after = self.retried(file, partition.archive, at)
            name = key.decode().removesuffix(".png")
            rows.append((partition.archive, at, None if name == "None" else int(name), n, media, payload, feature(payload)))
            held, at = held + len(media) + len(payload), after
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        file.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    names = ["archive", "offset", "doc_id", "n_bytes", "media", "payload", "feature"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(directory)``; writing takes columns doc_id and text."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MediaWriter(self.options)


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options: int) -> None:
    """Store every row's whole text as a member of the archives below ``path``."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), own(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        rows.write.format("media_archive").mode("append").options(**options).save(path)


def read_media(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """archive, offset, doc_id, n_bytes, media, payload, feature of all members below ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store all texts, read them back and describe what was read; the archives are removed at the end."""
    spark = docs.sparkSession
    path = work_dir(spark, "media")
    write_media(docs, path)
    read = read_media(spark, path)
    out = settle(
        read.select(
            "doc_id",
            "n_bytes",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_sha256"),
            F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
            F.octet_length("media").cast("long").alias("media_bytes"),
            F.sha2("media", 256).alias("media_sha256"),
            "feature",
        )
    )
    remove(spark, path)
    return out
