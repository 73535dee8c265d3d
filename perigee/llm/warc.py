"""WARC archives: a Spark data source that writes records and reads them with pushed-down header predicates.

Files are plain WARC/1.1, so a record's header says how far its block reaches. Bodies are compressed inside
the block (``Content-Encoding: gzip``). The reader plans a partition per committed file, parses a record's
header first, tests the predicates pushed down on record type and header columns, and seeks past blocks that
aren't wanted; only bodies of records that pass are decoded, and none with option ``payload=false``.

Of records with equal payloads of at least ``least`` bytes the one with the largest identifier is a
response and the others are revisits of it.

Defined results: a null payload counts as empty; a null identifier is below every other; records that share
the largest identifier and payload are all responses; a null URL has no target header; an empty
table makes a directory without files; a payload of any length is one record, held whole by its task alone.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from .media import _Written, open_dir
from .runtime import own, remove, settle, spread_join, work_dir

SCHEMA = "warc_type string, record_id string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to long, payload binary"
_HEADER_COLUMNS = {"warc_type", "record_id", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to"}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(chr(c) for c in range(33, 127))


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, place: str, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record; a revisit carries no payload, only its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "response":
        body = gzip.compress(payload, 6, mtime=0)
        block = http + b"Content-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    else:
        block = http + b"\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {_PROFILE.decode()}", f"X-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = open_dir(self.path)
        fs.create_dir(root, recursive=True)
        task, names, out, at = TaskContext.get(), [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or at >= self.file_bytes:
                    if out:
                        out.close()
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names)}.warc")
                    out, at = fs.open_output_stream(f"{root}/{names[-1]}"), 0
                data = record(row["record_type"], row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], row["refers_to"], row["payload"], f"{names[-1]}#{at}")
                out.write(data)
                at += len(data)
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        fs, root = open_dir(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([x for m in messages if m for x in m.archives]).encode())

    def abort(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        fs, root = open_dir(self.path)
        for name in (x for m in messages if m for x in m.archives):
            fs.delete_file(f"{root}/{name}")


@dataclass
class WarcFile(ds.InputPartition):
    name: str


def _test(f: ds.Filter):
    """A predicate on parsed headers, or None for a filter that isn't one of header columns."""
    name = getattr(f, "attribute", (None,))
    if len(name) != 1 or name[0] not in _HEADER_COLUMNS:
        return None
    key = name[0]
    match f:
        case ds.EqualTo(value=v):
            return lambda h: h[key] is not None and h[key] == v
        case ds.In(value=vs):
            return lambda h, vs=frozenset(vs): h[key] is not None and h[key] in vs
        case ds.GreaterThan(value=v):
            return lambda h: h[key] is not None and h[key] > v
        case ds.GreaterThanOrEqual(value=v):
            return lambda h: h[key] is not None and h[key] >= v
        case ds.LessThan(value=v):
            return lambda h: h[key] is not None and h[key] < v
        case ds.LessThanOrEqual(value=v):
            return lambda h: h[key] is not None and h[key] <= v
        case ds.IsNull():
            return lambda h: h[key] is None
        case ds.IsNotNull():
            return lambda h: h[key] is not None
    return None


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.want, self.batch_bytes = options["path"], options.get("payload", "true") == "true", int(options.get("batch_bytes", 4 << 20))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> Sequence[ds.InputPartition]:
        fs, root = open_dir(self.path)
        found: list[str] = []
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("_committed-"):
                with fs.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [WarcFile(x) for x in sorted(found)] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = open_dir(self.path)
        tests, rows, held = [_test(f) for f in self.filters], [], 0
        with io.BufferedReader(fs.open_input_file(f"{root}/{partition.name}"), 1 << 20) as file:
            while line := file.readline():
                if line.rstrip(b"\r\n") != b"WARC/1.1":
                    raise ValueError(f"no record at {file.tell() - len(line)} of {partition.name}")
                fields = {}
                while (line := file.readline()) not in (b"\r\n", b""):
                    key, _, value = line.partition(b":")
                    fields[key.lower()] = value.strip().decode()
                number = lambda k: int(fields[k]) if k in fields else None
                size = int(fields[b"content-length"])
                head = {
                    "warc_type": fields.get(b"warc-type"),
                    "record_id": fields.get(b"warc-record-id"),
                    "target_uri": fields.get(b"warc-target-uri"),
                    "page_id": number(b"x-page-id"),
                    "payload_digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None,
                    "payload_bytes": number(b"x-payload-length"),
                    "refers_to": number(b"x-refers-to-page-id"),
                }
                if not all(t(head) for t in tests) or not self.want or head["warc_type"] != "response":
                    file.seek(size + 4, io.SEEK_CUR)
                    payload = None
                else:
                    block = file.read(size)
                    payload = self.body(block)
                    file.seek(4, io.SEEK_CUR)
                if all(t(head) for t in tests):
                    rows.append((*head.values(), payload))
                    held += 500 + len(payload or b"")
                if held >= self.batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def body(block: bytes) -> bytes:
        head, _, body = block.partition(b"\r\n\r\n")
        return zlib.decompress(body, 31) if b"content-encoding: gzip" in head.lower() else body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["warc_type", "record_id", "target_uri", "page_id", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


class Warc(ds.DataSource):
    """``spark.read.format("warc").load(directory)``, with filters on header columns pushed down."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        return WarcWriter(self.options)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, **options: int) -> None:
    """A record per row of ``pages`` below ``path``; payloads aren't gathered by digest, only their identifiers are."""
    _register(pages.sparkSession)
    payload = F.encode(own(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keyed = rows.withColumn("same", F.when(F.col("payload_bytes") >= least, F.sha2("payload", 256)))
    # Only digests that occur more than once meet the pages; few of them are broadcast and payloads stay where they are.
    shared = settle(keyed.filter("same IS NOT NULL").groupBy("same").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    told = spread_join(keyed, shared.drop("n"), "same", ["page_id", "url"], sizes=shared.select("same", "n"))
    revisit = F.coalesce(F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("page_id")), F.lit(False))
    told.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        F.sha1("payload").alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
    ).write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records below ``path``; filter on header columns before using ``payload`` and those are skipped unread."""
    _register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, read them back and describe each record.

    Responses and revisits are read apart, each by its pushed-down record type: digests of responses are of the
    payloads that were read, those of revisits, which have none, come from their headers.
    """
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_warc(pages, path)
    out = settle(described_records(spark, path))
    remove(spark, path)
    return out


def described_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of all records below ``path``."""
    responses = read_warc(spark, path).where("warc_type = 'response'").withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    revisits = read_warc(spark, path, payload=False).where("warc_type = 'revisit'")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "target_uri"]
    return responses.select(*columns).unionByName(revisits.select(*columns))
