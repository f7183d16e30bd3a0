"""WARC files through a PySpark Python data source (format ``warc``).

Writing: one record per row, gzip member by member, one file per task. Rows whose payload another row
also has become ``revisit`` records without payload; the row with the largest id of such a group is
the ``response``. Every record says the digest and length of its full payload.

Reading: the driver lists the files and groups small ones into partitions; record-type, id, URI and
digest predicates are pushed into the reader, which parses a record's headers first and neither
copies nor decodes the payload of a record that a predicate rejects, or any payload with the option ``payload=false``.

Edge cases: a null payload is the empty payload; empty payloads are payloads like others, so of
several the largest id is the response; null ids are written as ``none``, read back as null, and are
response records; rows that agree in id and payload with the group's response are responses too; null URLs are empty;
an empty table gives no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from . import common

WRITE_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_sha1 string, record_type string, refers_to long"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Bytes of files that share a partition.
TOGETHER = 64 << 20
_PUSHED = {"record_type", "url", "page_id", "payload_digest", "refers_to"}


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that pyarrow knows (local, HDFS, S3, GCS); a path without a scheme is local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _urn(kind: str, at: int | None) -> str:
    return f"<urn:{kind}:{'none' if at is None else at}>"


def _number(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, n: int, sha1: str, kind: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn('page', page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
        *([f"WARC-Refers-To: {_urn('page', refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file under a temporary name; the driver's commit renames the finished ones."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        system, root = _system(self.path)
        out = None
        for b in iterator:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    system.create_dir(f"{root}/_temporary", recursive=True)
                    out = system.open_output_stream(f"{root}/_temporary/{name}", compression=None)
                page_id, url, payload, n, sha1, kind, refers_to = row
                out.write(gzip.compress(record(page_id, url, payload or b"", n, sha1, kind, refers_to), compresslevel=2, mtime=0))
        if out is None:
            return Written(None, None)
        out.close()
        return Written(f"{root}/_temporary/{name}", f"{root}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.is_file:
                    system.delete_file(f.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.final:
                system.move(m.temporary, m.final)
        self._tidy(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(*_system(self.path))

    @staticmethod
    def _tidy(system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class _Member:
    """Bytes of concatenated gzip members, inflated only as far as they are asked for."""

    def __init__(self, file: io.RawIOBase):
        self.file, self.rest, self.engine, self.out = file, b"", None, b""

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.file.read(1 << 18)
                if not self.rest:
                    return False
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            data = self.engine.decompress(self.rest)
            self.rest = self.engine.unused_data if self.engine.eof else b""
            if self.engine.eof:
                self.engine = None
            if data:
                self.out += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.out.find(mark)) < 0:
            if not self._more():
                return None
        head, self.out = self.out[:at], self.out[at + len(mark) :]
        return head

    def take(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes; they are let go chunk by chunk unless ``keep``."""
        got: list[bytes] = []
        while n:
            if not self.out and not self._more():
                raise EOFError("a record ends early")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            if keep:
                got.append(part)
        return b"".join(got)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.together = int(options.get("partitionBytes", TOGETHER))
        self.filters: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.filters.append((f.attribute[0], list(f.value) if isinstance(f, In) else [f.value]))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = _system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and ".warc" in f.base_name]
        out: list[Files] = []
        held = self.together
        for f in sorted(files, key=lambda f: f.path):
            if held + f.size > self.together:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows: list[tuple] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as file:
                member = _Member(file)
                while (head := member.until(b"\r\n\r\n")) is not None:
                    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
                    row = {
                        "page_id": _number(fields.get("WARC-Record-ID")),
                        "url": fields.get("WARC-Target-URI", ""),
                        "record_type": fields.get("WARC-Type", ""),
                        "refers_to": _number(fields.get("WARC-Refers-To")),
                        "payload_bytes": int(fields.get("X-Payload-Length", 0)),
                        "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                    }
                    wanted = all(row[k] in v for k, v in self.filters)
                    payload = wanted and self.payload and row["record_type"] == "response"
                    block = member.take(int(fields["Content-Length"]), payload)
                    member.take(4, False)
                    if wanted:
                        rows.append((*row.values(), block.partition(b"\r\n\r\n")[2] if payload else None))
                        size += len(block)
                        if len(rows) >= 1000 or size > 16 << 20:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: Tasks that the pages of one payload are dealt to.
SALTS = 64


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as rows of WRITE_SCHEMA.

    Which records are revisits is found from ids and digests alone: a repeated payload's largest id is sent
    ``SALTS`` times, to as many tasks as its other ids are dealt to. Payloads are dealt once, by
    page_id, so a payload that a third of all pages share meets in no single task.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_sha1", F.sha1("payload"))
    ids = p.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes)).groupBy("page_id", "payload_sha1").agg(F.count("*").alias("_n"))
    first = ids.groupBy("payload_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select("payload_sha1", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = ids.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(first, ["payload_sha1", "_salt"]).where("page_id < _first").select(F.col("page_id").alias("_id"), F.col("payload_sha1").alias("_sha1"), "_first")
    out = p.join(again, (F.col("page_id") == F.col("_id")) & (F.col("payload_sha1") == F.col("_sha1")), "left")
    return out.select("page_id", "url", F.when(F.col("_first").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_sha1", F.when(F.col("_first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("_first").alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    marked(pages, least_bytes).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to WARC files and reads them back; a response's digest and length are taken from its payload anew."""
    path = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest = [], []
            for kind, size, said, payload in zip(*(c.to_pylist() for c in b.columns[1:5]), strict=True):
                if kind == "response":
                    size, said = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                n.append(size)
                digest.append(said)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), b.column(1), b.column(5)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = read(spark, path).select("page_id", "record_type", "payload_bytes", "payload_digest", "payload", "refers_to")
    return rows.mapInArrow(common.lean(check), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
