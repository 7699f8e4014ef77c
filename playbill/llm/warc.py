"""WARC archives as a Spark data source, for reading and writing.

Reading: archives become partitions by size, the driver lists them and opens none. A
task walks the records of its archives, parses a record's headers first, and tests
the pushed predicates on record type and headers there. Only a record that passes has
its payload taken out; in an uncompressed archive the others are skipped by a
seek, in a compressed one (a gzip member each) they are inflated and thrown away.

Writing: every task writes archives of its own, at most ``max_bytes`` long but for
one record. A commit adds a manifest that names the archives of the successful
tasks; readers believe manifests only, so tasks that died or ran twice leave nothing.

Paths are opened with pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)


SCHEMA = ("archive string, record_type string, record_id string, target_uri string, refers_to string, "
          "content_type string, payload_digest string, payload_bytes bigint, payload binary")
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
HTTP = "application/http;msgtype=response"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "content_type": "content-type", "payload_digest": "warc-payload-digest",
}
BLOCK = 1 << 16


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _hex(digest: str | None) -> str | None:
    """A ``sha1:BASE32`` digest as bare hex; other forms as they are."""
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        return base64.b32decode(digest[5:]).hex()
    return digest


def _clean(value: str) -> str:
    """Header values are one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict[str, Any]) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP headers, length included, and no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"],
        "WARC-Profile": IDENTICAL if revisit else None, "Content-Type": HTTP,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode(),
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items() if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Plain:
    """A byte source with look-ahead over an open archive."""

    def __init__(self, handle: Any) -> None:
        self.handle, self.buffer = handle, b""

    def more(self) -> bool:
        data = self.handle.read(BLOCK)
        self.buffer += data
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; null at the end of the archive."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record")
                return None
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.buffer[:n]], min(n, len(self.buffer))
        self.buffer = self.buffer[n:]
        while got < n and self.more():
            parts.append(self.buffer[: n - got])
            self.buffer, got = self.buffer[n - got :], got + len(parts[-1])
        if got < n:
            raise ValueError("archive ends inside a record")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        ahead = n - len(self.buffer)
        self.buffer = self.buffer[n:]
        if ahead > 0:
            self.handle.seek(ahead, 1)


class Gzipped(Plain):
    """Inflates member after member; skipped bytes are dropped block by block."""

    def __init__(self, handle: Any) -> None:
        super().__init__(handle)
        self.inflate, self.raw, self.begun = zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.handle.read(BLOCK)
                if not self.raw:
                    if self.begun and not self.inflate.eof:
                        raise ValueError("archive ends inside a record")
                    return False
                self.begun = True
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(self.raw, BLOCK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                self.buffer += data
                return True

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.buffer and not self.more():
                raise ValueError("archive ends inside a record")
            step = min(n, len(self.buffer))
            self.buffer, n = self.buffer[step:], n - step


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, found, value = line.partition(":")
        if found:
            out[name.strip().lower()] = value.strip()
    return out


def walk(source: Plain, passes: Callable[[dict[str, str | None]], bool], payloads: bool) -> Iterator[dict[str, Any]]:
    """The records that pass, their payloads only if wanted."""
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        found = headers_of(head)
        length = int(found["content-length"])
        row: dict[str, Any] = {column: found.get(name) for column, name in HEADER_OF.items()}
        row["payload_digest"] = _hex(row["payload_digest"])
        if not passes(row):
            source.skip(length)
        else:
            row |= {"payload": None, "payload_bytes": length}
            if (row["content_type"] or "").replace(" ", "").startswith("application/http"):
                http = source.until(b"\r\n\r\n")
                if http is None or len(http) > length:
                    raise ValueError("a record's HTTP headers do not end inside it")
                length -= len(http)
                row["payload_bytes"] = int(headers_of(http).get("content-length", length))
            if payloads and row["record_type"] != "revisit":
                row["payload"] = source.take(length)
            else:
                source.skip(length)
            yield row
        source.take(4)


@dataclass
class Archives(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes predicates on record type and headers; hands the others back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ("",))
            kind = {EqualTo: "eq", In: "in", IsNotNull: "some", IsNull: "none", StringStartsWith: "starts"}.get(type(f))
            if kind and len(column) == 1 and column[0] in HEADER_OF:
                self.tests.append((column[0], kind, list(f.value) if kind == "in" else getattr(f, "value", None)))
            else:
                yield f

    def passes(self, row: dict[str, str | None]) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            if kind == "none":
                ok = have is None
            elif have is None:
                ok = False
            else:
                ok = kind == "some" or kind == "eq" and have == value or kind == "in" and have in value or kind == "starts" and have.startswith(value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Archives side by side up to ``partition_bytes``; one archive is never split, its writer bounds it."""
        system, base = open_path(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.File:
            files = [(base, info.size)]
        else:
            listed = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
            manifests = [i.path for i in listed if i.base_name.startswith("_manifest-")]
            files = []
            for m in sorted(manifests):
                with system.open_input_stream(m) as handle:
                    files += [(f"{base}/{name}", size) for name, size, _ in json.loads(handle.read())]
            if not manifests:
                files = sorted((i.path, i.size) for i in listed if re.search(r"\.warc(\.gz)?$", i.path))
        bins: list[InputPartition] = []
        held, size = [], 0
        for path, n in files:
            if held and size + n > self.partition_bytes:
                bins.append(Archives(held))
                held, size = [], 0
            held, size = [*held, path], size + n
        return [*bins, Archives(held)] if held or not bins else bins

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system = open_path(self.path)[0]
        schema = pa.schema([
            ("archive", pa.string()), *[(c, pa.string()) for c in HEADER_OF if c != "payload_digest"],
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as handle:
                source = Gzipped(handle) if path.endswith(".gz") else Plain(handle)
                for row in walk(source, self.passes, self.payloads):
                    rows.append(row | {"archive": path.rsplit("/", 1)[-1]})
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if overwrite:
            raise ValueError("archives are only appended to: use mode append")
        self.path, self.level = options["path"], int(options.get("level", 3))
        self.max_bytes = int(options.get("max_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = open_path(self.path)
        system.create_dir(base, recursive=True)
        files: list[tuple[str, int, int]] = []
        handle, name, size, count = None, "", 0, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if handle is None or size >= self.max_bytes:
                    if handle is not None:
                        handle.close()
                        files.append((name, size, count))
                    name, size, count = f"{uuid.uuid4().hex}.warc{'.gz' if self.level else ''}", 0, 0
                    handle = system.open_output_stream(f"{base}/{name}", compression=None)
                data = record(row)
                if self.level:
                    member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    data = member.compress(data) + member.flush()
                handle.write(data)
                size, count = size + len(data), count + 1
        if handle is not None:
            handle.close()
            files.append((name, size, count))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = open_path(self.path)
        system.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as handle:
            handle.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = open_path(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                system.delete_file(f"{base}/{name}")


class WarcSource(DataSource):
    """Options: ``path``; reading ``partition_bytes`` and ``payloads``; writing ``level`` (0: not compressed) and ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to the session, with predicates pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html), as the writer takes them.

    The payload is html in UTF-8; null is an empty payload. Of payloads of at least
    ``min_bytes`` that are equal, the one with the largest page_id is a response and the
    others revisit it; shorter ones are all responses. Rows that repeat the largest page_id
    with that payload are responses too. A null page_id is the smallest. Equality is
    judged by SHA-1 and length. Payloads travel to the join by digest; the other
    side has one row a digest that occurs twice, and short payloads have keys of their own,
    so the only hot keys are large groups of copies, which the join splits.
    """
    base = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    row = base.select(
        *base.columns, F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    first = row.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.concat_ws("/", "payload_digest", "payload_bytes").alias("key"), "kept")
    keyed = row.withColumn("key", F.when(
        F.col("payload_bytes") >= min_bytes, F.concat_ws("/", "payload_digest", "payload_bytes")).otherwise(
        F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.xxhash64("target_uri").cast("string"))))
    joined = keyed.join(first, "key", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_id(F.col("page_id")).alias("record_id"),
        "target_uri", F.when(revisit, record_id(F.col("kept"))).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(identifier: Column) -> Column:
    return F.regexp_extract(identifier, "^<urn:page:(.*)>$", 1).try_cast("bigint")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, **options: Any) -> None:
    """Writes ``page_records`` to archives below ``path``; other columns of ``pages`` are ignored."""
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").options(**options).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The records of an archive or of a folder of them; filter the result to push predicates down."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
