"""WARC archives as a Spark data source: format "warc", for reading and writing.

Reading plans partitions from the files, takes equality, membership and
prefix predicates on header columns, parses each record's header first and
seeks past (or inflates without keeping) the payloads that are not wanted.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from stridelake.llm.common import Scratch, join_checked

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
# Field names of the WARC 1.1 format; the last is an extension field.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
ARROW = pa.schema([(n, pa.string()) for n in list(FIELDS)[:5]] + [("payload_length", pa.int64()), ("payload", pa.binary())])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^file:", "", path))


def record_bytes(row: dict, date: str) -> bytes:
    """One record; control characters in header values are percent-encoded, absent values have no field."""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD if revisit else HTTP_HEAD + (row["payload"] or b"")
    fields = {**{f: row[c] for c, f in FIELDS.items()}, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = "".join(f"{k}: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', str(v))}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own name; commit lists them in a manifest, so files of lost attempts are never read."""

    def __init__(self, options):
        self.path = options["path"]
        self.gzip = options.get("compression", "none") == "gzip"
        self.roll = int(options.get("maxFileBytes", 128 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):  # one payload at a time in Python
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None or size >= self.roll:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = fs.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                data = record_bytes(row, self.date)
                if self.gzip:
                    z = zlib.compressobj(wbits=31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, f"_manifest-{uuid.uuid4().hex}.json"), compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for name in (x for m in messages if m for x in m.files):
            fs.delete_file(posixpath.join(root, name))


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitBytes", 32 << 20))
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in FIELDS and name != "payload_length" and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((name, type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self):
        """Files in order of name, small ones together up to splitBytes."""
        fs, root = filesystem(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        manifests = [i for i in infos if i.base_name.startswith("_manifest-")]
        if manifests:
            listed = {n for m in manifests for n in json.loads(fs.open_input_stream(m.path).read())}
            infos = [i for i in infos if i.base_name in listed]
        infos = sorted((i for i in infos if re.search(r"\.warc(\.gz)?$", i.base_name)), key=lambda i: i.path)
        groups, size = [], 0
        for i in infos:
            if not groups or size + i.size > self.split:
                groups.append([])
                size = 0
            groups[-1].append(i.path)
            size += i.size
        return [Files(g) for g in groups] or [Files([])]

    def wanted(self, head: dict) -> bool:
        for name, kind, value in self.tests:
            have = head.get(FIELDS[name].lower())
            if have is None or not {"EqualTo": lambda: have == value, "In": lambda: have in value, "StringStartsWith": lambda: have.startswith(value)}[kind]():
                return False
        return True

    def read(self, partition):
        fs, _ = filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                stream = Inflated(raw) if path.endswith(".gz") else Plain(raw)
                for head, payload in records(stream, self.wanted, self.with_payload):
                    get = lambda c: head.get(FIELDS[c].lower())  # noqa: B023, E731
                    length = get("payload_length")
                    rows.append({c: get(c) for c in list(FIELDS)[:5]} | {"payload_length": int(length) if length else None, "payload": payload})
                    size += len(payload or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class Plain:
    """Buffered reading of an uncompressed file; skip() seeks."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.buf, self.at = raw, block, b"", 0

    def fill(self) -> bool:
        more = self.raw.read(self.block)
        self.buf, self.at = self.buf[self.at :] + more, 0
        return bool(more)

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (p := self.buf.find(mark, self.at + seen)) < 0:
            seen = max(len(self.buf) - self.at - len(mark), 0)
            if not self.fill():
                return None
        out, self.at = self.buf[self.at : p + len(mark)], p + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if self.at >= len(self.buf) and not self.fill():
                raise EOFError("a record ends before its Content-Length")
            part = self.buf[self.at : self.at + n - have]
            self.at += len(part)
            have += len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        left = n - (len(self.buf) - self.at)
        if left <= 0:
            self.at += n
        else:
            self.buf, self.at = b"", 0
            if self.raw.tell() + left > self.raw.size():
                raise EOFError("a record ends before its Content-Length")
            self.raw.seek(self.raw.tell() + left)


class Inflated(Plain):
    """The same over gzip members; skip() inflates in blocks and keeps nothing."""

    def __init__(self, raw, block: int = 1 << 18):
        super().__init__(raw, block)
        self.z, self.left = zlib.decompressobj(wbits=31), b""

    def fill(self) -> bool:
        more = b""
        while not more:
            if self.z.eof:
                self.left, self.z = self.z.unused_data, zlib.decompressobj(wbits=31)
            data = self.left or self.raw.read(self.block)
            self.left = b""
            if not data:
                return False
            more = self.z.decompress(data, 4 * self.block)
            self.left = self.z.unconsumed_tail
        self.buf, self.at = self.buf[self.at :] + more, 0
        return True

    def skip(self, n: int) -> None:
        while n > len(self.buf) - self.at:
            n -= len(self.buf) - self.at
            self.buf, self.at = b"", 0
            if not self.fill():
                raise EOFError("a record ends before its Content-Length")
        self.at += n


def records(stream: Plain, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(header fields by lower-case name, payload or None) of the records wanted."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields.get("content-length", 0))
        if not wanted(fields):
            stream.skip(n + 4)
        elif not with_payload or fields.get("warc-type") == "revisit":
            stream.skip(n + 4)
            yield fields, None
        else:
            block = stream.take(n)
            stream.skip(4)
            http = fields.get("content-type", "").startswith("application/http")
            yield fields, block.partition(b"\r\n\r\n")[2] if http else block
    if stream.buf[stream.at :]:
        raise EOFError("an archive ends within a header")


class WarcDataSource(DataSource):
    """Options: path; payload (false: headers only), splitBytes; for writing compression (none, gzip), maxFileBytes, date."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


REVISIT_FROM = 1000


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "none") -> None:
    """Write one record for each row to path; equal payloads of at least REVISIT_FROM bytes become revisits.

    The row with the largest key of equal payloads is the response (rows that
    repeat its key as well). A null html is an empty payload, a null url has
    no field; among rows without a key all are responses. An empty table
    writes an empty archive. Equality is by SHA-1, SHA-256 and length; only
    digests are grouped, with partial aggregation, and the groups of two or
    more are joined back, broadcast if a count allows.
    """
    scratch = Scratch(pages.sparkSession, "warc-groups")
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("target_uri"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_length"))
    named = rows.select("*", F.sha2("payload", 256).alias("sha2"))
    groups = scratch.save(
        named.filter(f"payload_length >= {REVISIT_FROM}").groupBy("sha1", "sha2", "payload_length")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"),
        "groups",
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    join_checked(named, groups, ["sha1", "sha2", "payload_length"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"), "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("compression", compression).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: responses measured anew, revisits by their headers."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    archive = read_archive(spark, path).filter("record_type = 'response'")
    full = archive.select(
        number("record_id").alias("page_id"), F.octet_length(F.coalesce("payload", F.lit(b""))).cast("long").alias("payload_bytes"),
        F.sha1(F.coalesce("payload", F.lit(b""))).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    heads = read_archive(spark, path, payload=False).filter("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
    return full.unionByName(heads)
