"""WARC archives as a Spark data source (format ``warc``), and archiving of pages.

Writing: each task writes gzip files with one member per record, closing a file at
``maxFileBytes``; names are unique per attempt and the commit lists the files that count in
``_files``, so failed or repeated attempts leave no record behind. Members carry their length in
the ``sl`` extra field, as the format allows.

Reading: the driver lists files and plans byte ranges of about ``splitBytes``; a range starts at
the first member in it. A task parses the headers of a record first. Predicates on the record
type and other header columns are pushed down (``spark.sql.python.filterPushdown.enabled``); the
payload of a record that fails them, or all payloads when the schema has no ``payload``, is
skipped without being inflated if the member tells its length. Uncompressed ``.warc`` files are
read too, as one range each, skipping by ``Content-Length``.

Edge cases of ``archive_pages``: a null html is an empty payload. A record with a null page_id
never is the one others refer to, unless all of its payload have none: then all are responses.
Rows that repeat the smallest page_id are responses as well. No rows give no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
    IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from learnloom.llm.common import small_batches
from learnloom.session import Scratch

# Header field of each header column (fixed names of the format).
FIELDS = {
    "record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
SCHEMA = (
    "record_id string, warc_type string, warc_date string, target_uri string, refers_to string, payload_digest string, "
    "content_type string, content_length long, headers map<string,string>, payload binary"
)
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 14


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member whose ``sl`` field holds its own and the uncompressed length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    """Options: path, maxFileBytes, splitBytes, verify (compare payloads with their digest)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "WarcReader":
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> "WarcWriter":
        return WarcWriter(dict(self.options), overwrite)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with header columns, ``headers`` (further fields) and ``payload``."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.overwrite = overwrite
        self.most = int(options.get("maxfilebytes", options.get("maxFileBytes", 256 << 20)))
        # Listed in the driver before any task writes, so what failed attempts leave is not in it.
        fs, root = filesystem(self.path)
        self.earlier = [] if overwrite else [f.rsplit("/", 1)[-1] for f, _ in listed_files(fs, root)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                            "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}
                    size = out.write(gzip_member(record_bytes(info, b"format: WARC File Format 1.1\r\n")))
                size += out.write(gzip_member(self.record(row)))
        if out:
            out.close()
        return Written(files)

    def record(self, row: dict) -> bytes:
        headers = {FIELDS[c]: row[c] for c in FIELDS if row.get(c) is not None}
        payload = row.get("payload") or b""
        if headers["WARC-Type"] == "revisit":
            headers |= {"WARC-Profile": PROFILE}
            block = b""
        else:
            headers |= {"Content-Type": HTTP}
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        if "WARC-Payload-Digest" in headers:
            headers["WARC-Payload-Digest"] = "sha1:" + headers["WARC-Payload-Digest"]
        return record_bytes(headers | {k: v for k, v in (row.get("headers") or []) if v is not None}, block)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        kept = fs.get_file_info(f"{root}/_files").type == pafs.FileType.File and not self.overwrite
        files = [f.rsplit("/", 1)[-1] for f, _ in listed_files(fs, root)] if kept else list(self.earlier)
        files += [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/_files", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f}")


def listed_files(fs: pafs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives of a folder: those in ``_files`` if it is there."""
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [(root, fs.get_file_info(root).size)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    archives = sorted((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))
    if any(f.base_name == "_files" for f in found):
        with fs.open_input_stream(f"{root}/_files", compression=None) as committed:
            names = set(json.loads(committed.read()))
        archives = [(p, s) for p, s in archives if p.rsplit("/", 1)[-1] in names]
    return archives


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))
        self.verify = options.get("verify", "false").lower() == "true"
        self.schema = schema
        self.wanted = set(schema.names)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in FIELDS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", {f.value}))
            elif column in FIELDS and isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif column in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in FIELDS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = filesystem(self.path)
        ranges, open_, size = [], [], 0
        for path, length in listed_files(fs, root):
            step = self.split if path.endswith(".gz") else max(length, 1)
            for start in range(0, max(length, 1), step):
                stop = min(start + step, length)
                open_.append((path, start, stop))
                size += stop - start
                if size >= self.split:
                    ranges.append(Ranges(open_))
                    open_, size = [], 0
        return ranges + ([Ranges(open_)] if open_ or not ranges else [])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        rows, size = [], 0
        for path, start, stop in partition.value:
            fs, _ = filesystem(self.path)
            with fs.open_input_file(path) as file:
                scan = gzip_records if path.endswith(".gz") else plain_records
                for headers, take in scan(file, start, stop):
                    row = self.row(headers, take)
                    if row is not None:
                        rows.append(row)
                        size += len(row.get("payload") or b"") + 512
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def row(self, headers: dict[str, str], take) -> dict | None:
        values = {c: headers.get(field.lower()) for c, field in FIELDS.items()}
        if values["payload_digest"]:
            values["payload_digest"] = values["payload_digest"].rpartition(":")[2]
        for column, test, value in self.tests:
            mine = values[column]
            if test == "in" and mine not in value or test == "there" and mine is None:
                return None
            if test == "starts" and not (mine or "").startswith(value):
                return None
        if "payload" in self.wanted:
            payload = take()
            if (values["content_type"] or "").startswith("application/http"):
                payload = payload.partition(b"\r\n\r\n")[2]
            if self.verify and values["warc_type"] == "response" and base32_sha1(payload) != values["payload_digest"]:
                raise ValueError(f"payload of {values['record_id']} does not match its digest")
            values["payload"] = payload
        values["content_length"] = int(headers.get("content-length", 0))
        known = {f.lower() for f in FIELDS.values()} | {"content-length"}
        values["headers"] = [(k, v) for k, v in headers.items() if k not in known]
        return {c: values[c] for c in self.schema.names}


def parse_headers(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def gzip_records(file: pa.NativeFile, start: int, stop: int):
    """(headers, function that inflates the block) of the records that start in the range."""
    at = next_member(file, start, stop) if start else 0
    end = file.size()
    while at is not None and at < stop:
        inflate, fed, out = zlib.decompressobj(31), at, b""
        first = file.read_at(READ, at)
        length = member_length(first)
        data = first
        while b"\r\n\r\n" not in out and not inflate.eof and data:
            out += inflate.decompress(data)
            fed += len(data)
            data = file.read_at(READ, fed) if not inflate.eof else b""
        head, _, body = out.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        state = {"fed": fed, "body": body}

        def take(keep: bool = True) -> bytes:
            """The block; reads to the end of the member."""
            parts = [state["body"]]
            while not inflate.eof and state["fed"] < end:
                more = file.read_at(1 << 18, state["fed"])
                state["fed"] += len(more)
                piece = inflate.decompress(more)
                if keep:
                    parts.append(piece)
            return b"".join(parts)[: int(headers.get("content-length", 0))] if keep else b""

        yield headers, take
        if length is None:
            take(keep=False)
            at = state["fed"] - len(inflate.unused_data)
        else:
            at += length


def member_length(head: bytes) -> int | None:
    """Length of a gzip member from its ``sl`` extra field."""
    if len(head) < 12 or not head.startswith(MAGIC) or not head[3] & 4:
        return None
    extra, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"sl" and size == 8:
            return struct.unpack_from("<I", extra, at + 4)[0]
        at += 4 + size
    return None


def next_member(file: pa.NativeFile, start: int, stop: int) -> int | None:
    """First place in the range where a gzip member with a WARC record begins."""
    at = start
    while at < stop:
        chunk = file.read_at(min(1 << 18, stop - at) + len(MAGIC) - 1, at)
        found = chunk.find(MAGIC)
        while found >= 0:
            try:
                if zlib.decompressobj(31).decompress(file.read_at(1024, at + found), 16).startswith(b"WARC/"):
                    return at + found
            except zlib.error:
                pass
            found = chunk.find(MAGIC, found + 1)
        at += max(len(chunk) - len(MAGIC) + 1, 1)
    return None


def plain_records(file: pa.NativeFile, start: int, stop: int):
    """As ``gzip_records``, for an uncompressed file."""
    at = start
    while at < stop:
        head, size = b"", 0
        while b"\r\n\r\n" not in head:
            more = file.read_at(READ, at + size)
            if not more:
                return
            head += more
            size += len(more)
        gap = len(head) - len(head.lstrip(b"\r\n"))
        text, _, _ = head[gap:].partition(b"\r\n\r\n")
        if not text.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = parse_headers(text)
        body, length = at + gap + len(text) + 4, int(headers.get("content-length", 0))
        yield headers, lambda body=body, length=length: file.read_at(length, body)
        at = body + length + 4


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record per page. Of equal payloads of at least ``least_bytes`` bytes the page
    with the smallest id is a response and the others are revisits that refer to it."""
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    smallest = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(smallest, "sha1")
    revisit = (F.col("size") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    digest = base32_column("sha1")
    records = rows.select(
        page_uri("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.regexp_replace("url", r"[\r\n]", "").alias("target_uri"),
        F.when(revisit, page_uri("first_id")).alias("refers_to"),
        digest.alias("payload_digest"),
        F.create_map(F.lit("X-Payload-Length"), F.col("size").cast("string")).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").option("path", path).mode("append").save()


def page_uri(column: str):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def page_of(column: str):
    return F.nullif(F.regexp_extract(column, r"^<urn:x-page:(-?\d*)>$", 1), F.lit("")).cast("long")


def base32_column(sha1: str):
    """Base32 of a hexadecimal SHA-1: 32 groups of five bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha1, i, 10), 16, 2), 40, "0") for i in range(1, 41, 10)])
    return F.concat(
        *[F.substring(alphabet, F.conv(F.substring(bits, i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(1, 161, 5)]
    )


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame, scratch: Scratch | None = None, least_bytes: int = 0) -> DataFrame:
    """Archive the pages and describe every record from what is read back.

    Payloads of responses are read and compared with their digest; revisits need headers only.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    path = scratch.path()
    archive_pages(pages, path, least_bytes)
    header = "record_id string, warc_type string, refers_to string, payload_digest string, headers map<string,string>"
    described = ["record_id", "warc_type", "refers_to", "payload_digest"]
    responses = read_archive(spark, path, f"{header}, payload binary", verify=True).where("warc_type = 'response'")
    responses = responses.select(*described, F.octet_length("payload").cast("long").alias("payload_bytes"))
    revisits = read_archive(spark, path, header).where("warc_type = 'revisit'")
    revisits = revisits.select(*described, F.element_at("headers", "x-payload-length").cast("long").alias("payload_bytes"))
    return responses.unionByName(revisits).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )


_BITS = "(" + " || ".join(f"lpad(bin(('0x' || substr(h, {i}, 10))::BIGINT), 40, '0')" for i in range(1, 41, 10)) + ")"
_DIGEST = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, {i}, 5))::INT + 1, 1)" for i in range(1, 161, 5)
)
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT page_id, payload_bytes, h, {_BITS} AS bits, min(page_id) OVER (PARTITION BY h) AS first_id FROM h),
r AS (SELECT *, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS revisit FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first_id END AS refers_to
FROM r"""
