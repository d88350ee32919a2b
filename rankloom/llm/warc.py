"""WARC archives as a PySpark data source, and pages archived with identical payloads kept once.

`WarcDataSource` ("warc") writes and reads WARC/1.1 `response` and `revisit` records with HTTP blocks.

Writing: every task writes files of about `fileBytes`, each under a name of its own, and the commit adds
a manifest that lists them. A reader takes only listed files, so those of lost, repeated or speculative
tasks are never seen. With `compression` gzip each record is a gzip member whose `sl` extra field gives
its length, so that a reader can pass over it without inflating.

Reading: partitions are planned from the manifests (or, where there are none, a listing): small files
share one, a file is never split. Predicates on the record type and the other header columns are pushed
down (`pushFilters`). A record's headers are parsed first; if they fail a predicate, or if the asked
schema has no `payload`, the payload is passed over: neither inflated, where the member's length is
known, nor copied.

Files are reached through pyarrow's file systems, so the path may be local and shared, or in a store.

Null payloads are empty ones. A null record id or address is an empty header and is read back as null.
Line ends and other control characters in an address are percent-encoded. Repeated rows are
records of their own. Broken records raise an error that names the file and the place.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, http_length long, payload binary"
)
HEADERS_ONLY = SCHEMA.removesuffix(", payload binary")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
ROWS_PER_BATCH, BYTES_PER_BATCH = 2048, 8 << 20
CRLF = b"\r\n"


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.rstrip("/"))


# ---------------------------------------------------------------- records


def record_bytes(row: dict) -> bytes:
    """A record of the columns of SCHEMA; http_length is that of the payload unless it is given."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["http_length"] if row["http_length"] is not None else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{_clean(row['record_id'])}>"),
        ("WARC-Date", row["warc_date"] or NO_DATE),
        ("WARC-Target-URI", _clean(row["target_uri"])),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_clean(row['refers_to'])}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines)
    return head.encode() + CRLF + block + CRLF + CRLF


def _clean(value: str | None) -> str:
    """A header value: control characters and spaces percent-encoded, none for null."""
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", value or "")


def gzip_member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length and that of its content in an `sl` extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 24 + len(body) + 8
    fits = size < 1 << 32 and len(raw) < 1 << 32
    lengths = struct.pack("<II", size, len(raw)) if fits else struct.pack("<II", 0, 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + lengths
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


# ---------------------------------------------------------------- reading records


class Member:
    """The content of one gzip member, inflated as far as it is asked for."""

    def __init__(self, file: io.BufferedReader):
        self.file, self.start = file, file.tell()
        head = file.read(10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.size, flags = 0, head[3]
        if flags & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            while len(extra) >= 4:
                name, many = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if name == b"sl" and many == 8:
                    self.size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + many :]
        for bit in (8, 16):  # a name, a remark: up to a zero byte
            if flags & bit:
                while file.read(1) not in (b"\0", b""):
                    pass
        if flags & 2:
            file.read(2)
        self.inflate, self.held, self.ready = zlib.decompressobj(-15), b"", b""

    def _more(self, room: int) -> bytes:
        while not self.inflate.eof:
            source = self.held or self.file.read(1 << 14)
            if not source:
                raise ValueError("a gzip member ends early")
            made = self.inflate.decompress(source, room)
            self.held = self.inflate.unconsumed_tail
            if made:
                return made
        return b""

    def readline(self) -> bytes:
        while (cut := self.ready.find(b"\n")) < 0:
            more = self._more(1 << 10)
            if not more:
                cut = len(self.ready) - 1
                break
            self.ready += more
        line, self.ready = self.ready[: cut + 1], self.ready[cut + 1 :]
        return line

    def read(self, many: int) -> bytes:
        parts, have = [self.ready[:many]], min(many, len(self.ready))
        self.ready = self.ready[many:]
        while have < many and (more := self._more(many - have)):
            parts.append(more)
            have += len(more)
        return b"".join(parts)

    def finish(self) -> None:
        """Go on to the next member: by its length, or by inflating what is left."""
        if self.size:
            self.file.seek(self.start + self.size)
            return
        while self._more(1 << 20):
            pass
        left = len(self.inflate.unused_data)
        self.file.seek(self.file.tell() - left + 8)


def _header_lines(source) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    while True:
        line = source.readline()
        if not line.endswith(b"\n"):
            raise ValueError("headers end early")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return found
        if text[0] in " \t" and name:  # a folded line
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()


def _columns(head: dict[str, str]) -> dict[str, object]:
    bare = lambda value: (value or "").removeprefix("<").removesuffix(">") or None
    return {
        "record_type": head.get("warc-type"),
        "record_id": bare(head.get("warc-record-id")),
        "target_uri": bare(head.get("warc-target-uri")),
        "warc_date": head.get("warc-date"),
        "payload_digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None,
        "refers_to": bare(head.get("warc-refers-to")),
    }


def read_records(
    file: io.BufferedReader, zipped: bool, wanted: Callable[[dict], bool], payload: bool, http: bool = True
) -> Iterator[dict]:
    """The wanted records of an archive. Payloads are read only for wanted ones, and only if asked;
    `http` asks for the length that the HTTP headers state."""
    while True:
        start = file.tell()
        if not file.peek(1):
            return
        source = Member(file) if zipped else file
        line = source.readline()
        while line in (b"\r\n", b"\n"):  # stray line ends between records
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {start}")
        head = _header_lines(source)
        length = int(head.get("content-length", "0"))
        body_at = None if zipped else file.tell()
        row = _columns(head) | {"http_length": None, "payload": None}
        if wanted(row):
            left = length
            if (http or payload) and head.get("content-type", "").startswith("application/http"):
                opening, answer = _http_headers(source, left)
                left -= opening
                stated = answer.get("content-length", "")
                row["http_length"] = int(stated) if stated.isdigit() else None
            if payload:
                row["payload"] = source.read(left)
                if len(row["payload"]) < left:
                    raise ValueError(f"the record at byte {start} ends early")
            yield row
        if zipped:
            source.finish()
        else:
            file.seek(body_at + length)
            if file.read(4) != CRLF + CRLF:
                raise ValueError(f"the record at byte {start} doesn't end where its length says")


def _http_headers(source, most: int) -> tuple[int, dict[str, str]]:
    """Length of an HTTP block's opening lines and what they say."""
    used, found = 0, {}
    while used < most:
        line = source.readline()
        used += len(line)
        text = line.decode("latin-1").strip()
        if not text:
            break
        name, _, value = text.partition(":")
        found[name.strip().lower()] = value.strip()
    return used, found


# ---------------------------------------------------------------- predicates

_TESTS: dict[type, Callable[[object, object], bool]] = {
    ds.EqualTo: lambda x, y: x == y,
    ds.GreaterThan: lambda x, y: x > y,
    ds.GreaterThanOrEqual: lambda x, y: x >= y,
    ds.LessThan: lambda x, y: x < y,
    ds.LessThanOrEqual: lambda x, y: x <= y,
    ds.In: lambda x, y: x in y,
    ds.StringStartsWith: lambda x, y: x.startswith(y),
    ds.StringEndsWith: lambda x, y: x.endswith(y),
    ds.StringContains: lambda x, y: y in x,
}
PUSHED_COLUMNS = {"record_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to"}


def holds(test: ds.Filter, row: dict) -> bool | None:
    """A predicate on a record's header columns; None is SQL's null."""
    if isinstance(test, ds.Not):
        inner = holds(test.child, row)
        return None if inner is None else not inner
    value = row[test.attribute[0]]
    if isinstance(test, ds.IsNull):
        return value is None
    if isinstance(test, ds.IsNotNull):
        return value is not None
    if isinstance(test, ds.EqualNullSafe):
        return value == test.value
    if value is None or getattr(test, "value", "") is None:
        return None
    return _TESTS[type(test)](value, test.value)


def can_push(test: ds.Filter) -> bool:
    if isinstance(test, ds.Not):
        return can_push(test.child)
    if len(test.attribute) != 1 or test.attribute[0] not in PUSHED_COLUMNS:
        return False
    if isinstance(test, ds.In) and any(v is None for v in test.value):
        return False
    return isinstance(test, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)) or type(test) in _TESTS


# ---------------------------------------------------------------- the data source


@dataclass
class Files(ds.InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.fields = [f.name for f in schema.fields]
        self.schema = schema
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        for test in filters:
            if can_push(test):
                self.filters.append(test)
            else:
                yield test

    def partitions(self):
        groups: list[list[str]] = []
        room = 0
        for name, size in listed_files(self.path):
            if not groups or size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(name)
            room -= size
        return [Files(names) for names in groups]

    def read(self, partition: Files | None):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no files
            return
        fields = to_arrow_schema(self.schema)
        fs, folder = file_system(self.path)
        payload, http = "payload" in self.fields, "http_length" in self.fields
        wanted = lambda row: all(holds(test, row) is True for test in self.filters)
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{folder}/{name}" if folder != name else name) as opened:
                file = io.BufferedReader(opened, 1 << 18)
                try:
                    for row in read_records(file, name.endswith(".gz"), wanted, payload, http):
                        rows.append({f: row[f] for f in self.fields})
                        size += len(row["payload"] or b"")
                        if len(rows) >= ROWS_PER_BATCH or size >= BYTES_PER_BATCH:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows, size = [], 0
                except ValueError as broken:
                    raise ValueError(f"{name}: {broken}") from broken
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are only added to: write to a new folder")
        self.path = options["path"]
        self.zipped = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator):
        from pyspark import TaskContext

        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get().partitionId()
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task:05d}-{uuid.uuid4().hex}.warc" + (".gz" if self.zipped else "")
                    out, size = fs.open_output_stream(f"{folder}/{name}", compression=None), 0
                raw = record_bytes(row)
                raw = gzip_member(raw) if self.zipped else raw
                out.write(raw)
                size += len(raw)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages):
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        listed = sorted(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages):
        fs, folder = file_system(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{name}")


def listed_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a folder's archives: those of its manifests, or all where there is none."""
    fs, folder = file_system(path)
    about = fs.get_file_info(folder)
    if about.type == pa.fs.FileType.File:
        return [(folder, about.size)]
    infos = fs.get_file_info(pa.fs.FileSelector(folder))
    manifests = [i.path for i in infos if i.base_name.startswith("_manifest-")]
    if not manifests:
        return sorted((i.base_name, i.size) for i in infos if re.search(r"\.warc(\.gz)?$", i.base_name))
    files: list[tuple[str, int]] = []
    for manifest in manifests:
        with fs.open_input_stream(manifest) as held:
            files += [(name, size) for name, size in json.loads(held.read())]
    return sorted(files)


class WarcDataSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, **options) -> DataFrame:
    """Records of the archives in a folder; give HEADERS_ONLY, or any columns of SCHEMA, to leave
    payloads where they are."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Add records (columns of SCHEMA) to the archives in a folder."""
    records.sparkSession.dataSource.register(WarcDataSource)
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    records.select(*names).write.format("warc").options(**options).mode("append").save(path)


# ---------------------------------------------------------------- pages


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column."""
    digest = F.sha1(payload)
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    fives = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*fives), digits, letters)


def page_records(
    pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """A record (SCHEMA) per page. Of pages with equal payloads of `min_bytes` or more the one with the
    smallest id is a response and the others revisit it (rows that repeat the smallest id are all
    responses); shorter payloads, and payloads whose pages all lack an id, are responses. Equal means:
    the same SHA-1, length and 64-bit hash. Counts per payload are pre-aggregated, and only payloads
    met twice take part in the join, whose hot keys adaptive execution splits."""
    rows = pages.select(
        pages[f"`{id_col}`"].cast("long").alias("page_id"),
        pages[f"`{url_col}`"].cast("string").alias("target_uri"),
        F.coalesce(pages[f"`{html_col}`"].cast("binary"), F.lit(b"")).alias("payload"),
    )
    keyed = rows.select(
        "*",
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("http_length"),
        F.xxhash64("payload").alias("mark"),
    )
    key = ["payload_digest", "http_length", "mark"]
    repeated = (
        keyed.filter(F.col("http_length") >= min_bytes)
        .groupBy(*key)
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return keyed.join(repeated, key, "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit(NO_DATE).alias("warc_date"),
        "payload_digest",
        F.when(again, urn(F.col("first_id"))).alias("refers_to"),
        "http_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every archived page. Responses
    are measured on the payloads as read; of revisits only headers are."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    full = read_warc(spark, path).filter("record_type = 'response'")
    brief = read_warc(spark, path, HEADERS_ONLY).filter("record_type = 'revisit'")
    about = lambda rows, size, digest: rows.select(
        number(F.col("record_id")).alias("page_id"),
        size.cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
    return about(full, F.octet_length("payload"), base32_sha1(F.col("payload"))).unionByName(
        about(brief, F.col("http_length"), F.col("payload_digest"))
    )
