"""WARC archives as a data source: a sink of one gzip member a record, and a reader that can be split anywhere.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").option("splitBytes", 64 << 20).load(folder)

Reading: a task gets a range of bytes of a file. It looks for the magic bytes of a gzip member, takes a candidate for one if its first
bytes decode to the head of a WARC record, and owns the records whose members start inside its range; the last one is read to its end, past the range. Behind a
member the next one starts at once, so that nothing is searched there; where that is not so (damage), the search begins anew. Archives within a payload may
hold such members too. The sink therefore marks the members of a file with a token of the file's own in a gzip extra
field, and the reader asks for the token of the file's first member; files of other writers have none, and there a candidate must also
decode whole, with the checksum and the lengths that its heads tell, and be followed by another head or the end.

Writing: each task writes one file under a name of its own and tells it to the driver, which writes a list of the files that count
when all are there; a task that is tried again leaves a file that no list names. Where a folder has such lists only their files are read. Tasks open files
through the Arrow file systems (local paths and file:, hdfs:, s3:, gs:), so that nothing passes the driver.

Defined results: a null payload is empty; null url, id and reference are left out and read as null; line ends in heads are
percent-encoded; a revisit keeps the heads of its HTTP answer, so that the length of the full payload is known, and no payload (null); records of
other kinds have their block as payload; a damaged record is left out, what follows it is found; very long records are decoded whole, one at a time; a folder
without files gives no rows; repeated rows are records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.shipping import ship
from .common import FLUSH_BYTES, checkpoint, checkpoint_dir, table

#: Bytes of a file that one task owns.
SPLIT_BYTES = 64 << 20
#: Bytes read at a time.
READ_BYTES = 1 << 20
#: The most bytes of a record's head, decoded: what has no end of head there is no record.
HEAD_BYTES = 1 << 16
MAGIC = b"\x1f\x8b\x08"
_FIELD = b"SW"  # of the extra field that holds a file's token
_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, file string, offset long, length long"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to")]
    + [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A head's value on one line, without blanks at its ends."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value).strip(" ")


def encoded(record_id: str | None, record_type: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """A record of an HTTP answer, response or revisit, as bytes."""
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = answer if record_type == "revisit" else answer + payload
    heads = [("WARC-Type", record_type), ("WARC-Record-ID", record_id and f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if record_type == "revisit":
        heads += [("WARC-Refers-To", refers_to and f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    heads += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {_safe(v)}\r\n" for k, v in heads if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(data: bytes, token: bytes) -> bytes:
    """data as one gzip member that carries the token."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    extra = _FIELD + struct.pack("<H", len(token)) + token
    head = MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def token_of(head: bytes) -> bytes | None:
    """The token of a member's first bytes, if it carries one."""
    if head[:3] != MAGIC or len(head) < 12 or not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == _FIELD:
            return extra[4 : 4 + n]
        extra = extra[4 + n :]
    return None


def heads_of(lines: bytes) -> dict[str, str]:
    """Heads by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def decoded(data: bytes) -> tuple | None:
    """(record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest) of a whole record; None if it is damaged."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    heads = heads_of(head)
    size = heads.get("content-length", "")
    if not size.isdecimal() or "warc-type" not in heads or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    block, kind, told = rest[:-4], heads["warc-type"], heads.get("warc-payload-digest", "").removeprefix("sha1:")
    bare = lambda x: x and x.removeprefix("<").removesuffix(">")
    if kind == "revisit":
        length = heads_of(block.partition(b"\r\n\r\n")[0]).get("content-length", "")
        payload, n, sha = None, int(length) if length.isdecimal() else None, told or None
    else:
        payload = block.partition(b"\r\n\r\n")[2] if heads.get("content-type", "").startswith("application/http") else block
        n, sha = len(payload), digest(payload)
        if told and told != sha:
            return None
    return bare(heads.get("warc-record-id")), kind, heads.get("warc-target-uri"), bare(heads.get("warc-refers-to")), payload, n, sha


class _File:
    """Bytes of a file from any place, held READ_BYTES at a time."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, offset: int, n: int = READ_BYTES) -> bytes:
        """At least n bytes from offset, unless the file ends."""
        if not (self.at <= offset and offset + n <= self.at + len(self.held)):
            self.file.seek(offset)
            self.at, self.held = offset, self.file.read(max(n, READ_BYTES))
        return self.held[offset - self.at :]

    def inflated(self, offset: int, most: int | None = None) -> tuple[bytes, int] | None:
        """(data, end) of the member at offset; with `most`, its first bytes alone; None where it does not decode."""
        d, out, size, at = zlib.decompressobj(31), [], 0, offset
        try:
            while not d.eof and (most is None or size < most):
                chunk = self.read(at, 1 if at > offset else 4096)
                if not chunk:
                    return None
                chunk = chunk[: 4096 if most else READ_BYTES]
                out.append(d.decompress(chunk, most - size if most else 0))
                size += len(out[-1])
                at += len(chunk)
        except zlib.error:
            return None
        return b"".join(out), at - len(d.unused_data)

    def starts(self, offset: int, token: bytes | None) -> bool:
        """Whether a record's member starts here, by what its first bytes decode to."""
        head = self.read(offset, 64)
        if head[:3] != MAGIC or (token is not None and token_of(head) != token):
            return False
        found = self.inflated(offset, HEAD_BYTES)
        return found is not None and found[0].startswith(b"WARC/1.") and b"\r\n\r\n" in found[0] and "warc-type" in heads_of(found[0].partition(b"\r\n\r\n")[0])

    def search(self, offset: int, end: int, token: bytes | None) -> int | None:
        """The first place from offset and before end where a member starts."""
        while offset < end:
            held = self.read(offset, 4)
            at = held.find(MAGIC)
            if at < 0:
                if len(held) < 4:
                    return None
                offset += len(held) - 2  # the magic may lie over what is read next
                continue
            offset += at
            if offset >= end:
                return None
            if self.starts(offset, token):
                if token is not None:
                    return offset
                whole = self.inflated(offset)
                if whole and decoded(whole[0]) and (whole[1] >= self.size or self.starts(whole[1], None)):
                    return offset
            offset += 1
        return None


def records(path: str, start: int, end: int) -> Iterator[tuple]:
    """The records of a file whose members start in [start, end), with file, offset and length."""
    f = _File(path)
    token = token_of(f.read(0, 64)) if f.size else None
    at = f.search(start, min(end, f.size), token)
    while at is not None:
        whole = f.inflated(at)
        if whole and (found := decoded(whole[0])):
            yield *found, path, at, whole[1] - at
        after = whole[1] if whole else at + 1
        if after >= min(end, f.size):
            return
        at = after if f.starts(after, token) else f.search(after, min(end, f.size), token)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcSource(DataSource):
    """Format "warc": `path`, and `splitBytes` for reading."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to a folder, never written over")
        return WarcWriter(self.options["path"], uuid.uuid4().hex)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        """Ranges of all files: names and sizes alone pass the driver."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        prefix = self.path.removesuffix(root)
        found = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.is_file}
        lists = [n for n in found if n.startswith("_committed-")]
        names = sorted({n for x in lists for n in json.loads(fs.open_input_file(found[x].path).read())} if lists else {n for n in found if n.endswith(".warc.gz")})
        ranges = [Range(prefix + found[n].path, at, min(at + self.split, found[n].size)) for n in names for at in range(0, found[n].size, self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held, size = [], 0
        for r in records(partition.path, partition.start, partition.end):
            held.append(r)
            size += 256 + len(r[4] or b"")
            if size >= FLUSH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Takes record_id, record_type (response or revisit), target_uri, refers_to and payload; other columns are not looked at."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, token, out = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz", uuid.uuid4().bytes, None
        for b in iterator:
            columns = [b.column(c) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload")]
            for i in range(b.num_rows):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                record_id, kind, uri, refers, payload = (c[i].as_py() for c in columns)
                out.write(member(encoded(record_id, kind or "response", uri, refers, payload or b""), token))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_committed-{self.job}.json") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"part-{self.job}-"):
                fs.delete_file(i.path)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages as the records to write: of those with equal payloads of at least so many bytes, that with the largest id is the response and the others revisit it.

    Rows that share that id too are responses all, as are payloads whose rows have no id; a null id beside others revisits. Equality is that of SHA-256. A payload's
    largest id is summed up before the exchange and joined to the rows, so that a payload of very many rows is one row on its side and can be split on the other.
    """
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("_sha", F.sha2("payload", 256)).withColumn("_long", F.length("payload") >= least_bytes)
    last = own.where("_long").select("id", "_sha").groupBy("_sha").agg(F.max("id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null").drop("_n")
    revisit = F.col("_long") & F.col("_last").isNotNull() & ~F.col("id").eqNullSafe(F.col("_last"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return own.join(last, "_sha", "left").select(
        name("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, name("_last")).alias("refers_to"), "payload"
    )


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op12_splittable_warc(spark: SparkSession, sf_dir: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All pages, written as archives into the shared folder and read back in splits; the archives go once their digests are kept."""
    pages = table(spark, sf_dir, "pages")
    register(spark)
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    with_revisits(pages).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").option("splitBytes", split_bytes).load(folder)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).cast("long")
    found = back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    found = checkpoint(found)
    _drop(spark, folder)
    return found
