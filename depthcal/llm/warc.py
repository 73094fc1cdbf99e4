"""WARC archives as a Python data source, and a writer that replaces repeated payloads by revisit records.

Archives may be plain, or gzipped in any way; those written here store the length of each member.

The reader plans one partition per group of files, takes equality and membership filters on the record type, the
record id, the target address, the digest and the reference as pushed predicates, parses a record's headers first and
doesn't unpack the payload of a record that fails them, nor any where payloads aren't asked for: each record is a
gzip member of its own, its header block is unpacked alone, and the stream goes ahead by the stored length.

Cases: a null payload counts as empty; rows with a null id get a record without a page id; rows of equal payload give
one response, under their largest id, and revisits of it, also where a page_id is on rows of different payloads; very long payloads are held one at
a time; an empty table gives no file and an empty result; further columns are ignored by name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from .common import materialize, new_path, open_uri, rename_uri, table

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
          "payload_length long, page_id long, refers_to_page_id long, payload binary")
#: Columns of the headers that filters may be pushed on.
HEADER_COLUMNS = {"record_type", "record_id", "target_uri", "payload_digest", "refers_to", "page_id", "refers_to_page_id"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
#: Bytes read at a time.
_READ = 1 << 16
#: gzip header with an extra field "sl" that holds the member's packed and unpacked lengths.
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member whose header carries its own length, so that a reader can skip it without unpacking."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = len(_HEAD) + 2 + 12 + len(body) + 8
    return _HEAD + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + body + tail


def record(kind: str, record_id: str, headers: dict[str, str], payload: bytes) -> bytes:
    """A record as one gzip member: the header block, the payload, two line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items()]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return member("\r\n".join(lines).encode() + payload + b"\r\n\r\n")


class _Source:
    """Bytes of a file with a look ahead."""

    def __init__(self, stream):
        self.stream, self.ahead = stream, b""

    def peek(self, n: int) -> bytes:
        while len(self.ahead) < n and (part := self.stream.read(max(n - len(self.ahead), _READ))):
            self.ahead += part
        return self.ahead[:n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.ahead = self.ahead[n:]
        return out

    def some(self) -> bytes:
        return self.read(len(self.ahead) or len(self.peek(_READ)))


class _Inflated:
    """The unpacked bytes of gzip members one after the other, read and skipped in pieces."""

    def __init__(self, source: _Source):
        self.source, self.unpacker = source, None

    def read(self, n: int) -> bytes:
        while True:
            if self.unpacker is None:
                if not self.source.peek(2):
                    return b""
                self.unpacker = zlib.decompressobj(31)
            part = self.unpacker.unconsumed_tail or self.source.some()
            if not part:
                raise ValueError("a gzip member without its end")
            out = self.unpacker.decompress(part, n)
            if self.unpacker.eof:
                self.source.ahead = self.unpacker.unused_data + self.source.ahead
                self.unpacker = None
            if out:
                return out


def read_records(stream) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """(headers, a function that gives the content) of each record of a plain or gzipped archive.

    The content of a record whose function isn't called is skipped: without unpacking where the member stores its
    length, as this module's archives do, else piece by piece.
    """
    source = _Source(stream)
    head = source.peek(24)
    if head[:4] == _HEAD[:4] and head[12:14] == b"sl":
        while head := source.read(24):
            if len(head) < 24 or head[:4] != _HEAD[:4] or head[12:14] != b"sl":
                raise ValueError("not a member with a stored length")
            data = head + source.read(struct.unpack("<I", head[16:20])[0] - 24)
            headers = parse_headers(header_block(data))
            yield headers, lambda data=data, n=int(headers["content-length"]): payload_of(data, n)
        return
    flow = _Source(_Inflated(source) if head[:2] == b"\x1f\x8b" else source)
    while True:
        while flow.peek(2) == b"\r\n":  # line ends behind a record
            flow.read(2)
        if not flow.peek(1):
            return
        size = 1024
        while (end := flow.peek(size).find(b"\r\n\r\n")) < 0:
            if len(flow.ahead) < size:
                raise ValueError("a record without the end of its headers")
            size *= 2
        headers, left = parse_headers(flow.read(end + 4)[:end]), [0]
        left[0] = int(headers["content-length"])

        def content() -> bytes:
            out = flow.read(left[0])
            if len(out) < left[0]:
                raise ValueError("a record without the end of its content")
            left[0] = 0
            return out

        yield headers, content
        while left[0] and (part := flow.read(min(left[0], _READ))):
            left[0] -= len(part)


def header_block(data: bytes) -> bytes:
    """The header block of a packed record; what follows stays packed."""
    unpacker, block = zlib.decompressobj(31), b""
    while (end := block.find(b"\r\n\r\n")) < 0:
        part = unpacker.decompress(data, 2048)
        if not part:
            raise ValueError("a record without the end of its headers")
        block, data = block + part, unpacker.unconsumed_tail
    return block[:end]


def payload_of(data: bytes, length: int) -> bytes:
    """The content of a packed record, its length being that of its Content-Length header."""
    return zlib.decompress(data, 31)[-4 - length:-4]


def parse_headers(block: bytes) -> dict[str, str]:
    found = {}
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _uuid_of(text: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, text))


class WarcFiles(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.per_task = int(options.get("filesPerTask", "1"))
        self.payload = options.get("payload", "true") == "true"
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                if isinstance(f, IsNotNull):
                    self.tests.append((f.attribute[0], None))
                else:
                    self.tests.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        return [WarcFiles(self.paths[i:i + self.per_task]) for i in range(0, len(self.paths), self.per_task)]

    def read(self, partition):
        for path in partition.paths:
            with open_uri(path, "rb") as stream:
                for h, content in read_records(stream):
                    row = self._row(h)
                    if not all(row[c] is not None and (want is None or row[c] in want) for c, want in self.tests):
                        continue
                    if self.payload:
                        row["payload"] = content()
                        if h.get("content-type", "").startswith("application/http"):  # the payload lies behind the message's own headers
                            row["payload"] = row["payload"].partition(b"\r\n\r\n")[2]
                        elif row["record_type"] == "response" and row["payload_digest"] not in (None, digest_of(row["payload"])):
                            raise ValueError(f"{path}: the payload of {row['record_id']} doesn't have its digest")
                    yield tuple(row[c] for c in self.columns)

    @staticmethod
    def _row(h: dict[str, str]) -> dict:
        whole = lambda name: int(h[name]) if name in h else None
        return {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"),
                "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": h.get("warc-refers-to"),
                "payload_length": whole("x-payload-length"), "page_id": whole("x-page-id"),
                "refers_to_page_id": whole("x-refers-to-page-id"), "payload": None}


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, paths: list[str], payload: bool = True, files_per_task: int = 1) -> DataFrame:
    """The records of the archives. ``payload=False`` leaves payloads packed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return (spark.read.format("warc").option("paths", "\n".join(paths)).option("filesPerTask", str(files_per_task))
            .option("payload", str(payload).lower()).load())


#: Repeated payloads (a checksum and an id each) that may be broadcast; beyond it the join shuffles the rows.
BROADCAST_PAYLOADS = 1_000_000


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, leader, sha): leader is the largest page_id of equal payloads.

    The group's leader is found by a checksum of the payload, pre-aggregated where the rows are. The leaders of repeated
    payloads are then broadcast up to a bound, so that only ids and checksums are shuffled.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    leaders = rows.groupBy("sha").agg(F.max("page_id").alias("leader"), F.count("*").alias("copies"))
    shared = materialize(leaders.where("copies > 1").select("sha", "leader"), "warc-leaders")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_PAYLOADS else shared
    return rows.join(shared, "sha", "left").select("page_id", "url", "html", F.coalesce("leader", "page_id").alias("leader"), "sha")


def write_warc(pages: DataFrame) -> list[str]:
    """Write a record for each row of (page_id, url, html); returns the archives' paths.

    Each task writes one archive under a passing name and then publishes it, so a repeated task replaces its own file.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        passing = f"{path}.{task.taskAttemptId()}"
        out = None
        for batch in batches:
            for page_id, url, html, leader, nth in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or open_uri(passing, "wb")
                payload = (html or "").encode()
                digest = digest_of(payload)
                headers = {"WARC-Target-URI": " ".join((url or "about:blank").split()), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
                if page_id is not None:
                    headers["X-Page-Id"] = str(page_id)
                if page_id is None or page_id == leader and nth == 1:
                    out.write(record("response", _uuid_of(f"page:{page_id}:{digest}:{nth}"), headers, payload))
                    continue
                headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{_uuid_of(f'page:{leader}:{digest}:1')}>", "X-Refers-To-Page-Id": str(leader)}
                out.write(record("revisit", _uuid_of(f"page:{page_id}:{digest}:{nth}"), headers, b""))
        if out:
            out.close()
            rename_uri(passing, path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    planned = plan_records(pages)
    # Equal ids are rare: those of equal payload are numbered so that only one of them is the response.
    twice = pages.groupBy("page_id").agg(F.count("*").alias("c")).where("c > 1 and page_id is not null").select("page_id")
    if twice.isEmpty():
        nth = F.lit(1)
    else:
        from pyspark.sql import Window as W

        nth = F.row_number().over(W.partitionBy("page_id", "sha").orderBy("url"))
    planned = planned.select("page_id", "url", "html", "leader", nth.alias("nth"))
    written = materialize(planned.mapInArrow(write, "path string"), "warc-paths")
    return sorted(r["path"] for r in written.collect())  # one row per task


def query(spark, sf_dir: str) -> DataFrame:
    paths = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = read_warc(spark, paths)
    length = F.when(F.col("record_type") == "response", F.length("payload").cast("long")).otherwise(F.col("payload_length"))
    return records.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type",
                          F.col("refers_to_page_id").alias("refers_to"))
