"""WARC archives as a chunked record table.

Writing. Each page is a record. Its payload is the UTF-8 of the html; a payload of over ``chunk`` bytes is written as a
segmented record (the standard's ``continuation`` records): Spark cuts the column into rows of record identifier, chunk
number and at most ``chunk`` bytes, before Python sees any of it, and a running digest goes from each chunk to the next;
every segment's header has the digest up to there, the last one's that of the payload. Each row is one gzip member, and
Spark's text sink writes them with an empty gzip member as the line separator. So the files are plain ``.warc.gz`` files,
member by member, on any file system that Spark writes to, under its commit protocol. Beside Spark's own row, no more
than an Arrow batch of chunks is held.

Reading. The text source splits the files at the empty members, in parallel within a file as well; members can't hold
that separator, as it isn't valid UTF-8 and compressed data would have to contain twenty given bytes. Whole records are
read where they stand. The segments of oversized ones are brought together by record and sorted by number; a task
passes over them with one running digest and never holds more than a segment. The digests are compared with those in the
headers, a segmented record's at each segment, and a difference is an error.

Revisits. Payloads are equal if their SHA-256 and lengths are. Of equal payloads of at least ``least`` bytes that with
the smallest page_id is a response and the others revisit it; smaller ones are all responses.

Defined results: null html is the empty payload; null urls leave the target out; rows without a page_id are responses
and never the target of a revisit. Repeated rows are records of their own; those that hold the smallest id of their
payload are all responses. Empty table: an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import tidy

CHUNK = 64 * 1024
DATE = "2000-01-01T00:00:00Z"
#: An empty gzip member.
SEPARATOR = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_RESULT = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_RESULT_SQL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as one gzip member."""
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))]) + "\r\n"
    return made.compress(head.encode("utf-8", "surrogatepass")) + made.compress(block) + made.compress(b"\r\n\r\n") + made.flush()


def opened(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a member."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(headers["content-length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a WARC record: {head[:200]!r}")
    return headers, rest[:size]


def record_id(page: int | None, row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{page}' if page is not None else f'row:{row}')}>"


class Writer:
    """The members of records whose chunks come one after another."""

    def __init__(self, chunk: int):
        self.chunk, self.running = chunk, hashlib.sha1()

    def member(self, page: int | None, url: str | None, refers: int | None, size: int, row: str, number: int, part: bytes, digest: bytes | None) -> tuple[int, bytes]:
        """A chunk's member; 1 marks those of a segmented record. digest: of the whole payload, for revisits only."""
        own = record_id(page, row)
        common = [("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("X-Row", row)]
        if page is not None:
            common.append(("X-Page-ID", page))
        if url:
            common.append(("WARC-Target-URI", " ".join(url.split())))
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        told = lambda d: ("WARC-Payload-Digest", f"sha1:{base32(d)}")
        if refers is not None:
            return 0, member([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, "")), ("X-Refers-To-Page", refers), told(digest), *common], http)
        if size <= self.chunk:
            return 0, member([("WARC-Type", "response"), ("WARC-Record-ID", own), told(hashlib.sha1(part).digest()), *common], http + part)
        if not number:
            self.running = hashlib.sha1()
        self.running.update(part)
        last = (number + 1) * self.chunk >= size
        kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(None, f"{row}/{number}")), ("WARC-Segment-Origin-ID", own)] if number else [("WARC-Type", "response"), ("WARC-Record-ID", own)]
        end = [("WARC-Segment-Total-Length", len(http) + size), told(self.running.digest())] if last else []
        return 1, member([*kind, ("WARC-Segment-Number", number + 1), ("X-Running-Digest", f"sha1:{base32(self.running.digest())}"), *end, *common], part if number else http + part)


def records(page: int | None, url: str | None, payload: bytes, refers: int | None, row: str, chunk: int) -> Iterator[tuple[int, bytes]]:
    """The members of a payload that is at hand."""
    w = Writer(chunk)
    for number in range(1 if refers is not None else max(1, -(-len(payload) // chunk))):
        yield w.member(page, url, refers, len(payload), row, number, payload[number * chunk : (number + 1) * chunk], hashlib.sha1(payload).digest())


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, size and refers_to: the page that a page's payload is first found in, if that is another.

    The groups' exchange is by hash and length, the join's by hash: both sides of the join are then plain exchanges,
    and adaptive execution splits the partition of a payload that very many pages have.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.withColumns({"hash": F.unhex(F.sha2(payload, 256)), "size": F.octet_length(payload)})
    first = keyed.groupBy("hash", "size").agg(F.min("page_id").alias("first")).select("hash", "first")
    refers = F.when((F.col("size") >= least) & (F.col("first") != F.col("page_id")), F.col("first"))
    return keyed.join(first, "hash").select("page_id", "url", payload.alias("payload"), "size", refers.alias("refers_to"))


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """A row (page_id, url, refers_to, size, row, number, part, digest) for each chunk of a payload, in order; cut by Spark.

    Revisits have one row, without bytes but with the payload's digest, others as many as their chunks are.
    """
    again = F.col("refers_to").isNotNull()
    numbers = F.when(again | (F.col("size") <= chunk), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), ((F.col("size") - 1) / chunk).cast("int")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("*", F.explode(numbers).alias("number"))
    part = F.when(again, F.lit(b"")).when(F.col("size") <= chunk, F.col("payload")).otherwise(F.substr(F.col("payload"), F.col("number") * chunk + 1, F.lit(chunk)))
    digest = F.when(again, F.unhex(F.sha1("payload")))
    return rows.select("page_id", "url", "refers_to", "size", "row", "number", part.alias("part"), digest.alias("digest"))


def write(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) below path."""
    schema = pa.schema([("segmented", pa.int32()), ("member", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(chunk)
        out: list[tuple[int, bytes]] = []
        held = 0

        def told():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], schema=schema)

        for b in batches:
            for cells in zip(*b.columns, strict=True):
                page, url, refers, size, row, number, part, digest = (c.as_py() for c in cells)
                out.append(writer.member(page, url, refers, size, str(row), number, part, digest))
                held += len(out[-1][1])
                if held > 4 << 20:
                    yield told()
                    out, held = [], 0
        if out:
            yield told()

    made = chunked(with_first(pages, least), chunk).mapInArrow(tidy(work), "segmented int, member binary")
    made.select("segmented", F.col("member").cast("string").alias("value")).write.partitionBy("segmented").option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def _members(spark: SparkSession, path: str, segmented: int) -> DataFrame | None:
    """The members of one of the two folders; none if it wasn't written."""
    folder = f"{path}/segmented={segmented}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(folder)
    return text.select(F.col("value").cast("binary").alias("member"))


def _number(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def _checked(headers: dict[str, str], digest: bytes, size: int, told: int) -> str:
    found = base32(digest)
    if headers["warc-payload-digest"] != f"sha1:{found}" or size != told:
        raise ValueError(f"record {headers['warc-record-id']}: the payload is not what its header says")
    return found


def http_parts(block: bytes) -> tuple[int, bytes]:
    """Content-Length and payload (or its beginning) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1]), payload


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for m in b.column(0):
            headers, block = opened(m.as_py())
            told, payload = http_parts(block)
            if headers["warc-type"] == "revisit":
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
            else:
                digest = _checked(headers, hashlib.sha1(payload).digest(), len(payload), told)
            rows.append((_number(headers, "x-page-id"), told, digest, headers["warc-type"], _number(headers, "x-refers-to-page")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=pa.schema(_RESULT))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record, segment number and the member itself."""
    for b in batches:
        keys, numbers = [], []
        for m in b.column(0):
            headers, _ = opened(m.as_py())
            keys.append(headers["x-row"])
            numbers.append(int(headers["warc-segment-number"]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64()), b.column(0)], names=["record", "number", "member"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, record after record, under one running digest."""
    rows: list[tuple] = []
    digest, size, told, expected, page = hashlib.sha1(), 0, 0, 1, None
    for b in batches:
        for m in b.column(2):
            headers, block = opened(m.as_py())
            number = int(headers["warc-segment-number"])
            if number == 1:
                digest, size, expected, page = hashlib.sha1(), 0, 1, _number(headers, "x-page-id")
                told, block = http_parts(block)
            if number != expected:
                raise ValueError(f"record {headers['x-row']}: segment {expected} is missing")
            digest.update(block)
            if headers["x-running-digest"] != f"sha1:{base32(digest.digest())}":
                raise ValueError(f"record {headers['x-row']}: segment {number} is not what its header says")
            size, expected = size + len(block), expected + 1
            if "warc-segment-total-length" in headers:
                rows.append((page, size, _checked(headers, digest.digest(), size, told), "response", None))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=pa.schema(_RESULT))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record below path."""
    found = []
    if (members := _members(spark, path, 0)) is not None:
        found.append(members.mapInArrow(tidy(whole), _RESULT_SQL))
    if (members := _members(spark, path, 1)) is not None:
        parts = members.mapInArrow(tidy(numbered), "record string, number bigint, member binary")
        found.append(parts.repartition("record").sortWithinPartitions("record", "number").mapInArrow(tidy(joined), _RESULT_SQL))
    if not found:
        return spark.createDataFrame([], _RESULT_SQL)
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]
