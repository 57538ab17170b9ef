"""WARC archives: a record per page, gzip member by gzip member, and a splittable reader of byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: A payload below so many bytes is stored again instead of revisited.
REVISIT_BYTES = 100
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18
PARTS = 32
#: Repeated digests, about 100 bytes each, that are sent to all tasks.
FEW = 200_000
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The path's file system as Arrow has it (local, hdfs, s3, gs), and the path within."""
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record as a gzip member of its own. A revisit has no payload but the digest and the length of it."""
    name = "" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {re.sub(r'\s', '%20', url or '')}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", f"Content-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + pack.flush()


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, first (the smallest page_id with an equal payload, null if it is short or the only
    one). Equal payloads are found from ids and digests alone, pre-aggregated. Up to FEW repeated digests, counted, go to
    all tasks and no payload moves; more meet the rows in PARTS parts, so one page that is stored very often is spread, and
    short ones, which have no first, by a key of their own."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    parts = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "part").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = parts.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("part").alias("part")).filter("n > 1")
    firsts = materialize(firsts.select(F.col("digest").alias("key"), "first", F.col("part").alias("parts")), "firsts")
    if firsts.count() <= FEW:
        return rows.withColumn("key", F.when(F.col("size") >= REVISIT_BYTES, F.col("digest"))).join(F.broadcast(firsts.select("key", "first")), "key", "left")
    own = F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("short:"), F.xxhash64("page_id", "url").cast("string")))
    return rows.withColumn("key", own).join(firsts.select("key", "first", F.explode("parts").alias("part")), ["key", "part"], "left")


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a task and returns (path, size, records) of each. The list is stored, so archives of attempts that did
    not count are never read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        where.create_dir(base)
        path, size, n, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, payload, digest, length, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "first")), strict=True):
                revisit = first is not None and first != page_id
                member = record(page_id, url, b"" if revisit else payload.encode(), digest, length, first, revisit)
                out = out or where.open_output_stream(path, compression=None)
                out.write(member)
                size, n = size + len(member), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    columns = plan.select("page_id", "url", "payload", "digest", "size", "first")
    return materialize(columns.mapInArrow(write, "path string, size long, records long"), "archives")


class _Window:
    """Bytes of a file from a position on, fetched as they are needed; only the part still needed is kept."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start, self.data, self.end = file, start, b"", False
        file.seek(start)

    def fetch(self, upto: int) -> None:
        while not self.end and self.start + len(self.data) < upto:
            got = self.file.read(READ_BYTES)
            self.end = not got
            self.data += got

    def forget(self, upto: int) -> None:
        self.data, self.start = self.data[upto - self.start :], upto


def _unpacked(window: _Window, at: int, forget: bool) -> Iterator[tuple[bytes, int]]:
    """Parts of at most READ_BYTES of the gzip member at this position, and the position after what they took; the last
    part has the member's end. What is read is kept unless forget. Raises zlib.error where no member is."""
    unpack, rest = zlib.decompressobj(31), b""
    while not unpack.eof:
        if not rest:
            window.fetch(at + READ_BYTES)
            rest = window.data[at - window.start :][: READ_BYTES if forget else 4096]
            if not rest:
                raise zlib.error("an archive ends within a record")
            at += len(rest)
        text = unpack.decompress(rest, READ_BYTES)
        rest = unpack.unconsumed_tail
        if unpack.eof:
            at -= len(unpack.unused_data)
        if forget and not rest:
            window.forget(at)
        yield text, at


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)


def _header(window: _Window, at: int) -> dict[str, str] | None:
    """The WARC header of the gzip member at this position, however long; None if no such member starts here, which the
    first bytes mostly tell."""
    head = b""
    try:
        for text, _ in _unpacked(window, at, False):
            seen = max(0, len(head) - 3)
            head += text
            if head[:7] != b"WARC/1."[: len(head[:7])]:
                return None
            if (end := head.find(b"\r\n\r\n", seen)) >= 0:
                return _fields(head[:end])
    except zlib.error:
        pass
    return None


def _member(window: _Window, at: int) -> tuple[hashlib._hashlib.HASH, int, int]:
    """Digest and length of the member's payload and the position after the member, in memory bounded but for the header."""
    digest, size, head, tail, passed = hashlib.sha256(), 0, b"", b"", False
    for text, after in _unpacked(window, at, True):
        at = after
        if not passed:
            seen = max(0, len(head) - 3)
            head += text
            if (end := head.find(b"\r\n\r\n", seen)) < 0:
                continue
            text, passed = head[end + 4 :], True
        text = tail + text
        tail = text[-4:]  # the record's closing line ends are not payload
        digest.update(text[:-4])
        size += len(text[:-4])
    return digest, size, at


def read_range(path: str, start: int, stop: int) -> Iterator[tuple]:
    """The records whose member starts in [start, stop): every gzip magic there is a candidate, which counts if it
    unpacks to a WARC header; the last record is read to its end, beyond stop if need be."""
    where, base = file_system(path)
    with where.open_input_file(base) as file:
        window, at = _Window(file, start), start
        while at < stop:
            window.fetch(at + READ_BYTES)
            found = window.data.find(MAGIC, at - window.start)
            if found < 0:
                at = max(at, window.start + len(window.data) - 2)
                if window.end:
                    return
                window.forget(at)
                continue
            at = window.start + found
            if at >= stop:
                return
            header = _header(window, at)
            if header is None:
                at += 1
                continue
            digest, size, at = _member(window, at)
            own = header["WARC-Record-ID"][len("<urn:page:") : -1]
            stored = header["WARC-Payload-Digest"].removeprefix("sha256:")
            revisit = header["WARC-Type"] == "revisit"
            if not revisit and digest.hexdigest() != stored:
                raise ValueError(f"the payload of page {own} does not have its digest")
            yield int(own) if own else None, int(header["WARC-Payload-Length"]) if revisit else size, stored, header["WARC-Type"], int(header["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of archives (path, size); each byte range is a row of its own, so that ranges spread over tasks."""
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1)
    ranges = ranges.repartition(int(min(tasks, 10_000)), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = list(read_range(path, start, start + split_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return ranges.mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and reads them back.

    Null html is an empty payload, a null url an empty one. Of equal payloads of REVISIT_BYTES or more the smallest
    page_id is the response; rows that repeat it are responses too; a row with a null page_id revisits it. No pages give
    no archives and no rows. That as many records are read as were written is checked."""
    spark: SparkSession = pages.sparkSession
    archives = write_archives(plan_records(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back = materialize(read_archives(archives, split_bytes), "records")
    written, read = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], back.count()
    if written != read:
        raise ValueError(f"{written} records were written and {read} read")
    return back
