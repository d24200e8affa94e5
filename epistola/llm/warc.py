"""WARC archives by a deterministic sharded writer.

Each record is compressed on its own. Records are dealt out by ranges of page_id of about RANGE_BYTES of payload, put in
order, and a range is cut into files by compressed size. Bounds are exact sums over a grid of page_id, so which files there
are and each of their bytes follow from the pages alone, not from how these lie in partitions or when tasks ran. A file is
written under a temporary name and moved to its final one; a manifest that lists the files with their sizes and digests
commits the archive. Readers take only what the manifest lists.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from epistola.llm import _files
from epistola.llm._store import Filter, among, bucket_of, drop, keep, new_dir, partitions, range_bounds, small_batches

#: Payloads shorter than this are stored again each time.
LEAST = 100
#: Bytes of payload in a range of pages, and parts that a range of one page_id is cut into.
RANGE_BYTES, PARTS = 16 << 20, 64
#: Bytes of an archive that are decompressed at a time.
STEP = 16 << 10
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs in RFC 4122


def _record_id(page_id: int | None, url: str | None, digest: str, again: int = 0) -> str:
    """An id that follows from the row; of rows that are equal in all, `again` counts those before."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{digest}|{again}')}>"


def _line(text: str) -> str:
    """A header value stays on one line."""
    return " ".join(text.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: int = 0, first_url: str | None = None) -> bytes:
    """One record as a gzip member. A revisit carries the digest of the full payload and its length, not the payload, and names the record it refers to, which is of page refers_to and first_url."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, url, digest, again)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, first_url, digest)}", f"WARC-Refers-To-Target-URI: {_line(first_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    return _gzip(("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n")


def _gzip(data: bytes) -> bytes:
    """A member without time or name, so equal data give equal bytes."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _renamed(data: bytes, again: int) -> bytes:
    """The record of a row that is equal in all to `again` rows before it: the same but for its id."""
    plain = zlib.decompress(data, 31)
    head, end, rest = plain.partition(b"\r\n\r\n")
    lines = [x if not x.startswith(b"WARC-Record-ID: ") else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, x.decode() + f'|{again}')}>".encode() for x in head.split(b"\r\n")]
    return _gzip(b"\r\n".join(lines) + end + rest)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file. A member that ends early raises. Bytes are taken a step at a time, as what lies behind a member is copied."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            step = view[at : at + STEP]
            if not step:
                raise ValueError("a record ends in mid-stream")
            parts.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        plain = b"".join(parts)
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write(pages: DataFrame, to: str, file_bytes: int = 8 << 20) -> str:
    """Writes the pages (page_id, url, html) to the folder `to` and returns the manifest's path.

    Of equal payloads of at least 100 bytes, those of the smallest page_id are responses and the rest revisits of it; null
    ids count as the largest and are revisits of a row with an id, if there is one. Null html is an empty payload. A file
    holds at most file_bytes, or one record; rows that repeat are records of their own. No rows give an empty manifest.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    # Only ids and digests are gathered; partial sums are made before the shuffle, so a payload that is everywhere is one row a task.
    # Ids of 2**63 - 1 stand for null ones, so that any other is smaller.
    least = F.min(F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("page_id"), "url"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).where(F.octet_length("html") >= LEAST).groupBy(F.sha2("html", 256).alias("digest")).agg(least.alias("f"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first", F.col("f.url").alias("first_url"))
    seen, seen_path = keep(seen, "warc-seen")
    bounds, heavy = range_bounds(pages, "page_id", F.octet_length(html) + 500, RANGE_BYTES)
    rows = rows.withColumn("part", F.when(among(F.col("page_id"), heavy), F.pmod(F.xxhash64("digest", "url"), F.lit(PARTS))).otherwise(0).cast("int"))
    # Only payloads that may be repeated are dealt out to find the page they repeat.
    other, single = Filter(seen, F.xxhash64("digest")).split(rows, F.xxhash64("digest"))
    single = single.withColumns({"refers_to": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    other = other.join(seen, "digest", "left")
    other = other.withColumn("refers_to", F.when(F.col("first") != F.coalesce(F.col("page_id"), F.lit(2**63 - 1)), F.col("first"))).drop("first")
    rows = single.unionByName(other)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url, body, digest, refers, first = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "first_url"))
            data = [record(p, u, h.encode(), d, r, first_url=f) for p, u, h, d, r, f in zip(page, url, body, digest, refers, first)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("part"), pa.array(data, pa.binary())], ["page_id", "part", "data"])

    made = rows.mapInArrow(squeeze, "page_id long, part int, data binary").withColumn("piece", bucket_of(F.col("page_id"), bounds))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece come together and in order; a file's are held until it is whole, which is bounded by its size."""

        def close(piece: tuple[int, int], number: int, parts: list[bytes]) -> pa.RecordBatch:
            name, digest = f"part-{piece[0]:06d}-{piece[1]:02d}-{number:06d}.warc.gz", hashlib.sha256()
            for x in parts:
                digest.update(x)
            _files.put(to, name, parts)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(map(len, parts))], pa.int64()), pa.array([len(parts)], pa.int64()), pa.array([digest.hexdigest()])], ["name", "bytes", "records", "sha256"])

        now, number, size, parts, last, again = None, 0, 0, [], None, 0
        for batch in batches:
            for *piece, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "data"))):
                piece = tuple(piece)
                again = again + 1 if (piece, data) == (now, last) else 0
                last = data
                if again:
                    data = _renamed(data, again)
                if parts and (piece != now or size + len(data) > file_bytes):
                    yield close(now, number, parts)
                    number, size, parts = number + 1 if piece == now else 0, 0, []
                now, size = piece, size + len(data)
                parts.append(data)
        if parts:
            yield close(now, number, parts)

    # The one time that records are dealt out.
    tasks = len(bounds) + 1
    dealt = made.repartitionById(tasks, F.pmod(F.col("piece") + F.col("part"), F.lit(tasks))).sortWithinPartitions("piece", "part", F.col("page_id").asc_nulls_first(), "data")
    listed = dealt.mapInArrow(store, "name string, bytes long, records long, sha256 string")
    manifest = f"{to}/manifest"
    with small_batches(spark):
        listed.write.parquet(manifest)
    drop(spark, seen_path)
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record that the manifest lists.

    Sizes and digests are worked out anew from the blocks of responses and held against the headers; a file that is
    missing or differs from the manifest, or a record that differs from its headers, raises.
    """
    listed = spark.read.schema("name string, bytes long, records long, sha256 string").parquet(f"{folder}/manifest")

    def open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _files._open(_files.normal(folder))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for name, digest in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist()):
                with where.open_input_stream(f"{path}/{name}", compression=None) as file:
                    data = file.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                rows = [_checked(fields, block) for fields, block in parse(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    return listed.repartition(partitions(spark), "name").mapInArrow(open_files, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def _checked(fields: dict[str, str], block: bytes) -> tuple:
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("a block differs from its digest")
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError("a payload differs from its header")
    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
    return int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"]


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as WARC to the shared folder and reads them back."""
    spark = pages.sparkSession
    to = new_dir(spark, "warc")
    write(pages, to)
    return read(spark, to)
