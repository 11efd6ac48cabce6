"""WARC archives with an index, and range reads of the records that it selects."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.workspace import new_path, stored

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 1000

#: One read takes ranges with at most this many bytes between them, up to this many in all.
GAP, READ = 64 << 10, 4 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own, so that a reader can begin at it."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(url: str | None, page_id: int | None) -> str:
    clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return clean or f"urn:page:{'' if page_id is None else page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit whose block keeps only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to) if revisit else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _member(fields, http if revisit else http + payload)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block; raises ValueError where the member is damaged."""
    try:
        raw = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"damaged record: {e}") from e
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record is cut off")
    return fields, rest[:size]


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a WARC record for every row of ``page_id, url, html`` and return the index, itself a stored table.

    Of rows with equal payloads of at least 1000 bytes the largest ``page_id``
    is written as a response and the others as revisits of it; rows that repeat
    that id are responses too, and a null id, never the largest, is a revisit. A null
    html is an empty payload, a null url gets a URN of the id. No rows give an empty
    index; other columns are ignored.

    Each task writes one file under a name of its own, and only a task that ends
    well gets into the index, so files of failed or repeated tasks are never read.
    """
    folder = folder or new_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= LEAST_REVISIT)
    groups = large.groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("owner"), F.count("*").alias("_n")).where("_n > 1")
    # only the page rows may be skewed; the other side has each digest once, so adaptive execution can split
    typed = rows.join(groups.select("_digest", "owner"), F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                index = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    revisit = refers_to is not None
                    member = page_record(page_id, url, payload, digest, refers_to, revisit)
                    out.write(member)
                    index.append((page_id, url, name, at, len(member), digest, len(payload), "revisit" if revisit else "response", refers_to))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)
        if out is not None:
            out.close()

    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.string() if "string" in x else pa.int64() for x in INDEX.split(", ")]
    index = stored(spark, typed.mapInArrow(write, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read_records(spark: SparkSession, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records that the rows of ``index`` name, by sorted byte ranges.

    The index is range-partitioned by file and offset; neighbours are read at
    once where little lies between them. Checks every digest against the
    bytes read. Gives ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` and the payload (null for a revisit, whose size is its HTTP header's).
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def parse(member: bytes) -> tuple:
        fields, block = parse_record(member)
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of page {page} is not what its digest says")
        return None if page is None else int(page), fields["warc-target-uri"], size, digest, fields["warc-type"], None if to is None else int(to), None if revisit or not with_payload else payload

    def ranges(rows: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        own: list[tuple[int, int]] = []
        for at, n in rows:
            if own and (at - sum(own[-1]) > GAP or at + n - own[0][0] > READ):
                yield own
                own = []
            own.append((at, n))
        if own:
            yield own

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            begin = 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin]:
                    end += 1
                if files[begin] != name:
                    name = files[begin]
                    store, path = fs.FileSystem.from_uri(name)
                    stream = store.open_input_file(path)
                for own in ranges(list(zip(offsets[begin:end], lengths[begin:end], strict=True))):
                    first, last = own[0][0], sum(own[-1])
                    raw = stream.read_at(last - first, first)
                    found = [parse(raw[at - first : at - first + n]) for at, n in own]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)
                begin = end

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return wanted.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(spark, index, with_payload=False).drop("url", "payload")


OP6_SQL = """
WITH s AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS owner FROM s WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner IS DISTINCT FROM page_id AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM s LEFT JOIN o USING (payload_digest)
"""
