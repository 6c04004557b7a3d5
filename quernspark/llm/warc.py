"""WARC archives: one gzip member a record, written and read by the partition.

Writing: each task writes one archive to the shared folder, under a name of its own, and moves it
into place when it is whole, so that a repeated task replaces it by the same bytes. Of records
with equal payloads of at least REVISIT_BYTES, the one with the smallest id is a response, the
others are revisit records, which carry the HTTP header but no payload.

Reading: a sequential reader takes the file in blocks, inflates one member at a time with an
incremental decompressor, frames the record by its Content-Length and checks its digests. Memory
holds one record and one block, whatever the size of the archive; a record may have MOST bytes.

Defined cases: a null payload is empty; a null id gives a record without one; rows that repeat an
id are repeated records; an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frame_of, shared_dir, stash, whole_number

REVISIT_BYTES, BLOCK, STEP, MOST = 100, 1 << 20, 1 << 14, 1 << 31
DATE = "1970-01-01T00:00:00Z"  # archives depend on their input alone
RECORD = "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The HTTP header of a revisit keeps the length of the payload it stands for."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {target}"] * bool(target)
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, block: int = BLOCK, most: int = MOST) -> Iterator[bytes]:
    """The inflated members of a gzip stream, one after the other; one of more than most bytes raises."""
    z, out, held, begun = zlib.decompressobj(31), [], 0, False
    while data := stream.read(block):
        at = 0
        while at < len(data):  # in small steps: what follows a member is copied once a step
            part = data[at : at + STEP]
            out.append(z.decompress(part, most - held + 1))
            held, begun = held + len(out[-1]), True
            if held > most:
                raise ValueError("a record is larger than it may be")
            at += len(part) - len(z.unused_data)
            if z.eof:
                yield b"".join(out)
                z, out, held, begun = zlib.decompressobj(31), [], 0, False
    if begun:
        raise ValueError("the archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block), framed by Content-Length; wrong frames and digests raise."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["warc-block-digest"]:
        raise ValueError("a block has another digest")
    return fields, block


def read_record(data: bytes) -> dict:
    fields, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload has another digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kept = payload if kind == "response" else None
    return dict(zip(NAMES, (number("warc-record-id"), fields.get("warc-target-uri"), kept, length, digest, kind, number("warc-refers-to"))))


def write_archives(pages: DataFrame, key="page_id", url="url", payload="html", path: str | None = None) -> DataFrame:
    """Write all rows; (archive, records) of each archive. Payloads are shuffled once at most, by digest."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    first = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    first = stash(first.where("n > 1 and first is not null").drop("n"), "warc")
    rows = rows.join(first, "digest", "left")  # a digest with very many rows is split by adaptive execution
    # ids go to Python as text: pandas would make floats of a column of numbers with nulls
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select(F.col("key").cast("string").alias("key"), "url", "payload", "digest", refers.cast("string").alias("refers"))

    def write(batches):
        target, base = fs.FileSystem.from_uri(path)
        target.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, n = f"{base}/part-{part:06d}.warc.gz", 0
        with target.open_output_stream(f"{name}.{attempt}.tmp", compression=None) as out:
            for pdf in batches:
                for k, u, body, digest, refers in zip(*(pdf[c] for c in ("key", "url", "payload", "digest", "refers"))):
                    out.write(gzip_member(record_bytes(whole_number(k), u, bytes(body), digest, whole_number(refers))))
                    n += 1
        target.move(f"{name}.{attempt}.tmp", name)
        yield pd.DataFrame({"archive": [f"{path}/part-{part:06d}.warc.gz"], "records": [n]})

    return stash(rows.mapInPandas(write, "archive string, records long"), "warc")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the files in column archive, an archive to a task."""

    def read(batches):
        for pdf in batches:
            for name in pdf["archive"]:
                source, file = fs.FileSystem.from_uri(name)
                with source.open_input_stream(file, compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        rows.append(read_record(data))
                        held += len(data)
                        if not with_payload:
                            rows[-1]["payload"] = None
                        if held > 8 << 20 or len(rows) == 2000:
                            yield frame_of(rows, RECORD)
                            rows, held = [], 0
                    if rows:
                        yield frame_of(rows, RECORD)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInPandas(read, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = read_archives(archives, with_payload=False)
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""
