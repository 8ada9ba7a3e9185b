"""WARC archives: records in segments, written and read through Spark's own file commit.

Writing: a page's payload becomes an HTTP response in chunked transfer coding.
Blocks longer than ``segment`` bytes are cut into a first record and continuation
records that name the first (origin id), their number and, in the last, the total
length.  Records are named by the number of their row, so equal ids never meet; the
row's own id is a header.  Of records with equal payloads, the one with the smallest
id is a response and the others are revisits that refer to it.

Reading: each file is parsed once, by the declared lengths; continuations are grouped
by origin id, put in the order of their segment numbers, and the block's total length
is verified; HTTP headers are split off and the chunked framing is decoded; digests
are verified.  A revisit takes its payload's length and digest from the record that
it refers to.

Files are written as text lines ended by CRLF: a record is its own CRLF line, so
each file is a WARC file, compressed as a whole with gzip.  ``records_per_file`` bounds a file, and a file is
what one reading task holds at a time.

Defined results
* null html is the empty payload; empty payloads are equal like any others when
  ``min_revisit`` is 0.
* every row is a record, whether its id is null, unique or repeated; null ids sort
  last, and of rows with equal id and payload the first in the staged table responds.
* very long payloads span many segments; extra columns are ignored; an empty table
  gives an empty archive and an empty result.
* a wrong length, a missing segment, a bad chunk or a wrong digest raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from platlark.functions.shared import fresh_path, staged
from platlark.llm.joins import spread_join

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PAGE = "X-Page-ID"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    segment: int = 32_768
    chunk: int = 8_192
    min_revisit: int = 0
    records_per_file: int = 1000


class WarcError(ValueError):
    """An archive that contradicts itself."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_chunked(payload: bytes, size: int) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    """The payload; chunk extensions and trailers are left out."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size line is not ended")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError(f"bad chunk size {body[at:end][:20]!r}") from e
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk is shorter or longer than declared")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record up to the first of the two CRLF that end it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n"


def uri(row) -> str:
    return f"<urn:row:{row}>"


def _own(row, page, url: str | None) -> list[tuple[str, str]]:
    """Headers that every record of a row begins with, after its type."""
    named = [(PAGE, quote(str(page), safe=""))] if page is not None else []
    return [("WARC-Record-ID", uri(row)), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), *named]


def response_records(row, page, url: str | None, payload: bytes, sha: str, params: WarcParams) -> list[bytes]:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http + encode_chunked(payload, params.chunk)
    own = [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    headers = [("WARC-Type", "response"), *_own(row, page, url), *own]
    parts = [block[i : i + params.segment] for i in range(0, len(block), params.segment)]
    if len(parts) == 1:
        return [record(headers, block)]
    out = [record([*headers, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), *_own(f"{row}:{k}", page, url), ("WARC-Segment-Origin-ID", uri(row)), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, part))
    return out


def revisit_record(row, page, url: str | None, refers, sha: str) -> bytes:
    of = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", uri(refers)), ("WARC-Payload-Digest", f"sha1:{sha}")]
    return record([("WARC-Type", "revisit"), *_own(row, page, url), *of], b"")


def write(pages: DataFrame, path: str, row_id="page_id", url="url", html="html", params: WarcParams = WarcParams()) -> None:
    """Writes the archive of ``pages`` to ``path``."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(row_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    )
    rows = staged(rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload")), "pages", "zstd")
    keys = rows.select("row", "id", "sha", "size").filter(F.col("size") >= params.min_revisit)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row"))
    first = keys.groupBy("sha").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = staged(first.select("sha", F.col("f.row").alias("refers"), "n"), "first")
    again = spread_join(keys.select("row", "sha"), first, ["sha"], "n").filter(F.col("row") != F.col("refers"))
    rows = rows.join(again.select("row", "refers"), "row", "left").select("row", "id", "url", "payload", "sha", "refers")

    def run(batches):
        for b in (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            out = []
            for row, i, u, payload, sha, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = base64.b32encode(sha).decode()
                if refers is not None:
                    out.append(revisit_record(row, i, u, refers, name))
                else:
                    out += response_records(row, i, u, payload, name, params)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    text = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", params.records_per_file).text(path)


def parse(data: bytes):
    """(headers, block) of every record of a file."""
    at = 0
    while at < len(data):
        if data[at : at + len(VERSION)] != VERSION:
            raise WarcError(f"no record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at + len(VERSION) : end].decode().split("\r\n"))
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if len(block) != size or data[at - 4 : at] != b"\r\n\r\n":
            raise WarcError(f"record {headers.get('WARC-Record-ID')} has another length than it declares")
        yield headers, block


RECORD = (
    "record_id string, page string, kind string, url string, digest string, refers string, origin string, segment int, total long, "
    "block binary, payload binary, payload_bytes long"
)


def body_of(name: str, block: bytes, sha: str | None) -> bytes:
    """The payload of a whole response block, its framing decoded and its digest verified."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        body = decode_chunked(body)
    if sha is not None and sha != f"sha1:{digest(body)}":
        raise WarcError(f"{name}: the payload's digest is not {sha}")
    return body


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archive; ``block`` holds segments only, ``payload`` (if asked for) that of whole responses."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for data in b.column(0):
                for h, block in parse(gzip.decompress(data.as_py())):
                    get = h.get
                    total, segment, sha = get("WARC-Segment-Total-Length"), get("WARC-Segment-Number"), get("WARC-Payload-Digest")
                    name, kind, page = h["WARC-Record-ID"], h["WARC-Type"], get(PAGE)
                    body = body_of(name, block, sha) if kind == "response" and segment is None else None
                    rows.append((
                        name, page if page is None else unquote(page), kind, get("WARC-Target-URI"), sha, get("WARC-Refers-To"),
                        get("WARC-Segment-Origin-ID"), segment and int(segment), total and int(total), block if segment else None,
                        body if payloads else None, None if body is None else len(body),
                    ))
                    held += len(block)
                    if held > 4_000_000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """(record_id, page, url, digest, payload, payload_bytes) of every response, its segments put together and verified."""
    names = ["record_id", "page", "url", "digest", "payload", "payload_bytes"]
    whole = records.filter("kind = 'response' and segment is null").select(*names)
    cut = records.filter("kind = 'continuation' or (kind = 'response' and segment is not null)")
    key: Column = F.coalesce("origin", "record_id")
    joined = cut.groupBy(key.alias("record_id")).agg(
        F.max("page").alias("page"),
        F.max("url").alias("url"),
        F.max("digest").alias("digest"),
        F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
    )

    def run(batches):
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            (name,), (sha,), (parts,) = (b.column(k).to_pylist() for k in (0, 3, 4))
            block = b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise WarcError(f"{name}: segments {[p['segment'] for p in parts]}")
            if len(parts) > 1 and parts[-1]["total"] != len(block):
                raise WarcError(f"{name}: {len(block)} bytes, {parts[-1]['total']} declared")
            body = body_of(name, block, sha)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(4)), pa.array([body if payloads else None], pa.binary()), pa.array([len(body)], pa.int64())], names
            )

    schema = "record_id string, page string, url string, digest string, payload binary, payload_bytes long"
    return whole.union(joined.mapInArrow(run, schema))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page, payload_bytes, payload_digest, record_type, refers_to) of every row of the archive; pages as strings."""
    records = staged(read_records(spark, path, payloads=False), "records")
    done = reassemble(records, payloads=False).select("record_id", "page", "payload_bytes", F.substring("digest", 6, 32).alias("payload_digest"))
    again = records.filter("kind = 'revisit'").select("record_id", "page", "refers")
    asked = again.groupBy("refers").agg(F.count(F.lit(1)).alias("n"))
    to = done.withColumnsRenamed({"record_id": "refers", "page": "refers_to"})
    seen = spread_join(again, staged(asked.join(to, "refers"), "asked"), ["refers"], "n")
    return done.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to")).union(
        seen.select("record_id", "page", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to")
    )


def round_trip(pages: DataFrame, row_id="page_id", url="url", html="html", params: WarcParams = WarcParams()) -> DataFrame:
    """Writes ``pages`` to an archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, row_id, url, html, params)
    kind = pages.schema[row_id].dataType
    return summary(spark, path).select(
        F.col("page").cast(kind).alias(row_id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
