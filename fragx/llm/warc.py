"""WARC archives: records in segments, chunked transfer framing, revisits; and reassembly of what was written.

Archives are plain text files whose record terminator is the line separator
of Spark's text sink, so records are built from column expressions and any
store that Spark reaches will do. A file holds a bounded number of records of
bounded size, hence a task reads bounded files.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fragx.llm.common import stored
from fragx.session import ensure_checkpoint_dir

CRLF = "\r\n"
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_A_FILE = 4_096
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, payload_bytes, refers_to): of equal payloads the largest page_id is the response.

    Payloads are equal if digest and length are. Groups are counted with
    map-side combine and only those with copies are joined back, each repeated
    over salts, so one payload in a third of all rows is spread.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    long_enough = F.col("payload_bytes") >= least
    copies = base.filter(long_enough).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = copies.filter("_n > 1").select("digest", "payload_bytes", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = base.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(copies, ["digest", "payload_bytes", "_salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", refers.alias("refers_to"))


def _chunked(payload: Column, size: int) -> Column:
    """Binary payload in chunks, each behind its length in hex, and the last chunk of length 0."""
    length = F.octet_length(payload)
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    framed = F.transform(starts, lambda s: F.concat(
        F.lower(F.hex(F.least(F.lit(size), length - s).cast("long"))).cast("binary"), F.lit(CRLF).cast("binary"),
        F.substring(payload, s + 1, F.lit(size)), F.lit(CRLF).cast("binary"),
    ))
    return F.concat(F.aggregate(framed, F.lit("").cast("binary"), lambda a, b: F.concat(a, b)), F.lit(f"0{CRLF}{CRLF}").cast("binary"))


def records(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per WARC record (column ``value``): responses, revisits, and continuations of long responses."""
    number = F.monotonically_increasing_id()  # archives are written once, so the number need not be the same in a second run
    rows = with_revisits(pages).withColumn("_id", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">")))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}").cast("binary")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, _chunked(F.col("html").cast("binary"), chunk_bytes)))
    rows = rows.withColumn("_block", block).withColumn("_total", F.octet_length("_block"))
    starts = F.sequence(F.lit(0), F.col("_total") - 1, F.lit(segment_bytes))
    rows = rows.select("*", F.posexplode(starts).alias("_seg", "_at"))
    part = F.substring(F.col("_block"), F.col("_at") + 1, F.lit(segment_bytes))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    segmented = F.col("_total") > segment_bytes
    first = F.col("_seg") == 0

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    empty = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(first, F.col("_id")).otherwise(F.concat(F.regexp_replace("_id", ">$", ""), F.lit(":"), (F.col("_seg") + 1).cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(empty),
        F.when(revisit & first, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(empty),
        F.when(segmented, line("WARC-Segment-Number", (F.col("_seg") + 1).cast("string"))).otherwise(empty),
        F.when(segmented & ~first, line("WARC-Segment-Origin-ID", F.col("_id"))).otherwise(empty),
        F.when(segmented & (F.col("_at") + segment_bytes >= F.col("_total")), line("WARC-Segment-Total-Length", F.col("_total").cast("string"))).otherwise(empty),
        F.when(first, line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(empty),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, part.cast("string")).alias("value"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write compressed archives; the text sink ends each record with the two line breaks that WARC asks for."""
    out = records(pages, segment_bytes, chunk_bytes).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", RECORDS_A_FILE)
    out.option("compression", "gzip").text(path)


def parse(data: bytes):
    """The records of an archive: headers (lower-case names) and block, by their Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at}: the block does not end after {size} bytes")
        yield headers, data[start : start + size]
        at = start + size + 4


def dechunk(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions are skipped, a missing last chunk is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


RECORD = "origin string, record_type string, segment int, total long, digest string, refers_to long, block binary"


def read_records(files: DataFrame) -> DataFrame:
    """The records of archives given as rows of the binary file source."""

    def run(batches):
        import gzip

        for batch in batches:
            for content in batch.column("content"):
                data = gzip.decompress(content.as_py())
                rows = []
                for headers, block in parse(data):
                    refers = headers.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
                    rows.append((
                        headers.get("warc-segment-origin-id") or headers["warc-record-id"], headers["warc-type"],
                        int(headers.get("warc-segment-number", 0)), int(headers.get("warc-segment-total-length", -1)),
                        headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(refers) if refers else None, block,
                    ))
                    if len(rows) == 256:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return files.select("content").mapInArrow(run, RECORD)


def _records(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in RECORD.split(", ")])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, in order of their number, checked against the total length.

    Only segmented records are shuffled; a group is one record. A missing
    segment or a wrong total stops the job: archives are never read in part.
    """
    whole = records.filter("segment = 0").select("origin", "record_type", "digest", "refers_to", "block")
    parts = records.filter("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("_parts"), F.max("total").alias("_total"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"), F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"),
    )
    block = F.aggregate("_parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["block"]))
    right = (F.octet_length(block) == F.col("_total")) & (F.element_at("_parts", -1)["segment"] == F.size("_parts")) & F.col("record_type").isNotNull()
    checked = F.when(right, block).otherwise(F.raise_error(F.concat(F.lit("segments of "), F.col("origin"), F.lit(" do not make up its total length"))).cast("binary"))
    return whole.unionByName(parts.select("origin", "record_type", "digest", "refers_to", checked.alias("block")))


def read_archives(spark, path: str) -> DataFrame:
    """One row per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is decoded from its chunks and checked against the digest in
    its header. A revisit has the digest of its header and the bytes of the
    response it refers to.
    """
    files = spark.read.format("binaryFile").load(path)
    shape = reassemble(read_records(files))

    def decode(batches):
        for batch in batches:
            pages, sizes, digests = [], [], []
            columns = (batch.column(n) for n in ("origin", "record_type", "digest", "block"))
            for origin, kind, digest, block in zip(*columns):
                page = origin.as_py().split(":")[2]
                pages.append(int(page) if page else None)
                digests.append(digest.as_py())
                if kind.as_py() == "revisit":
                    sizes.append(None)
                    continue
                payload = payload_of(block.as_py())
                if hashlib.sha1(payload).hexdigest() != digest.as_py():
                    raise ValueError(f"payload of {origin} does not match its digest")
                sizes.append(len(payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pages, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column("record_type"), batch.column("refers_to")],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    pages = stored(shape.mapInArrow(decode, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    revisits = pages.filter("record_type = 'revisit'").drop("payload_bytes")
    referred = pages.filter("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi")
    sizes = referred.groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    sizes = sizes.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    filled = revisits.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(sizes, ["refers_to", "payload_digest", "_salt"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pages.filter("record_type = 'response'").select(columns).unionByName(filled.select(columns))


def archive_and_read(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write every page to archives in the shared folder and read them back.

    A null html is an empty payload, a null url an empty target. Equal rows
    with the largest page_id of their payload are all responses. A null
    page_id is kept; it is a revisit if a copy has an id. Columns beyond
    page_id, url and html are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, segment_bytes, chunk_bytes)
    return read_archives(spark, path)
