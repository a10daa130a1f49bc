"""WARC archives: write captures, read them back and join the records of a capture through concurrent-to ids."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads under so many bytes are never revisits.
REVISIT_BYTES = 100
#: Groups of equal payloads are broadcast up to so many rows (about 80 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Compressed bytes after which a task starts another archive file.
FILE_BYTES = 32 << 20
#: Compression level of a record; records are short, so higher ones gain little.
LEVEL = 2
#: Bytes of an archive that are inflated at once.
CHUNK = 1 << 14
#: Copies of a repeated row that one task writes at most.
COPIES = 1_000
EPOCH = "2024-01-01T00:00:00Z"

RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, block_digest string, fields map<string,string>, payload binary"


def _uuid(kind: str, first: bool = False) -> Column:
    """A record id from the kind, the id, payload and url of the row and its number among equal rows; first: of the response that a revisit refers to."""
    page, url, copy = (F.col("first.page_id"), F.col("first.url"), F.lit(0)) if first else (F.col("page_id"), F.coalesce("url", F.lit("")), F.col("copy"))
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), F.col("digest"), copy.cast("string"), url))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, more: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record. Fields whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(EPOCH)), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block, F.lit("\r\n\r\n"))


_NOTHING = gzip.compress(b"", mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records -> one gzip member each, without its last zero byte, and the number of the task's file.

    The last byte of a member is zero for records under 16 MB; a longer one is followed by an empty member.
    """
    held = 0
    for b in batches:
        out, files = [], []
        for record in b.column(0):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = packer.compress(record.as_buffer()) + packer.flush()
            data += _NOTHING if data[-1] else b""
            out.append(data[:-1])
            files.append(held // FILE_BYTES)
            held += len(data)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], ["value", "file"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write request, response (or revisit) and metadata records of every page to archives under path, a gzip member each.

    Of pages with equal payloads of REVISIT_BYTES or more, the one with the smallest id is the response and the
    others are revisits of it, without payload; rows that share that id are all responses, null ids among
    themselves too. A null payload is empty, a null url has no target URI, line breaks in a url are
    percent-encoded. Null ids come after all others. Rows that repeat id, url and payload are captures of their own,
    told apart by a number. An empty table writes no record. Payloads of rows that occur once are not shuffled
    unless there are over BROADCAST_ROWS groups of equal payloads or of repeated rows.
    """
    common.small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("row", F.xxhash64("page_id", "url", "digest"))
    counts = common.cut(rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    counts = common.small(counts, BROADCAST_ROWS)
    # repeated rows are combined to one and written as often as they came
    again = rows.join(counts, "row", "left_semi").groupBy("page_id", "url", "digest").agg(F.count(F.lit(1)).alias("n"), F.any_value("html").alias("html"))
    again = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES)))).repartition("digest", "part")
    copies = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1))
    again = again.select("page_id", "url", "html", "digest", copies.alias("copy"))
    rows = rows.join(counts, "row", "left_anti").select("page_id", "url", "html", "digest", F.lit(0).cast("long").alias("copy")).unionByName(again)
    rows = rows.withColumn("bytes", F.octet_length("html"))
    # the smallest id, and the least url that goes with it, name the response
    own = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    groups = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first"))
    groups = common.cut(groups.filter("n > 1").drop("n"), "payloads")
    rows = rows.join(common.small(groups, BROADCAST_ROWS), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = rows.withColumn("is_revisit", revisit).withColumn("own_id", _uuid("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    uri, payload = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    profile = F.when(F.col("is_revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(F.col("is_revisit"), _uuid("response", first=True))
    records = F.array(
        _record("request", _uuid("request"), [("WARC-Concurrent-To", F.col("own_id")), uri], "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))),
        _record(F.when(F.col("is_revisit"), "revisit").otherwise("response"), F.col("own_id"), [uri, payload, ("WARC-Refers-To", refers), ("WARC-Profile", profile)], "application/http; msgtype=response", F.concat(http, F.when(F.col("is_revisit"), "").otherwise(F.col("html")))),
        _record("metadata", _uuid("metadata"), [("WARC-Concurrent-To", F.col("own_id")), uri], "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\n"))),
    )
    packed = rows.select(F.explode(records).alias("value")).select(F.col("value").cast("binary")).mapInArrow(_members, "value binary, file int")
    packed.select(F.col("value").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


def _parse(data: bytes, whole: bool = True) -> Iterator[tuple]:
    """Records of a stretch of an archive with the places where they end, cut by their lengths alone.

    ValueError on a damaged record; unless data is whole, a record at its end that is not complete is left out.
    """
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0 and not whole:
            return
        if not data.startswith(b"WARC/", at) or head_end < 0:
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        start = head_end + 4
        end = start + int(fields["content-length"])
        if len(data) < end + 4 and not whole:
            return
        block = data[start:end]
        if len(block) < end - start or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        kind = fields.get("warc-type")
        if kind in ("response", "revisit", "request"):
            payload = block[block.find(b"\r\n\r\n") + 4 :]
        else:
            payload = block
            for line in block.decode("utf-8", "replace").split("\r\n"):
                key, found, value = line.partition(":")
                if found:
                    fields[key.strip().lower()] = value.strip()
        at = end + 4
        yield at, (kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), list(fields.items()), payload)


def _records(data: bytes) -> Iterator[tuple]:
    """Records of an archive file, plain or of any gzip members; one member is inflated at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from (row for _, row in _parse(data))
        return
    rest, view, at = b"", memoryview(data), 0
    while at < len(view):
        # fed in small chunks, since what follows a member is copied when the member ends
        member, parts = zlib.decompressobj(31), [rest]
        while not member.eof:
            chunk = view[at : at + CHUNK]
            if not len(chunk):
                raise ValueError("the last gzip member is cut short")
            parts.append(member.decompress(chunk))
            at += len(chunk)
        at -= len(member.unused_data)
        rest, done = b"".join(parts), 0
        for done, row in _parse(rest, whole=False):
            yield row
        rest = rest[done:]
    if rest:
        raise ValueError("the last record is cut short")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.binary()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(RECORDS.split(", "), kinds, strict=True)])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
    for b in batches:
        for data in b.column("content"):
            rows, held = [], 0
            for row in _records(data.as_py()):
                rows.append(row)
                held += len(row[-1])
                if held > 4 << 20 or len(rows) >= 5000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path, plain or gzip: type, ids, target, digest, fields and payload.

    A file is one task's work, so archives should stay under some hundred MB.
    """
    common.small_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_reader, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, response, request, metadata and payload.

    The capture's id is that of its response or revisit; request and metadata name it as concurrent-to. The three
    kinds meet in one shuffle on that id, so no capture is large. Requests or metadata without a response give
    a row with a null response. Of several records of a kind in a capture, the one with the smallest id counts.
    """
    capture = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    body = F.struct("record_id", "record_type", "refers_to", "block_digest", "fields", "payload")
    of = lambda kinds: F.min_by(F.when(F.col("record_type").isin(*kinds), body), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))
    return (
        records.withColumn("capture", capture)
        .filter("capture is not null")
        .groupBy("capture")
        .agg(F.max("target_uri").alias("target_uri"), of(["response", "revisit"]).alias("response"), of(["request"]).alias("request"), of(["metadata"]).alias("metadata"))
    )


def captures(spark: SparkSession, path: str, with_capture: bool = True) -> DataFrame:
    """assemble() with revisits resolved: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if with_capture, capture (the nested row).

    A revisit takes length and digest of the payload from the response that it refers to; refers_to is that
    response's page id.
    """
    whole = assemble(read(spark, path))
    page = F.expr("try_cast(metadata.fields['page-id'] as bigint)")
    own = whole.select(
        F.col("capture").alias("capture_id"), page.alias("page_id"), F.col("target_uri").alias("url"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("refers_id"),
        F.octet_length("response.payload").cast("long").alias("bytes"), F.sha2("response.payload", 256).alias("digest"), *[F.struct("response", "request", "metadata").alias("capture")] * with_capture,
    )
    own = common.cut(own, "captures")
    referred = own.filter("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("first_page"), F.col("bytes").alias("first_bytes"), F.col("digest").alias("first_digest"))
    is_revisit = F.col("record_type") == "revisit"
    return own.join(referred, "refers_id", "left").select(
        "page_id", "url", "record_type",
        F.when(is_revisit, F.col("first_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(is_revisit, F.col("first_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(is_revisit, F.col("first_page")).alias("refers_to"),
        *["capture"] * with_capture,
    )
