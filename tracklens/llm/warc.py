"""WARC archives: written by Spark's text writer, assembled into captures by joins.

A page is three records: a request, a response (or a revisit, if another capture has the same
payload) and a metadata record. The request and the metadata name the capture record they
belong to in ``WARC-Concurrent-To``; a revisit names its response in ``WARC-Refers-To``.
Reading joins the records on these identifiers into one nested row per capture.

An archive has a warcinfo record, in a file of its own, and every other record names it in its second line. Its UUID is
drawn when the archive is written, after all payloads are fixed, so that no payload holds it: in an
archive of this kind the two lines are a mark that files can be split at anywhere, and every record
is held against its ``Content-Length``. Other archives are framed by ``Content-Length`` alone, each file
by one task that holds one record at a time.

Defined results: a revisit whose response is not in the archive keeps what its own records say; a null html is the empty payload; a null page id cannot be referred to and its
records are told apart by row; rows with equal ids and payloads are a response and revisits of
it; an empty table gives no captures; extra columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import join_counted, quoted, staged

VERSION = "WARC/1.1"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of a SHA-1: eight times 20 bits, each four characters."""
    hexed, out = F.sha1(data), []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(archive: str | None, headers: list[tuple[str, Column]], body: Column) -> Column:
    """A record behind its version line, in an archive; a header whose value is null is left out."""
    lines = [F.lit(f"{VERSION}\r\n" + (f"WARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n" if archive else ""))]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), body]
    return F.concat(*lines)


def captures_of(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with payload, digest and what they refer to: the smallest id among equal payloads."""
    rows = pages.select(
        quoted(id_col).alias("page_id"),
        F.coalesce(quoted(url_col), F.lit("")).alias("url"),
        F.coalesce(quoted(html_col), F.lit("")).alias("payload"),
    ).withColumns({"row": F.monotonically_increasing_id(), "digest": sha1_base32(F.col("payload")), "size": F.octet_length("payload")})
    rows = staged(rows, "captures")
    # Counted before it is moved: payloads in a third of all pages cost one row per task.
    first = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")).alias("first"), F.count("*").alias("n")
    )
    names = ["page_id", "url", "payload", "digest", "size", "row"]
    compared = join_counted(rows.filter(F.col("size") >= least_bytes), first, "digest", "n", rows.count())
    compared = compared.select(*names, (F.col("first.row") != F.col("row")).alias("revisits"), F.col("first.row").alias("target_row"))
    short = rows.filter(F.col("size") < least_bytes).select(*names, F.lit(False).alias("revisits"), F.lit(None).cast("long").alias("target_row"))
    return compared.unionByName(short)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes gzip files of WARC records under ``path`` and returns the archive's UUID, which its warcinfo record has."""
    archive = str(uuid.uuid4())
    rows = captures_of(pages, least_bytes, id_col, url_col, html_col)
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]", "%0A")  # noqa: E731  a header is one line
    urn = lambda kind, row: F.concat(F.lit(f"<urn:{kind}:{archive}:"), row.cast("string"), F.lit(">"))
    own = urn("capture", F.col("row"))
    url = one_line(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    capture = _record(
        archive,
        [
            ("WARC-Type", F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", own),
            ("WARC-Date", F.lit(_DATE)),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(F.col("revisits"), urn("capture", F.col("target_row")))),
            ("WARC-Profile", F.when(F.col("revisits"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(F.col("revisits"), F.lit("")).otherwise(F.col("payload"))),
    )
    request = _record(
        archive,
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", urn("request", F.col("row"))), ("WARC-Date", F.lit(_DATE)), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        archive,
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", urn("metadata", F.col("row"))), ("WARC-Date", F.lit(_DATE)), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit("\r\n")),
    )
    info = _record(
        None,
        [("WARC-Type", F.lit("warcinfo")), ("WARC-Record-ID", F.lit(f"<urn:uuid:{archive}>")), ("WARC-Date", F.lit(_DATE)), ("Content-Type", F.lit("application/warc-fields"))],
        F.lit("format: WARC File Format 1.1\r\n"),
    )
    records = pages.sparkSession.range(1, numPartitions=1).select(info.alias("value")).unionByName(rows.select(F.explode(F.array(request, capture, metadata)).alias("value")))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    return archive


def archive_of(spark: SparkSession, path: str) -> str | None:
    """The UUID in the second line of the first file; none if the line is another."""
    second = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 1
    first = spark.read.option("lineSep", "\r\n").text(path).select("value", second.alias("second")).filter("second").head(1)
    named = re.fullmatch(r"WARC-Warcinfo-ID: <urn:uuid:([0-9a-f-]{36})>", first[0].value) if first else None
    return named[1] if named else None


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of files, cut at the start of version lines and in order, as records by ``Content-Length``."""
    schema = pa.schema([("head", pa.string()), ("body", pa.binary()), ("length", pa.int64())])
    piece, need, file, out, size = bytearray(), None, None, [], 0

    def record() -> tuple[str, bytes, int | None]:
        at = piece.find(b"\r\n\r\n")
        head = bytes(piece[: at + 2] if at >= 0 else piece)
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        rest = bytes(piece[at + 4 :]) if at >= 0 else b""
        length = int(said[1]) if said else None
        # What stands behind the two line ends that close a record belongs to no record: its body then is longer than it says.
        body = rest[:length] if length is not None and len(rest) >= length and not rest[length:].strip(b"\r\n") else rest
        return head.partition(b"\r\n")[2].decode("utf-8", "replace"), body, length

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = value.as_py()
            if piece and (name != file or need is not None and len(piece) >= need):
                out.append(record())
                size += len(out[-1][1])
                piece, need = bytearray(), None
            file = name
            if not piece and not value.strip(b"\r\n"):
                continue
            piece += b"WARC/" + value
            at = piece.find(b"\r\n\r\n") if need is None else -1
            if at >= 0:
                said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", piece[: at + 2])
                need = at + 4 + int(said[1]) if said else 0
            if size > 1 << 24:
                yield table()
                out, size = [], 0
    if piece:
        out.append(record())
    if out:
        yield table()


def framed_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of any WARC files, framed by ``Content-Length``: ``head`` without the version line, ``body``, ``length``.

    A payload may hold version lines. Pieces of a file meet in one task, sorted on disk; a file is what a task reads.
    """
    raw = spark.read.option("lineSep", "WARC/").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value")
    )
    pieces = raw.repartition("file").sortWithinPartitions("file", "start", "at").select("file", "value")
    rows = pieces.mapInArrow(_framed, "head string, body binary, length long")
    return rows.withColumn("body", F.col("body").cast("string"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as ``type, record_id, concurrent_to, refers_to, digest, url, body, whole``.

    ``whole`` is false where the body is not as long as its header says, or the header does not say.
    """
    archive = archive_of(spark, path)
    if archive is None:
        return _records(framed_records(spark, path), "(?i)", F.coalesce(F.col("length") == F.octet_length("body"), F.lit(False)))
    mark = f"{VERSION}\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"
    raw = spark.read.option("lineSep", mark).text(path).filter(F.octet_length("value") > 0)
    # Headers have no blank line; the body ends before the two line ends that close a record.
    cut = F.instr("value", "\r\n\r\n")
    raw = raw.select(F.substring("value", F.lit(1), cut + 1).alias("head"), F.substring(F.col("value"), cut + 4, F.length("value") - cut - 7).alias("body"))
    length = F.nullif(F.regexp_extract("head", r"(?:^|\n)Content-Length: ([^\r\n]*)", 1), F.lit(""))
    return _records(raw, "", length.cast("long") == F.octet_length("body"))


def _records(raw: DataFrame, flags: str, whole: Column) -> DataFrame:
    field = lambda name: F.nullif(F.regexp_extract("head", rf"{flags}(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    return raw.select(
        field("WARC-Type").alias("type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Concurrent-To").alias("concurrent_to"),
        field("WARC-Refers-To").alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        field("WARC-Target-URI").alias("url"),
        "body",
        whole.alias("whole"),
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture, request, metadata, payload`` and what it revisits.

    Identifiers are unique, so no key is hot but that of a response with many revisits, and there
    the side with the response is one row.
    """
    checked = records.withColumn("body", F.when(F.col("whole"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("a WARC record is cut short: "), F.coalesce("record_id", F.lit("?"))))))
    cut = F.instr("body", "\r\n\r\n")
    captures = checked.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("id"),
        F.struct("type", "record_id", "refers_to", "digest", "url", F.substring("body", F.lit(1), cut + 1).alias("http")).alias("capture"),
        F.substring(F.col("body"), cut + 4, F.length("body")).alias("payload"),
    )
    # Measured here, so that the joins move a payload only where it is asked for.
    captures = captures.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    requests = checked.filter("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "url", "body").alias("request"))
    metadata = checked.filter("type = 'metadata'").select(
        F.col("concurrent_to").alias("id"),
        F.struct(
            "record_id",
            F.regexp_extract("body", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
            F.regexp_extract("body", r"payload-bytes: (\d+)", 1).try_cast("long").alias("payload_bytes"),
        ).alias("metadata"),
    )
    return captures.join(metadata, "id", "left").join(requests, "id", "left")


def capture_digests(assembled: DataFrame) -> DataFrame:
    """Per page: size and digest of the full payload, type, and the page that a revisit refers to.

    Both are recomputed from the payload of the response, for a revisit from that which it refers to. A digest
    in a record that is not that of the payload is an error.
    """
    is_response = F.col("capture.type") == "response"
    rows = assembled.select(
        "id",
        F.col("metadata.page_id").alias("page_id"),
        F.when(is_response, F.col("payload_bytes")).otherwise(F.col("metadata.payload_bytes")).alias("payload_bytes"),
        F.when(is_response, F.col("payload_digest")).alias("found"),
        F.col("capture.digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("target"),
    )
    told = lambda c: F.raise_error(F.concat(F.lit("a WARC digest is not that of its payload: "), c))
    held = F.when(F.col("found") != F.col("payload_digest"), told(F.col("id"))).otherwise(F.coalesce("found", "payload_digest"))
    rows = staged(rows.withColumn("payload_digest", held).drop("found"), "capture-digests")
    plain, revisits = rows.filter("target IS NULL"), rows.filter("target IS NOT NULL")
    counted = revisits.groupBy("target").agg(F.count("*").alias("n"))
    targets = rows.filter("record_type = 'response'").select(F.col("id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    referred = join_counted(revisits, counted.join(targets, "target", "left"), "target", "n", revisits.count())
    same = F.when(F.col("digest") != F.col("payload_digest"), told(F.col("id"))).otherwise(F.coalesce("digest", "payload_digest"))
    referred = referred.withColumns({"payload_digest": same, "payload_bytes": F.coalesce("bytes", "payload_bytes")})
    return plain.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(referred.select(*columns))
