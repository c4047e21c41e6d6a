"""WARC archives: writing captures, reading records, and assembling request, response and metadata.

Each capture is three records: the response (or a revisit of an equal payload), its request and its metadata. The
latter two name the first in WARC-Concurrent-To. Spark's own text writer makes the files, with the record end as line
end, so any file system that Spark knows will do. Files are whole gzip streams of bounded size: each holds captures of
one size class from one stretch of a task's rows, as many as fit if all are as large as their class allows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm.common import checked_broadcast, mapped, materialize, quoted, remove_path, scratch_path, text_bytes

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes of records, before compression, that an archive of several captures holds at most.
ARCHIVE_BYTES = 64 << 20


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: four letters for each five hex digits."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: Column, ident: Column, date: str, headers: list[Column], block: Column) -> Column:
    """A record without the two line ends after it. Headers that are null are left out."""
    said = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {date}")]
    lines = [F.lit("WARC/1.1"), *said, *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


#: Bytes of a record besides its payload, at most about: headers, request and metadata.
OVERHEAD = 2000
#: Payload bytes of the size classes: up to 4 KB, then 16 times as much for each, as many as fit an archive.
SMALLEST, STEP = 4 << 10, 16


def _archive_number(n: Column, archive_bytes: int) -> list[Column]:
    """Size class of a payload of n bytes, and its stretch: so many rows of a task that even the largest payloads of the class fit."""
    classes, bound = [], SMALLEST
    while bound + OVERHEAD <= archive_bytes:
        classes.append((bound, archive_bytes // (bound + OVERHEAD)))
        bound *= STEP
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its task
    number, rows = F.lit(len(classes)), F.lit(1).cast("long")
    for k, (most, fit) in reversed(list(enumerate(classes))):
        number, rows = F.when(n <= most, k).otherwise(number), F.when(n <= most, F.lit(fit).cast("long")).otherwise(rows)
    return [number.alias("size_class"), F.floor(at / rows).alias("stretch")]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, least_revisit: int = 0, date: str | None = None) -> None:
    """Writes a capture for each row under path. Null html is an empty payload.

    Of payloads that are equal and have at least least_revisit bytes, the one with the largest id is the response and
    the others revisit it. Rows that repeat its id and payload are responses too. A null id is below all others;
    control characters and spaces of a url are percent-encoded, a null url has no target line. Ids are whole numbers.
    date: when the pages were captured, in UTC and ISO 8601; the time of writing if not given. No rows: no captures.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = text_bytes(html_col)
    narrow = pages.select(quoted(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    shared = narrow.groupBy("sha", "n").agg(F.max("id").alias("keep"), F.count("*").alias("copies"))
    groups = materialize(shared.where((F.col("copies") > 1) & (F.col("n") >= least_revisit)).select("sha", "n", "keep"), small=True)
    rows = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # Whole pages are shuffled only if more payloads are shared than may be broadcast.
    known = rows.join(checked_broadcast(groups), ["sha", "n"], "left")
    revisit = F.col("copies_known") & ~F.col("id").eqNullSafe(F.col("keep"))
    known = known.withColumn("copies_known", F.col("keep").isNotNull())

    def ident(kind: str, i: Column) -> Column:
        said = F.concat_ws("|", F.lit(kind), F.coalesce(i.cast("string"), F.lit("-")), F.col("sha"))
        return F.concat(F.lit("<urn:sha1:"), F.sha1(said.cast("binary")), F.lit(">"))

    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    main = ident("response", F.col("id"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main)
    http = F.lit(HTTP)
    headers = [
        target,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), ident("response", F.col("keep")))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    response = _record(F.when(revisit, "revisit").otherwise("response"), main, date, headers, block)
    ask = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record(F.lit("request"), ident("request", F.col("id")), date, [target, concurrent, F.lit("Content-Type: application/http; msgtype=request")], ask)
    page = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(END)), F.lit(""))
    fields = F.concat(page, F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit(END))
    metadata = _record(F.lit("metadata"), ident("metadata", F.col("id")), date, [concurrent, F.lit("Content-Type: application/warc-fields")], fields)
    end = F.lit(END + END)
    captures = known.select(F.concat(request, end, response, end, metadata).alias("value"), *_archive_number(F.col("n"), archive_bytes))
    captures.write.option("lineSep", END + END).option("compression", "gzip").partitionBy("size_class", "stretch").text(path)


def unzipped(data: bytes) -> tuple[bytes, bool]:
    """The content of gzip members one after another, and whether it is whole: a cut-off or damaged member ends it. Zeros after the last are padding."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        try:
            out.append(unzip.decompress(data))
        except zlib.error:
            return b"".join(out), False
        if not unzip.eof:
            return b"".join(out), False
        data = unzip.unused_data.lstrip(b"\0")
    return b"".join(out), not data


def records_in(data: bytes):
    """(headers, block) of each record; headers are lower-cased, of repeated ones a list. Framed by Content-Length alone.

    A record that ends before its length, or has none that is a number (its block then ends before the next record), gets
    a warc-truncated header if it has none.
    """
    stream = unzipped(data)[0] if data[:2] == b"\x1f\x8b" else data
    view, at = memoryview(stream), 0
    while True:
        at = stream.find(b"WARC/", at) if stream[at : at + 5] != b"WARC/" else at
        if at < 0:
            return
        head_end = stream.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        headers: dict[str, list[str]] = {}
        for line in stream[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        said, start = headers.get("content-length", [""])[0], head_end + 4
        size = int(said) if said.isascii() and said.isdigit() else None
        if size is None:
            stop = stream.find(b"\r\n\r\nWARC/", start)
            stop = len(stream) if stop < 0 else stop
        else:
            stop = start + size
        if size is None or stop > len(stream):
            headers.setdefault("warc-truncated", ["unspecified"])
        yield headers, view[start:stop]
        at = stop + 4


RECORD = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>, truncated string"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record under path: RECORD, with payload (binary) if asked for.

    Digests and sizes of responses are those of the payloads as read; a revisit has its header's digest. fields: of
    metadata records. truncated: why a record isn't whole, "unspecified" if it ends early or its length is no number.
    A file is read whole by one task; archives have bounded sizes. An empty folder, or one that isn't there because
    nothing was written, gives no rows.
    """
    spark_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not spark_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark_path):
        return spark.createDataFrame([], RECORD + ", payload binary" * payloads)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in records_in(content.as_buffer().to_pybytes()):
                    one = lambda name: (headers.get(name) or [None])[0]  # noqa: B023, E731
                    kind, payload, fields = one("warc-type"), None, {}
                    digest = (one("warc-payload-digest") or "").rpartition(":")[2] or None
                    if kind in ("response", "resource"):
                        data = bytes(block)
                        payload = data.partition(b"\r\n\r\n")[2] if data[:5] == b"HTTP/" else data
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "metadata":
                        for line in io.StringIO(bytes(block).decode("utf-8", "replace")):
                            name, _, value = line.partition(":")
                            if name.strip():
                                fields[name.strip()] = value.strip()
                    rows.append((one("warc-record-id"), kind, one("warc-target-uri"), headers.get("warc-concurrent-to", []), one("warc-refers-to"), digest, None if payload is None else len(payload), list(fields.items()), one("warc-truncated"), payload if payloads else None))
                    if len(rows) >= 2048:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
    names = ["record_id", "record_type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "fields", "truncated", "payload"]

    def table(rows):
        n = len(types) - (not payloads)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows, strict=True), types, strict=True))[:n]], names=names[:n])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.transform(mapped, parse, RECORD + ", payload binary" * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, record_type, response, request, metadata, n_requests, n_metadata.

    A capture is a response, revisit or resource. Records that name it in WARC-Concurrent-To belong to it, and so do
    those that it names, or that name one which names it. Of several requests or metadata records the one with the
    least id is nested and all are counted; a capture without any has null there. Records that lead to no capture give
    no row. Repeated captures have a row each.
    """
    anchor = F.col("record_type").isin("response", "revisit", "resource")
    own = [f.name for f in records.schema.fields]
    captures = records.where(anchor)
    loose = records.where(~anchor).select("record_id", "record_type", "concurrent_to", "target_uri", "fields")
    forward = loose.select("*", F.explode("concurrent_to").alias("to"))
    backward = captures.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("named"))
    first = forward.select("record_id", "record_type", "target_uri", "fields", "to").unionByName(loose.join(backward, F.col("record_id") == F.col("named")).select("record_id", "record_type", "target_uri", "fields", F.col("capture").alias("to")))
    # A record may name another loose one, such as metadata of a request; it then belongs where that one does.
    ties = forward.select("record_id", F.col("to").alias("tie"))
    second = first.join(ties.select(F.col("record_id").alias("to"), "tie"), "to").where("tie != record_id").select("record_id", "record_type", "target_uri", "fields", F.col("tie").alias("to"))
    part = F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields"))
    kind = lambda k: F.when(F.col("record_type") == k, part)
    sides = first.unionByName(second).groupBy("to").agg(
        F.min(kind("request")).alias("request"), F.min(kind("metadata")).alias("metadata"),
        F.count_if(F.col("record_type") == "request").alias("n_requests"), F.count_if(F.col("record_type") == "metadata").alias("n_metadata"),
    )
    nested = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.record_id").alias("record_id"), F.col(f"{c}.target_uri").alias("target_uri"), F.map_from_entries(f"{c}.fields").alias("fields"))).alias(c)
    joined = captures.select(F.col("record_id").alias("capture_id"), "record_type", F.struct(*own).alias("response")).join(sides, F.col("capture_id") == F.col("to"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("capture_id", "record_type", "response", nested("request"), nested("metadata"), zero("n_requests"), zero("n_metadata"))


def round_trip(pages: DataFrame, least_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of pages, written and read again: page_id, payload_bytes, payload_digest, record_type, refers_to, complete.

    The archives are removed once their records are known. complete: the capture has its request and metadata.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, least_revisit=least_revisit)
    records = materialize(read_archives(spark, path))
    remove_path(spark, path)
    field = lambda name: F.col("metadata.fields")[name].cast("long")
    done = assemble(records).select(
        "capture_id", field("page-id").alias("page_id"), F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), "record_type", F.col("response.refers_to").alias("target"),
        ((F.col("n_requests") > 0) & (F.col("n_metadata") > 0)).alias("complete"),
    )
    done = materialize(done)
    # A revisit names a record; the page that the record is of is known from its own capture.
    named = done.where("target is not null").select(F.col("target").alias("want")).distinct()
    responses = done.where("record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("refers_to"))
    # Rows that repeat an id and payload share a record id.
    found = responses.join(named, F.col("of") == F.col("want"), "left_semi").groupBy("of").agg(F.max("refers_to").alias("refers_to"))
    joined = done.join(checked_broadcast(materialize(found, small=True)), F.col("target") == F.col("of"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")
