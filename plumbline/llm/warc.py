"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is written as three records: the request, the response (or a revisit that names the response with the same payload)
and the metadata; request and metadata name the response in ``WARC-Concurrent-To``. Records are whole UTF-8 strings, and
Spark's text writer ends each with the blank lines that the format asks for, so executors write nothing on their own. Reading parses by
``Content-Length``, and assembly joins the records of a transaction through their concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import store

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, content_type string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Bytes of payload that a partition of an archive holds, about.
FILE_BYTES = 32 << 20


def with_digest(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with ``_bytes`` and ``_digest`` of the payload (null: empty)."""
    columns = pages.columns
    at = columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [x.as_buffer() if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(p) for p in payloads], pa.int64()), pa.array([sha1_base32(p) for p in payloads])], names=[*columns, "_bytes", "_digest"])

    return pages.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in pages.dtypes) + ", _bytes long, _digest string")


def _record(kind: str, record_id: Column, date: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing blank lines; headers whose value is null are left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}"), F.concat(F.lit("WARC-Record-ID: "), record_id, F.lit(CRLF))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _urn(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (s, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(h, s, n)]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000) -> None:
    """Write each row as a request, a response or revisit, and a metadata record, gzipped. Rows are dealt by their number over so many partitions that one holds some ``FILE_BYTES`` of payload, and a file is one
    of them or less (``records_per_file`` records at most), so a file that a task reads whole is that large, or as large as its largest pages.

    Of rows with equal payloads of ``least_bytes`` at least, the one with the largest id is the response (of equal ids the later
    row) and the others revisit it. A null payload is empty; a null url or id leaves its header out. Control characters and spaces
    in a url are written as %20. Repeated rows are captures of their own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("row", F.monotonically_increasing_id())
    # payloads are met by their digests alone; the pages themselves are shuffled once, by row, so that a common payload gathers none of them in a task. The scan gives
    # a row the same number each time, so the two passes agree
    digests = store.keep(with_digest(rows, "html").select("row", "id", "_bytes", "_digest"), "digests")
    firsts = digests.where(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("n")).where("n > 1")
    firsts = store.keep(firsts.select("_digest", "_bytes", F.col("last.row").alias("response_row")), "firsts")
    total = digests.agg(F.sum(F.col("_bytes") + 1024)).first()[0] or 0
    files = max(-(-total // FILE_BYTES), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = rows.repartition(files, "row").join(digests.join(firsts, ["_digest", "_bytes"], "left").select("row", "_bytes", "_digest", "response_row"), "row")

    revisit = F.col("response_row") != F.col("row")
    response_id = _urn("response", F.col("row"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20")
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")), ("Content-Type", F.lit("application/http;msgtype=response"))]
    request = _record("request", _urn("request", F.col("row")), date, [("WARC-Target-URI", uri), ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}User-Agent: archive{CRLF + CRLF}")))
    response = F.when(F.coalesce(revisit, F.lit(False)), _record("revisit", response_id, date, [*common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn("response", F.col("response_row")))], head)).otherwise(_record("response", response_id, date, common, F.concat(head, html)))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit(f"via: table{CRLF}"))
    metadata = _record("metadata", _urn("metadata", F.col("row")), date, [("WARC-Target-URI", uri), ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))], fields)
    joined.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes, keep_payload: bool) -> Iterator[tuple]:
    """The records of one archive in the order of ``RECORD_SCHEMA``. A record that isn't whole ends the archive with an error."""
    at, size = 0, len(data)
    while at < size:
        if data[at : at + 2] == b"\r\n":  # blank lines between records
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no record header at byte {at}")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"record at byte {at} is cut off")
        at = end + 4 + length
        kind, fields, payload = headers.get("warc-type"), {}, block
        if headers.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif headers.get("content-type", "").startswith("application/warc-fields"):
            fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in block.decode("utf-8").split("\r\n") if line)}
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        digest = stated if kind == "revisit" else sha1_base32(payload)
        if kind == "response" and stated and stated != digest:
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its stated digest")
        yield headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("content-type"), None if kind == "revisit" else len(payload), digest, list(fields.items()), payload if keep_payload else None


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path`` (plain or gzipped as a whole or by record). A file is parsed by one task: keep files at
    tens of MB, as ``write_archives`` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [c.strip().split(" ")[0] for c in RECORD_SCHEMA.replace("map<string,string>", "map").split(",")]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows, held = [], 0
                for record in parse_records(data, keep_payload):
                    rows.append(record)
                    held += len(record[-1] or b"")
                    if len(rows) == 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """``capture_id, request, response, metadata, original``: one nested row for each capture.

    A request or metadata record belongs to the response or revisit that its concurrent-to names; metadata may also name the request.
    Of several requests or metadata records of one capture the one with the smallest id is taken. A request or metadata record
    whose capture has no response still gives its row. ``original`` is the response that a revisit refers to, if it is there.
    Records without an id, and other types, take no part. An empty table gives no rows. ``records`` is read several times: give a kept table.
    """
    fields = [c for c in records.columns]
    whole = records.where("record_id is not null").select("record_id", "record_type", "concurrent_to", "refers_to", F.struct(*fields).alias("record"))
    main = whole.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.col("record").alias("response"))

    def named(kind: str, key: Column, rows: DataFrame) -> DataFrame:
        return rows.select(key.alias("capture_id"), "record").groupBy("capture_id").agg(F.min_by("record", "record.record_id").alias(kind))

    requests = whole.where("record_type = 'request'")
    through = requests.select(F.col("record_id").alias("request_id"), F.col("concurrent_to").alias("by_request"))
    notes = whole.where("record_type = 'metadata'").join(through, F.col("concurrent_to") == F.col("request_id"), "left")
    captures = main.join(named("request", F.coalesce("concurrent_to", "record_id"), requests), "capture_id", "full_outer").join(named("metadata", F.coalesce("by_request", "concurrent_to", "record_id"), notes), "capture_id", "full_outer")
    originals = captures.where("response.record_type = 'response'").select(F.col("capture_id").alias("original_id"), F.struct("response", "metadata").alias("original"))
    return captures.join(originals, F.col("response.refers_to") == F.col("original_id"), "left").select("capture_id", "request", "response", "metadata", "original")


def captures(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = store.new_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    return assemble(store.keep(read_archives(spark, path, keep_payload), "records"))
