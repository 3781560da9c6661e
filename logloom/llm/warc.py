"""WARC archives: writing captures, and transaction assembly on the way back.

`write_warc` makes a request, a response (or revisit) and a metadata record of every capture and writes them with
Spark's own committer, so a lost executor leaves no half file. Every record ends with CRLF CRLF; that is the line
separator of the text writer. `read_warc` parses archives (plain or gzip, of any writer) into records, and `assemble`
joins request, response and metadata through WARC-Concurrent-To into one nested row for each capture.

Defined cases: a null payload is empty; a null url is written as an empty target; rows that repeat id, url and payload
are captures of their own, told apart by a number in their record ids; a null id is a capture of its own id. Of equal
payloads of at least `min_bytes` bytes the one with the smallest id (null last), then url, is the response, the others
revisit it. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, scratch, ship, stored

CRLF = "\r\n"
RECORD = "record_id string, concurrent_to string, type string, uri string, date string, refers_to string, refers_to_record string, payload_digest string, content_length long, http_length long, block_headers string, payload binary"
DATE = "2024-01-01T00:00:00Z"


def record_id(kind: str, *cols: Column) -> Column:
    """A urn:uuid that depends on the capture and the kind of record only; a retried task writes the same."""
    told = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols[:3]] + [c.cast("string") for c in cols[3:]]  # a first copy has no number
    h = F.sha1(F.concat_ws("|", F.lit(kind), *told))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def lines(*pairs: tuple[str, Column | str]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for k, v in pairs])


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 160 bits are 32 characters of 5 bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(0, 40, 5):  # 5 hex digits are 4 characters
        n = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(alphabet, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, html, digest, copy, refers_to, refers_url): id and url of the response that a revisit refers to.

    Only narrow rows are dealt by digest. Rows that repeat id, url and payload, if there are any, are numbered by `copy` from 1.
    """
    html = F.coalesce(pages[html_col], F.lit(""))
    base = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    same = base.select("id", "url", "digest", F.octet_length("html").alias("n")).groupBy("id", "url", "digest", "n").agg(F.count("*").alias("copies"))
    shared = same.where(F.col("n") >= min_bytes)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    firsts = shared.groupBy("digest").agg(first.alias("first"), F.sum("copies").alias("copies")).where("copies > 1").select(F.col("digest").alias("f_digest"), F.col("first.id").alias("first"), F.col("first.url").alias("refers_url"))
    repeated = stored(same.where("copies > 1").select(F.col("id").alias("r_id"), F.col("url").alias("r_url"), F.col("digest").alias("r_digest")), "repeated")
    numbered = base.withColumn("copy", F.lit(1))
    if not repeated.isEmpty():
        is_same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("url") == F.col("r_url")) & (F.col("digest") == F.col("r_digest"))
        copies = base.join(repeated, is_same, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("id", "url", "digest").orderBy(F.lit(1))))
        numbered = base.join(repeated, is_same, "left_anti").withColumn("copy", F.lit(1)).unionByName(copies)
    answers = F.col("id").eqNullSafe(F.col("first")) & (F.col("first").isNull() | ((F.col("url") == F.col("refers_url")) & (F.col("copy") == 1)))
    met = numbered.join(firsts, F.col("digest") == F.col("f_digest"), "left")
    return met.select("id", "url", "html", "digest", "copy", F.when(~answers, F.col("first")).alias("refers_to"), "refers_url")


def warc_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row for each WARC record, its text without the closing CRLF CRLF."""
    c = captures(pick(pages, [id_col, url_col, html_col]), id_col, url_col, html_col, min_bytes)
    who = (F.col("id"), F.col("url"), F.col("digest"), F.when(F.col("copy") > 1, F.col("copy")))
    length = lambda x: F.octet_length(x).cast("string")
    digest = F.concat(F.lit("sha1:"), base32(F.col("digest")))
    answer_id, uri = record_id("response", *who), F.regexp_replace("url", r"[\x00-\x20]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length(F.col("html")), F.lit(CRLF * 2))
    revisit = F.col("refers_to").isNotNull()
    referred = record_id("response", F.col("refers_to"), F.col("refers_url"), F.col("digest"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    answer = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), lines(("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", answer_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)),
        F.when(revisit, lines(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", referred), ("WARC-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))).otherwise(F.lit("")),
        lines(("Content-Type", "application/http; msgtype=response"), ("Content-Length", length(block))), F.lit(CRLF), block,
    )
    ask = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}User-Agent: logloom{CRLF * 2}"))
    request = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), lines(("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", *who)), ("WARC-Concurrent-To", answer_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=request"), ("Content-Length", length(ask))), F.lit(CRLF), ask,
    )
    facts = lines(("page-id", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    metadata = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), lines(("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", *who)), ("WARC-Concurrent-To", answer_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/warc-fields"), ("Content-Length", length(facts))), F.lit(CRLF), facts,
    )
    return c.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write_warc(records: DataFrame, path: str, *, records_per_file: int = 6000) -> str:
    """Writes records as gzip archives below path; a file holds at most records_per_file records."""
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The records of one archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            continue  # the blank lines between records
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        size = int(head.get(b"content-length", 0))
        block = stream.read(size)
        headers, payload, http_length = "", block, None
        if head.get(b"content-type", "").startswith("application/http"):
            headers, _, payload = block.partition(b"\r\n\r\n")
            http_length = next((int(x.partition(b":")[2]) for x in headers.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            headers = headers.decode("utf-8", "replace")
        digest = head.get(b"warc-payload-digest")
        yield (
            head.get(b"warc-record-id"), head.get(b"warc-concurrent-to"), head.get(b"warc-type"), head.get(b"warc-target-uri"), head.get(b"warc-date"), head.get(b"warc-refers-to-page"), head.get(b"warc-refers-to"),
            digest and digest.rpartition(":")[2], size, http_length, headers, payload,
        )


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for frame in frames:
        for content in frame["content"]:
            batch: list[tuple] = []
            held = 0
            for row in parse_archive(content):
                batch.append(row)
                held += row[8]
                if held > 8 << 20:
                    yield pd.DataFrame(batch, columns=names).astype({"content_length": "Int64", "http_length": "Int64"})
                    batch, held = [], 0
            if batch:
                yield pd.DataFrame(batch, columns=names).astype({"content_length": "Int64", "http_length": "Int64"})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path. A file is read whole by one task, so writers bound its size."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(_parse, RECORD)


def assemble(records: DataFrame, *, payload: Column | None = None) -> DataFrame:
    """One row for each capture: response (struct), request (struct), metadata (array of structs).

    Links may point either way: from a request or metadata record to the answer, or from the answer to them. Repeated
    record ids are one record. `payload` replaces the payload column (say, by its digest) before rows are dealt out.
    """
    part = F.struct("record_id", "concurrent_to", "uri", "date", "type", "refers_to", "refers_to_record", "payload_digest", "content_length", "http_length", "block_headers", (payload if payload is not None else F.col("payload")).alias("payload"))
    rows = records.select("record_id", "concurrent_to", F.lower("type").alias("kind"), part.alias("r"))
    answers = rows.where("kind in ('response', 'revisit')")
    others = rows.where("kind in ('request', 'metadata')")
    back = answers.where("concurrent_to is not null").select(F.col("concurrent_to").alias("other_id"), F.col("record_id").alias("answer_id"))
    linked = others.where("concurrent_to is not null").select("kind", F.col("concurrent_to").alias("answer_id"), "r").unionByName(
        others.join(back, F.col("record_id") == F.col("other_id")).select("kind", "answer_id", "r")
    )
    side = linked.groupBy("answer_id").agg(F.min(F.when(F.col("kind") == "request", F.col("r"))).alias("request"), F.sort_array(F.collect_set(F.when(F.col("kind") == "metadata", F.col("r")))).alias("metadata"))
    return answers.groupBy("record_id").agg(F.first("r").alias("response")).join(side, F.col("record_id") == F.col("answer_id"), "left").drop("answer_id")


def page_of(metadata: Column) -> Column:
    """The page id that a metadata record's payload names; null without one."""
    return F.nullif(F.regexp_extract(metadata.cast("string"), "page-id: ([^\\r\\n]*)", 1), F.lit("")).try_cast("bigint")


def referred(assembled: DataFrame, refers_to: str = "refers_to", page: str = "page_id") -> DataFrame:
    """assembled (record_id, refers_to, page, ...) with refers_page: the page of the record that a revisit's WARC-Refers-To names."""
    named = assembled.select(F.col("record_id").alias("__named"), F.col(page).alias("refers_page"))
    return assembled.join(named, F.col(refers_to) == F.col("__named"), "left").drop("__named")


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Writes an archive of the pages and reads it back: (record_id, response, request, metadata), payloads included."""
    spark = pages.sparkSession
    return assemble(read_warc(spark, write_warc(warc_records(pages, **columns), path or scratch(spark, "warc"))))


def sha1_base32(data: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()
