"""WARC archives with revisit resolution (operator 7).

``write_archives`` shuffles headers only.  A first pass writes the headers (id,
url, size, digest) as a table; joined with the originals by payload digest they
give the verdicts.  Of the records whose payloads are equal and have at least
``min_bytes`` bytes, the one with the largest id stays a response, the others
become revisit records that refer to it and carry no payload: they are written
from their headers.  The second pass reads the payloads where they lie and leaves
out the revisits: a Bloom filter of their keys (at most exact.FILTER_WORDS words)
lets all other rows pass, and the responses that it takes for revisits, known
exactly from the headers, are let through as well (broadcast up to FEW rows;
more of them, when the filter is too small for the table, are joined with
the rows that the filter holds back).  All records get fresh headers.
``read_archives`` parses the files back, checks every payload against its digest,
and ``resolve`` joins revisits to their original responses.

Files are gzip-compressed WARC/1.1; every record ends with CR LF CR LF, which is
the line separator of Spark's text writer, so any file system that Spark writes
to will do, and a lost task is written again by its commit protocol.

Edge cases: a null payload is empty; rows of one id are equal originals (all
stay responses); a row without id is a revisit if its payload has an original
with an id, else a response; a null url is left out of the headers, white space
and control characters in one are written as %20; an empty table gives no rows;
other columns of the input are ignored."""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .exact import FILTER_WORDS, bloom_bits, flagged, plan_filter

MIN_BYTES = 1000
FEW = 1 << 18               # responses named in a broadcast: at most 16 MB
FILE_RECORDS = 50_000       # records of one archive file: read back whole, so far below 2 GB
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
SCHEMA = ("page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "target_uri string")


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    p = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    return pages.select(pages[id_col].cast("long").alias("_m_id"), pages[url_col].cast("string").alias("_m_url"),
                        p.alias("_m_payload"), F.octet_length(p).cast("long").alias("_m_bytes"),
                        F.sha1(p).alias("_m_digest"))


def originals(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(_m_digest, _m_original): the record that others with the same payload
    refer to, for payloads that come more than once."""
    return (headers.filter(F.col("_m_bytes") >= min_bytes).groupBy("_m_digest")
                   .agg(F.max("_m_id").alias("_m_original"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1 AND _m_original IS NOT NULL").select("_m_digest", "_m_original"))


def _uri(column):
    return F.concat(F.lit("<urn:page:"), column.cast("string"), F.lit(">"))


def _line(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise(F.lit(""))


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The headers that repeat another record's payload, and _m_original.  Whether
    a record is one follows from its digest and id."""
    return (headers.filter(F.col("_m_bytes") >= min_bytes).join(originals(headers, min_bytes), "_m_digest")
                   .filter(~F.col("_m_id").eqNullSafe(F.col("_m_original"))))


def _key():
    return F.xxhash64("_m_digest", "_m_id")


def responses(records: DataFrame, headers: DataFrame, again: DataFrame, few: int = FEW,
              most_words: int = FILTER_WORDS) -> DataFrame:
    """``records`` (with payloads) without those whose header is in ``again``;
    ``headers`` and ``again`` are written tables.  Payloads are not shuffled,
    unless the filter holds back more than ``few`` responses."""
    n = again.count()
    if not n:
        return records
    words = min(plan_filter(n)[1], most_words)
    bits = cut(bloom_bits(again.select(_key().alias("h")).distinct(), words, least=1))
    same = ["_m_digest", "_m_key"]
    named = F.coalesce(F.col("_m_id").cast("string"), F.lit("")).alias("_m_key")
    back = flagged(headers.select("_m_digest", "_m_id", _key().alias("h")), bits, words).filter("maybe")
    wrong = cut(back.select("_m_digest", named).join(again.select("_m_digest", named), same, "left_anti").distinct())
    rows = flagged(records.withColumns({"h": _key(), "_m_key": named}), bits, words)
    if wrong.count() <= few:
        kept = (rows.join(F.broadcast(wrong.withColumn("_m_wrong", F.lit(True))), same, "left")
                    .filter("NOT maybe OR _m_wrong"))
    else:
        kept = rows.filter("NOT maybe").unionByName(rows.filter("maybe").join(wrong, same, "left_semi"))
    return kept.select(records.columns)


def _lines(rec: DataFrame, revisit: bool, date: str) -> DataFrame:
    """(value): the records of ``rec`` as text, revisits from headers alone."""
    url = F.regexp_replace("_m_url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("_m_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = http if revisit else F.concat(http, F.col("_m_payload"))
    profile = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
        _line("WARC-Refers-To", _uri(F.col("_m_original")))) if revisit else F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {'revisit' if revisit else 'response'}{CRLF}"),
        _line("WARC-Record-ID", F.coalesce(_uri(F.col("_m_id")), F.lit("<urn:page:none>"))),
        F.lit(f"WARC-Date: {date}{CRLF}"), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_m_digest"))), profile,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return rec.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE,
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   file_records: int = FILE_RECORDS) -> None:
    """Write one record per row of ``pages``, duplicates as revisits."""
    rec = _records(pages, id_col, url_col, payload_col)
    headers = cut(rec.drop("_m_payload"))
    again = cut(revisits(headers, min_bytes))
    (_lines(responses(rec, headers, again), False, date).unionByName(_lines(again, True, date))
        .write.mode("overwrite").option("maxRecordsPerFile", file_records)
        .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        .text(path))


def _inflate(content: bytes, size: int = 1 << 20):
    """Decompressed pieces of a gzip file of one or more members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        z = zlib.decompressobj(31)
        data = z.decompress(content, size)
        while data:
            yield data
            data = z.decompress(z.unconsumed_tail, size)
        content = z.unused_data


_ID = re.compile(rb"<urn:page:(\d+|-\d+)>")


def _page(value):
    m = _ID.match(value or b"")
    return int(m.group(1)) if m else None


def parse(pieces):
    """(headers, block) of every record in a stream of byte pieces; only one
    record is held at a time."""
    buf = b""
    pieces = iter(pieces)

    def more():
        nonlocal buf
        piece = next(pieces, None)
        if piece is None:
            return False
        buf += piece
        return True

    while True:
        while not buf.lstrip(b"\r\n"):
            buf = b""
            if not more():
                return
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("truncated WARC header")
        head = {}
        for line in buf[:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip()
        size = int(head[b"content-length"])
        parts, have = [buf[end + 4:]], len(buf) - end - 4
        while have < size + 4:
            piece = next(pieces, None)
            if piece is None:
                break
            parts.append(piece)
            have += len(piece)
        buf = b"".join(parts)
        if len(buf) < size:
            raise ValueError("truncated WARC record")
        yield head, buf[:size]
        buf = buf[size:]
        if buf[:4] == b"\r\n\r\n":
            buf = buf[4:]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: (page_id, record_type, refers_to, payload_bytes,
    payload_digest as lower-case hexadecimal, target_uri).  A response's payload
    is checked against its digest; a revisit's payload_bytes is null until it is
    resolved."""
    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in parse(_inflate(content.as_py())):
                    kind = head[b"warc-type"].decode()
                    digest = head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    size = None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("a payload does not match its digest")
                    uri = head.get(b"warc-target-uri")
                    rows.append((_page(head.get(b"warc-record-id")), kind, _page(head.get(b"warc-refers-to")), size,
                                 digest, uri.decode("utf-8", "replace") if uri is not None else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the revisits' payload_bytes taken from the response that
    they refer to and whose digest is the same."""
    source = (records.filter("record_type = 'response'")
                     .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
                     .agg(F.max("payload_bytes").alias("_m_bytes")))
    return (records.join(source, ["refers_to", "payload_digest"], "left")
                   .select("page_id", F.coalesce("payload_bytes", "_m_bytes").alias("payload_bytes"), "payload_digest",
                           "record_type", "refers_to"))
