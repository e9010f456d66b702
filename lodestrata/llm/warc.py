"""WARC archives and a merged capture index.

Writing: each page becomes one WARC/1.1 record. Of pages with equal payloads of at least ``revisit_from`` bytes the
one with the greatest id is the response; the others are revisits that refer to it and carry its HTTP header only.
Records are text, so Spark's own writer makes the archives, in any store that Spark reaches, a bounded number of
records a file and gzip over each file.

Reading: each archive is parsed by its Content-Length fields in one task, payload digests are verified, and what
the index needs of each capture is kept.

Index: every task sorts its captures by URL key, time and id into a local run, cut at sampled bounds and
front-coded. Each range of keys merges its pieces of all runs with a loser tree; ranges in order give the capture
history of every URL. Bounds hold time and id too, so that one URL with very many captures spans several ranges. A
capture's row names its archive and the offset of its record in the unpacked archive.

Pages have no capture time; it is a fixed start plus the page id in seconds, modulo some three thousand years, in UTC.

Cases: a null html is an empty payload; a null url is an empty one with the key of nothing; a null id is written as
``null``, read back as null, and sorts first; repeated rows give repeated captures; ties in key, time and id keep
all rows; very long payloads stay whole; empty tables give no captures. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, whole, written
from .losertree import decoded, front_coded, merged

#: The letters of base32, and of the WARC format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END, BLANK = "\r\n", "\r\n\r\n"
FIRST_CAPTURE = "2024-01-01 00:00:00"
#: Capture times stay in years of four digits.
MOST_SECONDS = 100_000_000_000
CAPTURES = "url string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
_ARROW = pa.schema([("url", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five digits are four letters."""
    letters = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, broadcast_rows: int = 500_000) -> DataFrame:
    """(record): the text of one WARC record a page, without the blank lines that end it.

    Payloads stay where they are: which digests have copies is a narrow table, broadcast up to a counted number of rows.
    """
    own = pages.select(F.col(key).cast("long").alias("id"), whole(F.col(url)).alias("url"), whole(F.col(html)).alias("html"))
    own = own.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", base32_of_hex(F.sha1(F.encode("html", "UTF-8"))))
    same = own.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("copies")).where("copies > 1").select("digest", "response")
    same = written(same, "responses")
    told = own.join(F.broadcast(same) if same.count() <= broadcast_rows else same, "digest", "left")
    again = (F.col("n") >= revisit_from) & F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    # Without a time zone, so that the session's says nothing here.
    seconds = F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(MOST_SECONDS))
    time = F.lit(FIRST_CAPTURE).cast("timestamp_ntz") + F.make_dt_interval(F.floor(seconds / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"))
    when = F.concat(F.translate(time.cast("string"), " ", "T"), F.lit("Z"))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(BLANK))
    told = told.withColumn("header", header).withColumn("again", F.coalesce(again, F.lit(False)))
    block = F.when(F.col("again"), F.col("header")).otherwise(F.concat("header", "html"))
    refers = F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("response")), F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"))).otherwise("")
    fields = [
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit(f"{END}WARC-Record-ID: "), name(F.col("id")), F.lit(f"{END}WARC-Date: "), when,
        F.lit(f"{END}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(END), refers,
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK), block,
    ]
    return told.select(F.concat(*fields).alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 500, **names) -> None:
    records(pages, **names).write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _page(name: bytes) -> int | None:
    number = name.strip(b"<>").rpartition(b":")[2]
    return None if number == b"null" else int(number)


def parsed(data: bytes, archive: str | None = None) -> Iterator[dict]:
    """The captures of one archive, each with its offset in the unpacked bytes; ``ValueError`` if a payload doesn't have its digest."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].split(b"\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(fields[b"content-length"])
        split = data.index(b"\r\n\r\n", begin) + 4
        kind = fields[b"warc-type"].decode()
        digest = fields[b"warc-payload-digest"].partition(b":")[2].decode()
        http = dict(x.lower().split(b": ", 1) for x in data[begin : split - 4].split(b"\r\n")[1:])
        if kind == "response" and base64.b32encode(hashlib.sha1(data[split:end]).digest()).decode() != digest:
            raise ValueError(f"payload digest of {fields[b'warc-record-id']!r} doesn't match")
        yield {
            "url": fields[b"warc-target-uri"].decode(), "timestamp": re.sub(r"\D", "", fields[b"warc-date"].decode()), "page_id": _page(fields[b"warc-record-id"]), "payload_digest": digest, "record_type": kind,
            "payload_bytes": end - split if kind == "response" else int(http[b"content-length"]), "refers_to": _page(fields[b"warc-refers-to"]) if kind == "revisit" else None, "archive": archive, "offset": at,
        }
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a capture, as in CAPTURES."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist(list(parsed(gzip.decompress(data.as_py()), name.as_py().rpartition("/")[2])), _ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(captures, CAPTURES)


def url_key(url: str) -> str:
    """The host's labels from last to first, then port, path and query; scheme, fragment and case of the host don't matter."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip()
    port = "" if port in (None, 80, 443) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def _sort_key(url: str, timestamp: str, page: int | None) -> bytes:
    number = b"\x00" * 9 if page is None else b"\x01" + (page + (1 << 63)).to_bytes(8, "big")
    return url_key(url).encode() + b"\x00" + timestamp.encode() + b"\x00" + number


def merged_index(captures: DataFrame, per_range: int = 50_000, keys_per_range: int = 8) -> DataFrame:
    """Captures with range, place and urlkey, where place counts all captures in order of URL key, time and id from 0.

    Ranges are as many as the captures need, cut at sampled keys: the driver holds ``keys_per_range`` keys a range.
    """
    total = captures.count()
    ranges = max(1, -(-total // per_range))
    share = min(1.0, keys_per_range * ranges / max(1, total)) if ranges > 1 else 0
    drawn = captures.where(F.pmod(F.xxhash64("url", "timestamp", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("url", "timestamp", "page_id").collect() if share else []
    keys = sorted(_sort_key(r.url, r.timestamp, r.page_id) for r in drawn)
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    columns = _ARROW.names
    out = pa.schema([("range", pa.int32()), ("place", pa.int64()), ("urlkey", pa.string()), *_ARROW])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(((_sort_key(r["url"], r["timestamp"], r["page_id"]), i, r) for i, r in enumerate(batch.to_pylist())), key=lambda x: x[:2])
            pieces: dict[int, list] = {}
            for key, _, row in rows:
                pieces.setdefault(bisect.bisect_right(bounds, key), []).append((key, row))
            made = []
            for number, own in pieces.items():
                coded = list(front_coded(k for k, _ in own))
                rests = b"".join(r for _, r in coded)
                made.append({"range": number, "shared": [n for n, _ in coded], "sizes": [len(r) for _, r in coded], "rests": zlib.compress(rests, 1), "rows": [r for _, r in own]})
            yield pa.RecordBatch.from_pylist(made, pa.schema([("range", pa.int32()), ("shared", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("rests", pa.binary()), ("rows", pa.list_(pa.struct(list(_ARROW))))]))

    def opened(run: tuple) -> Iterator[tuple[int, bytes, dict]]:
        rests, at = zlib.decompress(run[2]), 0
        for n, size, row in zip(run[0], run[1], run[3], strict=True):
            yield n, rests[at : at + size], row
            at += size

    def together(number: int, own: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = []
        for place, (_, key, row) in enumerate(merged([decoded(opened(r)) for r in own])):
            rows.append({"range": number, "place": place, "urlkey": key.partition(b"\x00")[0].decode(), **row})
            if len(rows) == 8192:
                yield pa.RecordBatch.from_pylist(rows, out)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, out)

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for number, *run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    yield from together(now, own)
                    now, own = number, []
                own.append(run)
        yield from together(now, own)

    struct = ", ".join(f"{c}: {t}" for c, t in (x.split() for x in CAPTURES.split(", ")))
    made = captures.select(*columns).mapInArrow(runs, f"range int, shared array<int>, sizes array<int>, rests binary, rows array<struct<{struct}>>")
    index = written(made.repartition("range").sortWithinPartitions("range").mapInArrow(merging, f"range int, place long, urlkey string, {CAPTURES}"), "index")
    before, firsts = 0, []
    for row in index.groupBy("range").count().orderBy("range").collect():  # one row a range
        firsts.append((row["range"], before))
        before += row["count"]
    first = captures.sparkSession.createDataFrame(firsts, "range int, first long")
    return index.join(F.broadcast(first), "range").withColumn("place", F.col("place") + F.col("first")).drop("first")


def captured(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, per_range: int = 50_000) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back, and returns the merged index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key=key, url=url, html=html, revisit_from=revisit_from)
    return merged_index(written(read_archives(spark, path), "captures"), per_range)
