"""WARC archives with revisit records.

Headers (id, url, digest, length and a second hash) are saved and shuffled by payload digest to find the original of each
group of equal payloads; every other record of the group becomes a revisit that refers to it and is written from its
header alone.  Payloads stay where they are: two bitmaps of fixed size, one of the digests of such groups and one of the
responses among what it marks, tell almost every row whether it is a response; only rows that both bitmaps mark (the
originals) are joined with the headers to be sure.

Records have fresh headers: the time of writing, ``urn:uuid`` record ids, ids and referred ids of pages in fields of their
own.  They are built by SQL functions and written by Spark's text writer, which takes any file system: a record's last
byte is the line feed that the writer adds.  Files are gzip streams of at most ``records_per_file`` records and
``file_bytes`` payload bytes (a longer payload has a file of its own), so readers hold one file of bounded size at a time;
a gzip member for each record would need a writer of another kind.

Results for odd input: null html is an empty payload; a null url gives no target URI, and control characters and
spaces in one are percent-encoded; records with null ids are written but never become an original while another of the
group has an id; rows that repeat the original's id and payload are responses too and share its record id; an empty table
gives no archive and reads back as no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._common import saved, ship

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(url: Column) -> Column:
    out = url
    for c in "\r\n\t ":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")


#: A bitmap has 2**BITS bits in rows of 1,024: 9 MB at most.  Where more keys than that are marked, more rows are joined.
BITS = 26
_KEY = ("digest", "size", "second")


def _place(columns: list[str]) -> tuple[Column, Column, Column]:
    """Row, word and bit of a bitmap for the values of some columns."""
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))
    return F.shiftrightunsigned(at, 10), F.shiftrightunsigned(at, 6) % 16, (at % 64).cast("int")


def _bitmap(rows: DataFrame, columns: list[str]) -> DataFrame:
    line, word, bit = _place(columns)
    marks = rows.select(line.alias("line"), word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mark"))
    words = [F.bit_or(F.when(F.col("word") == w, F.col("mark")).otherwise(F.lit(0).cast("long"))) for w in range(16)]
    return saved(marks.groupBy("line").agg(F.array(*words).alias("words")), "bitmap")


def _marked(rows: DataFrame, bitmap: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``rows`` with the boolean column ``name``: false only where the bitmap surely lacks the columns' values."""
    line, word, bit = _place(columns)
    found = rows.withColumn("line", line).join(F.broadcast(bitmap), "line", "left")
    mark = F.expr("shiftright(`at word`, `at bit`) & 1L") == 1
    found = found.withColumn("at word", F.get("words", word.cast("int"))).withColumn("at bit", bit)
    return found.withColumn(name, F.coalesce(mark, F.lit(False))).drop("line", "words", "at word", "at bit")


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return rows.select("page_id", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("second"))


def resolve_revisits(rows: DataFrame, headers: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Responses (with payload), and revisits with their original's id and url."""
    large = headers.filter(F.col("size") >= min_bytes)
    groups = large.groupBy(*_KEY).agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups.filter("n > 1 and original is not null").drop("n"), "groups")
    is_first = F.col("page_id").eqNullSafe(F.col("original"))
    revisits = large.join(groups.hint("merge"), list(_KEY)).filter(~is_first).withColumn("payload", F.lit(""))

    copied = _bitmap(groups, list(_KEY))
    maybe = _marked(large, copied, list(_KEY), "copied").filter("copied").join(groups.hint("merge"), list(_KEY), "left")
    sure = saved(maybe.filter(F.col("original").isNull() | is_first).select("page_id", *_KEY, F.col("original").isNotNull().alias("referred")).distinct(), "responses")
    kept = _bitmap(sure, ["page_id", *_KEY])

    rows = _marked(rows, copied, list(_KEY), "copied").withColumn("copied", F.col("copied") & (F.col("size") >= min_bytes))
    alone = rows.filter(~F.col("copied")).withColumn("referred", F.lit(False))
    doubtful = _marked(rows.filter("copied"), kept, ["page_id", *_KEY], "kept").filter("kept").drop("kept")
    names = {c: f"sure {c}" for c in ("page_id", *_KEY)}
    sure = sure.withColumnsRenamed(names)
    same = [doubtful[c].eqNullSafe(sure[n]) for c, n in names.items()]
    found = doubtful.join(sure.hint("merge"), same).drop(*names.values())
    # Random numbers of the parts of a union can be alike; the name of the part goes into record ids too.
    return alone.withColumn("branch", F.lit("alone")).unionByName(found.withColumn("branch", F.lit("first"))), revisits.withColumn("branch", F.lit("revisit"))


def record_text(date: str) -> Column:
    """A whole WARC/1.1 record but for its last line feed."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def named(*of: Column) -> Column:
        h = F.md5(F.concat_ws(" ", *(c.cast("string") for c in of), F.col("digest"), F.col("size").cast("string")).cast("binary"))
        return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))

    revisit = F.col("original").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.when(F.col("referred"), named(F.col("page_id"))).otherwise(named(F.uuid(), F.col("branch"), F.col("page_id"))))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, urn(named(F.col("original"))))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, _uri(F.col("original_url")))),
        line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-ID", F.col("original").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, date: str | None = None, records_per_file: int = 4096, file_bytes: int = 1 << 28) -> str:
    """Write deduplicated archives below ``folder`` and return it; ``date`` is that of writing, unless given."""
    rows = _rows(pages, id_col, url_col, html_col)
    headers = saved(rows.drop("payload"), "headers")
    responses, revisits = resolve_revisits(rows, headers, min_bytes)
    columns = ["page_id", "url", "payload", "digest", "size", "referred", "branch", "original", "original_url"]
    none = {"original": F.lit(None).cast("long"), "original_url": F.lit(None).cast("string")}
    records = responses.withColumns(none).select(*columns).unionByName(revisits.withColumn("referred", F.lit(False)).select(*columns))
    text = record_text(date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("value")
    # Payloads of like size share files: one write unless some payload is long.
    largest, most, low = headers.agg(F.max("size")).first()[0] or 0, records_per_file, -1
    while low < largest or low < 0:
        high = file_bytes // most if most > 1 else largest
        part = records if high >= largest and low < 0 else records.filter((F.col("size") > low) & (F.col("size") <= high))
        part.select(text).write.mode("append").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(folder)
        low, most = max(high, 0), max(1, most // 64)
    return folder


class _Inflated(io.RawIOBase):
    """The bytes of a gzip stream, without holding them all."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.z = memoryview(data), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while True:
            out = self.z.decompress(self.z.unconsumed_tail or self.data[self.at : self.at + 65536], len(b)) if not self.z.eof else b""
            if not self.z.unconsumed_tail:
                self.at += 65536
            if out or self.at >= len(self.data) + 65536:
                b[: len(out)] = out
                return len(out)
            if self.z.eof:
                self.data, self.at, self.z = memoryview(self.z.unused_data), 0, zlib.decompressobj(31)
                if not len(self.data):
                    return 0


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; raises on malformed input."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
            raise ValueError("record without its end")
        yield fields, block


def _page(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _summary(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its header")
    return _page(fields, "x-page-id"), stated, digest, fields["warc-type"], _page(fields, "x-refers-to-page-id")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = [_summary(*r) for r in parse_records(io.BufferedReader(_Inflated(content.as_py()), 1 << 16))]
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = [f.split()[0] for f in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives; payloads are checked against their digests."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_read, FIELDS)


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS original FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM q
"""
