"""WARC archives: writing captures, reading records back, joining the records of a capture.

A record is text in UTF-8, and two line ends close it: Spark's text sink with that line end writes valid
archives under its commit protocol, so that a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import whole, with_ids, written
from tidemark.operators.spread import lookup_join, spread_join

MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CAPTURES_PER_FILE = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"

RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to string, "
    "payload_digest string, stated_bytes long, payload_bytes long, payload_sha256 string, fields string, payload binary"
)


def _urn(kind: str, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str | Column, record_id: Column, headers: dict[str, Column], block: Column) -> Column:
    """A whole record but for the two line ends that close it; headers that are null are left out."""
    fields = {"WARC-Type": F.lit(kind) if isinstance(kind, str) else kind, "WARC-Record-ID": record_id,
              "WARC-Date": F.lit(DATE), **headers, "Content-Length": F.octet_length(block).cast("string")}
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines), F.lit(END * 2), block)


def warc_records(pages: DataFrame, key: str, url: str, html: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Three records a page as text (``value``): request, response or revisit, metadata.

    Of pages with equal payloads (the html in UTF-8) of at least ``min_bytes`` bytes the smallest key is
    written as a response, others as revisits that refer to it and leave the payload out. Smaller payloads
    are all responses. Request and metadata name the response or revisit they are concurrent to. Of rows that repeat
    the smallest key and payload one is the response; a null key counts as the largest.
    """
    payload = whole(F.col(html))
    rows = pages.select(
        F.col(key).alias("_key"),
        F.nullif(F.translate(F.col(url), "\r\n", ""), F.lit("")).alias("_url"),
        payload.alias("_payload"),
        F.octet_length(payload).alias("_bytes"),
        F.sha2(payload, 256).alias("_digest"),
    )
    rows = with_ids(rows, "_key")
    large = rows.where(F.col("_bytes") >= min_bytes)
    least = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_id")).alias("_least")
    first = large.groupBy("_digest").agg(least, F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = written(first.select("_digest", F.col("_least._id").alias("_first")), "warc-copies")
    rows = lookup_join(rows, first, ["_digest"], "left", ["_id"])

    again = F.coalesce(F.col("_id") != F.col("_first"), F.lit(False))
    capture = _urn("capture", F.col("_id"), F.col("_digest"))
    uri = {"WARC-Target-URI": F.col("_url")}
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("_bytes").cast("string"),
        F.lit(END * 2),
    )
    answer = _record(
        F.when(again, "revisit").otherwise("response"),
        capture,
        {
            **uri,
            "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("_digest")),
            "WARC-Profile": F.when(again, F.lit(PROFILE)),
            "WARC-Refers-To": F.when(again, _urn("capture", F.col("_first"), F.col("_digest"))),
            "Content-Type": F.lit("application/http;msgtype=response"),
        },
        F.concat(http, F.when(again, F.lit("")).otherwise(F.col("_payload"))),
    )
    host = F.regexp_extract(F.coalesce(F.col("_url"), F.lit("")), r"^[a-z]+://([^/?#]+)", 1)
    to = {**uri, "WARC-Concurrent-To": capture}
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("_url"), F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2))
    request = _record(
        "request",
        _urn("request", F.col("_id"), F.col("_digest")),
        {**to, "Content-Type": F.lit("application/http;msgtype=request")},
        asked,
    )
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(END))
    metadata = _record(
        "metadata",
        _urn("metadata", F.col("_id"), F.col("_digest")),
        {**to, "Content-Type": F.lit("application/warc-fields")},
        about,
    )
    return rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write_warc(records: DataFrame, path: str, per_file: int = CAPTURES_PER_FILE) -> None:
    """Write records as gzipped archives of at most ``per_file`` captures, by which readers' memory is bounded.

    A file is one gzip member, not one for each record.
    """
    options = {"lineSep": END * 2, "compression": "gzip", "maxRecordsPerFile": 3 * per_file}
    records.write.options(**options).text(path)


class _Source:
    """Bytes of an archive, inflated piece by piece if they are gzipped (any number of members)."""

    def __init__(self, raw: bytes, piece: int = 1 << 20):
        self.raw, self.piece, self.at, self.buffer = memoryview(raw), piece, 0, bytearray()
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + self.piece]
        self.at += len(part)
        if self.inflate is None:
            self.buffer += part
            return True
        part = bytes(part)
        while part:
            self.buffer += self.inflate.decompress(part)
            part = self.inflate.unused_data
            if part:
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed too; None if it does not come."""
        start = 0
        while (found := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        head = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        if len(self.buffer) < n:
            raise ValueError(f"the archive ends within a record: {n} bytes wanted, {len(self.buffer)} left")
        block = bytes(self.buffer[:n])
        del self.buffer[:n]
        return block


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split(END) if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_archive(raw: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of one archive, in the order of the columns of RECORD."""
    source = _Source(raw)
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        version, _, lines = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {version[:40]!r}")
        fields = _headers(lines)
        block = source.take(int(fields["content-length"]))
        kind, payload, stated, about = fields["warc-type"], None, None, None
        if kind in ("response", "revisit"):
            answer, _, payload = block.partition(b"\r\n\r\n")
            length = _headers(answer).get("content-length", "")
            stated = int(length) if length.isdigit() else None
        elif kind == "metadata":
            about = block.decode("utf-8", "replace")
        yield (
            fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"),
            fields.get("warc-date"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
            stated, None if payload is None else len(payload),
            None if payload is None else hashlib.sha256(payload).hexdigest(),
            about, payload if payloads else None,
        )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, gzipped or not, whatever their names (columns: RECORD).

    Each archive is read by one task, record by record. ``payloads=False`` leaves the bytes of payloads
    out; their length and digest are there all the same. A record cut short is an error.
    """
    names = [part.split()[0] for part in RECORD.split(", ")]

    def parse(batches):
        for batch in batches:
            for raw in batch["content"]:
                rows, held = [], 0
                for row in parse_archive(raw, payloads):
                    rows.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.load(path).select("content").mapInPandas(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, target_uri, date, response, request, metadata).

    Requests and metadata join the response or revisit that their concurrent-to identifier names; without
    one they are a capture of their own, with a null response. Records repeated with one identifier are
    one record. Of several requests (or metadata) of a capture, the one with the smallest identifier is
    given. A record without an identifier takes no part.
    """
    one = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))

    def part(name: str, *kinds: str) -> DataFrame:
        columns = [c for c in records.columns if c != "concurrent_to"]
        # spreads no copies of payloads: the identifiers are unique but for repeated records
        chosen = one.where(F.col("type").isin(*kinds) & F.col("record_id").isNotNull())
        by = "record_id" if name == "response" else "capture_id"
        return chosen.groupBy(F.col(by).alias("capture_id")).agg(F.min_by(F.struct(*columns), "record_id").alias(name))

    answers = part("response", "response", "revisit")
    joined = answers.join(part("request", "request"), "capture_id", "full")
    joined = joined.join(part("metadata", "metadata"), "capture_id", "full")
    first = lambda field: F.coalesce(*[F.col(f"{name}.{field}") for name in ("response", "request", "metadata")])
    return joined.select(
        "capture_id", first("target_uri").alias("target_uri"), first("date").alias("date"), "response", "request", "metadata"
    )


def captured_pages(captures: DataFrame) -> DataFrame:
    """Per page of an archive of ``warc_records``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are those of the bytes read back for a response, and those stated by a revisit.
    """
    answer = F.col("response")
    revisit = answer["type"] == "revisit"
    flat = captures.select(
        "capture_id",
        F.regexp_extract("metadata.fields", r"page-id: *([^\r\n]*)", 1).try_cast("long").alias("page_id"),
        F.when(revisit, answer["stated_bytes"]).otherwise(answer["payload_bytes"]).alias("payload_bytes"),
        F.when(revisit, answer["payload_digest"]).otherwise(answer["payload_sha256"]).alias("payload_digest"),
        answer["type"].alias("record_type"),
        answer["refers_to"].alias("_to"),
    )
    flat = written(flat, "warc-captures")
    again = flat.where(F.col("_to").isNotNull()).drop("capture_id")
    named = flat.where("record_type = 'response'").select(F.col("capture_id").alias("_to"), F.col("page_id").alias("refers_to"))
    resolved = spread_join(again, named, ["_to"], "left", ["page_id"])
    rest = flat.where(F.col("_to").isNull()).withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rest.select(*columns).unionByName(resolved.select(*columns))


def warc_round_trip(pages: DataFrame, key: str, url: str, html: str, path: str) -> DataFrame:
    """Write ``pages`` as archives below ``path``, read them back and give one row per page.

    A null html is an empty payload, a null url leaves the target out. Every row has records of its own and comes back,
    also one that repeats another. A null key comes back as null, and counts as the largest where the smallest is looked
    for. Other columns are ignored; an empty table gives no rows.
    """
    write_warc(warc_records(pages, key, url, html), path)
    return captured_pages(assemble(read_warc(pages.sparkSession, path, payloads=False)))
