"""WARC archives: writing page records with revisits, and reassembly of segmented records.

Writing. Payload lengths and digests are Spark expressions. Of pages with equal payloads of at least MIN_REVISIT
bytes, the one with the largest page_id is stored and the others refer to it. A record's block is an HTTP response in
chunked transfer framing; blocks over SEGMENT_BYTES are cut into a first record and continuation records. Records are
written with Spark's text writer, with the end of a WARC record as line separator, gzipped.

Reading. Each archive is parsed in a task. Segments are grouped by the identifier of their origin, ordered by number
and verified against the total length, and the joined block is decoded from its chunks. Revisits take length and
digest from the record that they refer to.

Every row is a record with a number of its own in its identifier, beside its page_id. An archive holds at most ARCHIVE_RECORDS records, so it is parsed in bounded memory; a group is one record's
segments. A payload that stands on a third of all pages is one row of the digest table: its key is pre-aggregated, and
its pages find it by a salted key, without their payloads.

Defined results: null and empty html is an empty payload, always a response; a null url is written as an empty target;
records of which segments are missing, or don't add up to the total length, have null payload columns and
``complete`` false; extra columns are ignored; rows that repeat a page_id or have none are records of their own, and
of equal payloads with an equal largest page_id, one record is stored; a null page_id is smaller than any other; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import cut, delete, drop_cut, shared_dir, table

MIN_REVISIT, SEGMENT_BYTES, HTTP_CHUNK, ARCHIVE_RECORDS = 1000, 8192, 4096, 10_000
SALTS = 16
END = b"\r\n\r\n"
URN = "urn:page:"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), HTTP_CHUNK):
        piece = payload[at : at + HTTP_CHUNK]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it says")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, str | int], block: bytes) -> bytes:
    """One WARC record without the two line ends behind it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def named(record: int, page_id: int | None) -> str:
    """The identifier of a record."""
    return f"{URN}{record}:{'' if page_id is None else page_id}"


def page_records(identifier: str, url: str, payload: bytes | None, digest: str, refers_to: str | None) -> Iterator[bytes]:
    """The records of a page: one, or a first segment and its continuations. A revisit needs no payload."""
    target = "".join(c for c in url if c > " ")
    common = {"WARC-Record-ID": f"<{identifier}>", "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record({"WARC-Type": "revisit", "WARC-Profile": profile, "WARC-Refers-To": f"<{refers_to}>"} | common, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record({"WARC-Type": "response"} | common, block)
        return
    yield record({"WARC-Type": "response"} | common | {"WARC-Segment-Number": 1}, block[:SEGMENT_BYTES])
    for number, at in enumerate(range(SEGMENT_BYTES, len(block), SEGMENT_BYTES), 2):
        piece = block[at : at + SEGMENT_BYTES]
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{identifier}:{number}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<{identifier}>", "WARC-Segment-Number": number}
        yield record(fields | ({"WARC-Segment-Total-Length": len(block)} if at + SEGMENT_BYTES >= len(block) else {}), piece)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        head = data.index(END, at)
        first, *lines = data[at:head].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = head + len(END)
        stop = start + int(fields["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield fields, data[start:stop]
        at = stop + len(END)


def unpacked(data: bytes) -> bytes:
    """Of a gzip file of one or more members; other data stays."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts) if parts else data


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def salted(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """``rows``, by salts of their ``record``, joined with the table ``few`` that has a row for a key, given to each salt."""
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("record", F.lit(SALTS)).cast("int")).join(spread, [key, "salt"], how).drop("salt")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages ``(page_id, url, html)`` as WARC files to a folder."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"))
    rows = cut(rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")}))
    long = rows.filter(F.col("size") >= MIN_REVISIT).select("record", "page_id", "url", "digest")
    stored = long.groupBy("digest").agg(F.max(F.struct("page_id", "record")).alias("stored"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = cut(salted(long, stored, "digest", "inner").filter("stored.record <> record"))
    responses = rows.join(revisits.select("record"), "record", "left_anti").withColumn("stored", F.lit(None).cast(stored.schema["stored"].dataType))
    columns = "record", "page_id", "url", "payload", "digest", "stored"
    judged = responses.select(*columns).union(revisits.withColumn("payload", F.lit(None).cast("binary")).select(*columns))
    schema = pa.schema([("record", pa.binary())])

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, held = [], 0
            for record, page_id, url, payload, digest, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers_to = None if stored is None else named(stored["record"], stored["page_id"])
                for made in page_records(named(record, page_id), url, payload, digest, refers_to):
                    out.append(made)
                    held += len(made)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)

    records = judged.mapInArrow(written, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)
    drop_cut(rows)
    drop_cut(revisits)


PIECE = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("target", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
PIECE_SQL = "record long, page_id long, kind string, target long, refers_to long, digest string, bytes long, sha1 string, number long, total long, block binary"


def page_of(identifier: str) -> tuple[int, int | None]:
    """Number of the record and page_id in an identifier."""
    record, page_id, *_ = identifier.strip("<>").removeprefix(URN).split(":")
    return int(record), int(page_id) if page_id else None


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder: whole ones with length and digest of their payload, parts with their block."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch["content"]:
                out = []
                for fields, block in parse(unpacked(content.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    mine = page_of(fields["warc-segment-origin-id" if kind == "continuation" else "warc-record-id"])
                    if kind == "continuation":
                        total = fields.get("warc-segment-total-length")
                        out.append((*mine, None, None, None, None, None, None, int(fields["warc-segment-number"]), int(total) if total else None, block))
                    elif "warc-segment-number" in fields:
                        out.append((*mine, kind, None, None, digest, None, None, 1, None, block))
                    elif kind == "revisit":
                        out.append((*mine, kind, *page_of(fields["warc-refers-to"]), digest, None, None, None, None, None))
                    else:
                        payload = payload_of(block)
                        out.append((*mine, kind, None, None, digest, len(payload), hashlib.sha1(payload).hexdigest(), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(PIECE)], schema=PIECE)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(rows, PIECE_SQL)


READ = pa.schema([*list(PIECE)[:8], ("complete", pa.bool_())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(record, page_id, kind, target, refers_to, digest, bytes, sha1, complete)`` of each logical record, segments joined."""
    pieces = segments(spark, path)
    first = lambda c: F.max(c).alias(c)  # noqa: E731  one segment of a record at most has a value
    parts = F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("number", "block")))).alias("parts")
    joined = pieces.groupBy("record").agg(*(first(c) for c in (*READ.names[1:8], "total")), parts)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for row in batch.to_pylist():
                complete = row["kind"] is not None
                if row["parts"]:
                    by_number = {p["number"]: p["block"] for p in row["parts"]}
                    block = b"".join(by_number[n] for n in sorted(by_number))
                    complete = complete and row["total"] == len(block) and len(by_number) == max(by_number)
                    if complete:
                        payload = payload_of(block)
                        row |= {"bytes": len(payload), "sha1": hashlib.sha1(payload).hexdigest()}
                out.append(row | {"complete": complete})
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in READ], schema=READ)

    return joined.mapInArrow(rows, "record long, page_id long, kind string, target long, refers_to long, digest string, bytes long, sha1 string, complete boolean")


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits taking length and digest of the payload that they refer to."""
    revisits = records.filter("kind = 'revisit'")
    stored = records.filter("kind = 'response'").select(F.col("record").alias("target"), F.col("bytes").alias("stored_bytes"), F.col("sha1").alias("stored_sha1"))
    stored = stored.join(revisits.select("target").distinct(), "target", "left_semi")
    revisits = salted(revisits, stored, "target", "left")
    agree = F.coalesce(F.col("stored_sha1") == F.col("digest"), F.lit(False))
    revisits = revisits.select("page_id", "kind", "refers_to", F.when(agree, F.col("stored_bytes")).alias("bytes"), F.when(agree, F.col("stored_sha1")).alias("sha1"), agree.alias("complete"))
    return records.filter("kind is null or kind <> 'revisit'").select(*revisits.columns).union(revisits)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = cut(resolved(cut(read_archives(spark, path))))
    delete(spark, path)
    return found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
s AS (SELECT d, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN s.stored IS NULL OR s.stored = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.stored <> p.page_id THEN s.stored END AS refers_to
FROM p LEFT JOIN s ON p.d = s.d AND p.n >= 1000
"""
