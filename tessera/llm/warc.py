"""WARC archives: written with revisits and segments, read back with segments put together again.

A page becomes a response record with an HTTP message in chunked framing. Of pages with equal payloads of some size, only
one is a response; the others are revisit records that refer to it. A record longer than a segment is split into a
first segment and continuation records. Reading groups continuations by the id of their origin, orders them by number, verifies
numbers and total length, and decodes the chunked framing. Archives are written by Spark's own text writer, with the
end of a record as the end of a line, so they go to any file system Spark can write and survive retried tasks.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize

#: Payloads of fewer bytes are never revisited.
REVISIT_FROM = 1000
#: Bytes of a segment, and of a chunk in its framing.
SEGMENT, CHUNK = 64 * 1024, 8 * 1024
#: Records of one archive file.
RECORDS = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
SALTS = 8


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for k in range(0, len(payload), size) for p in [payload[k : k + size]]]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a ValueError if the framing is broken. Extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0 or not n:
            if n < 0:
                raise ValueError("negative chunk size")
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_payload(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = message.partition(b"\r\n\r\n")
    if re.search(rb"\r\ntransfer-encoding:[^\r]*\bchunked\b", b"\r\n" + head, re.I):
        return unchunked(body)
    return body


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def records_of(key: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str, segment: int) -> list[bytes]:
    """The records of one page, without the empty lines that end a record."""
    rid = f"<urn:page:{key}>"
    url = re.sub(r"[\r\n]+", " ", url)
    common = [("WARC-Date", date), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        block = HTTP + b"\r\n"
        return [_head([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_head([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, kind, ("Content-Length", len(block))]) + block]
    out = [_head([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, kind, ("WARC-Segment-Number", 1), ("Content-Length", len(parts[0]))]) + parts[0]]
    for k, p in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total), ("Content-Length", len(p))]) + p)
    return out


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", page_html: str = "html", date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, revisit_from: int = REVISIT_FROM) -> None:
    """Writes a record for every row: key <page id>.<row>, payload the html in UTF-8, null as empty.

    Of rows with equal payloads of at least `revisit_from` bytes, the one with the largest page id (a null id is the
    smallest; for a repeated id, the later row) is the response. No rows write an archive without records.
    """
    p = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(page_html).cast("string").cast("binary"), F.lit(b"")).alias("body"), F.monotonically_increasing_id().alias("row"))
    p = p.withColumn("sha1", F.sha1("body"))
    large = p.where(F.octet_length("body") >= revisit_from)
    heads = large.groupBy("sha1").agg(F.max(F.struct("id", "row")).alias("head"), F.count("*").alias("n")).where("n > 1")
    # a payload that a third of all pages share is met on SALTS sides at once
    heads = heads.select(F.col("sha1").alias("digest"), "head", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("part"))
    p = p.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    told = p.join(heads, (F.col("sha1") == F.col("digest")) & (F.col("salt") == F.col("part")) & (F.octet_length("body") >= revisit_from), "left")

    def key(i: str, row: str):
        return F.concat(F.coalesce(F.col(i).cast("string"), F.lit("")), F.lit("."), F.col(row).cast("string"))

    other = F.col("head").isNotNull() & (F.col("head.row") != F.col("row"))
    rows = told.select(key("id", "row").alias("key"), "url", "body", "sha1", F.when(other, key("head.id", "head.row")).alias("refers"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = [r for row in zip(*(part.column(c).to_pylist() for c in range(5))) for r in records_of(*row, date, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def split_records(data: bytes):
    """(fields by lower-case name, block) of each record of an archive, gzipped as a whole, by record or not at all."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            out.append(z.decompress(data))
            data = z.unused_data
        data = b"".join(out)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n:
            raise ValueError(f"record at byte {at} is cut")
        yield fields, block
        at = end + 4 + n


RECORD = "record_id string, type string, target_uri string, digest string, refers_to string, length long, origin string, number int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in a folder, in any framing; a file must fit a worker's memory."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for f, block in split_records(data.as_py()):
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), digest, f.get("warc-refers-to"), int(f["x-payload-length"]) if "x-payload-length" in f else None, f.get("warc-segment-origin-id"), int(f["warc-segment-number"]) if "warc-segment-number" in f else None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], [x.split()[0] for x in RECORD.split(", ")])

    # no listing of columns that need the files' content twice; one file at a time in a batch
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def payloads(records: DataFrame) -> DataFrame:
    """(record_id, type, target_uri, digest, refers_to, length, payload, error) of each record that is no continuation.

    A segmented record is put together from all its segments; missing or repeated numbers, a total length that is absent or wrong,
    and broken framing give a null payload and say so in error. Continuations without their origin give an error row too.
    """
    out = "record_id string, type string, target_uri string, digest string, refers_to string, length long, payload binary, error string"
    names = [x.split()[0] for x in out.split(", ")]

    def decode(kind: str | None, block: bytes | None) -> tuple[bytes | None, str | None]:
        if kind not in ("response", "request", "revisit"):
            return block, None
        try:
            return http_payload(block or b""), None
        except ValueError as e:
            return None, str(e)

    def whole(batches):
        for b in batches:
            got = [decode(k, x) for k, x in zip(b.column(1).to_pylist(), b.column(9).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(6)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names)

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("number")
        r = {c: t[c].to_pylist() for c in t.column_names}
        error = payload = None
        if r["number"] != list(range(1, len(r["number"]) + 1)):
            error = f"segments {r['number']}"
        else:
            block = b"".join(r["block"])
            if r["total"][-1] != len(block):
                error = f"{len(block)} bytes of {r['total'][-1]}"
            else:
                payload, error = decode(r["type"][0], block)
        rid = r["record_id"][0] if r["number"][0] == 1 else r["origin"][0]
        row = [rid, *(r[c][0] for c in ("type", "target_uri", "digest", "refers_to", "length")), payload, error]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds)})

    segments = records.where("number is not null").withColumn("first", F.coalesce("origin", "record_id"))
    joined = segments.groupBy("first").applyInArrow(together, out)
    return records.where("number is null").mapInArrow(whole, out).unionByName(joined)


def round_trip(pages: DataFrame, path: str, **parameters) -> DataFrame:
    """Writes the archives to path, reads them back, and gives each page's payload as read: page_id, row, type, digest, length, refers_to, payload, error."""
    write_archives(pages, path, **parameters)
    spark = pages.sparkSession
    got = payloads(materialize(read_records(spark, path), "warc-records"))

    def part(of: str, k: int):
        return F.nullif(F.regexp_extract(of, r"^<urn:page:(-?\d*)\.(\d+)>$", k), F.lit("")).cast("long")

    return got.select(part("record_id", 1).alias("page_id"), part("record_id", 2).alias("row"), "type", "digest", "length", part("refers_to", 1).alias("refers_to"), "payload", "error")
