"""WARC archives: writing pages, reading records, reassembling segments (operator 8).

``write_archives`` turns pages into WARC/1.1 records. Of pages with equal
payloads of at least ``least_revisit`` bytes the one with the least page_id is a
response, the others are revisits of it. A response is an HTTP message with a
chunked body; a message longer than ``segment_bytes`` is cut into a first record
and continuation records. Spark's text writer puts the records into gzip files in
the shared folder, a bounded number in each.

``read_records`` parses archives that Spark's binaryFile reader loads, whichever
file system they are on. ``reassemble`` groups continuation records by origin,
orders them by segment number, verifies that the numbers are complete and the
length is WARC-Segment-Total-Length, takes off the HTTP head and decodes the
chunked framing. A group holds the segments of one record.

A null html is an empty payload, a null url has no WARC-Target-URI, and line ends
in an url are dropped. Every row is a record of its own and comes back, also where
rows repeat; of a repeated payload all rows with the least page_id are responses.
Rows without page_id are responses, unless a row with one has the payload.

A record has ``segment_bytes`` bytes and its head at most, so ``per_file`` records
bound the bytes of an archive too (33 MB as set, before compression). Archives from
elsewhere may be as large as binaryFile loads, 2 GB.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .screen import Screen, cut, new_folder, split

CHUNK = 4096
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"


def _pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about size bytes, cut between characters."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        yield raw[at:end]
        at = end


def chunked(body: bytes) -> bytes:
    """HTTP chunked framing of body."""
    out = [b"%x\r\n%b\r\n" % (len(p), p) for p in _pieces(body, CHUNK)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes | None:
    """The body of a chunked framing; None if it is broken or cut short."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size := framed[at:end].split(b";")[0].strip()):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        at = end + 2 + n + 2
        if at > len(framed) or framed[at - 2 : at] != b"\r\n":
            return None
        out.append(framed[end + 2 : at - 2])


def payload_of(block: bytes) -> bytes | None:
    """The decoded body of an HTTP message; None if it is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else body


def _record(kind: str, rid: str, block: bytes, **fields) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]) + block.decode()


def _uuid(*parts: object) -> str:
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def records_of(page_id, url, html: str, digest: str, row: str, head, head_url, segment_bytes: int) -> Iterator[str]:
    """The records of a page; row names it among all, head and head_url are the
    response's page_id and url for a revisit."""
    raw = html.encode("utf-8")
    rid = _uuid(row, page_id, digest)
    common = {"WARC_Target_URI": re.sub(r"[\r\n]+", "", url) if url else None, "WARC_Payload_Digest": f"sha256:{digest}", "X_Payload_Length": len(raw), "X_Page_Id": page_id}
    if head is not None and head != page_id:
        target = re.sub(r"[\r\n]+", "", head_url) if head_url else None
        yield _record("revisit", rid, b"", **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To_Target_URI=target, WARC_Refers_To_Date=_DATE, X_Refers_To_Page_Id=head)
        return
    block = _HEAD.encode() + chunked(raw)
    if len(block) <= segment_bytes:
        yield _record("response", rid, block, **common, Content_Type="application/http;msgtype=response")
        return
    parts = list(_pieces(block, segment_bytes))
    yield _record("response", rid, parts[0], **common, WARC_Segment_Number=1, Content_Type="application/http;msgtype=response")
    for i, part in enumerate(parts[1:], 2):
        yield _record("continuation", _uuid(rid, i), part, WARC_Segment_Origin_ID=f"<urn:uuid:{rid}>", WARC_Segment_Number=i, WARC_Segment_Total_Length=len(block) if i == len(parts) else None)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16384, least_revisit: int = 100, per_file: int = 2000) -> None:
    """Write pages(page_id, url, html) as gzip WARC files to path."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    heads = pages.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("head"), F.count("*").alias("c")).where("c > 1")
    heads = cut(heads.select(F.xxhash64("digest").alias("k"), F.col("digest").alias("d"), F.col("head.page_id").alias("head"), F.col("head.url").alias("head_url")))
    several, single = split(pages, F.xxhash64("digest"), Screen.of(heads, "k"))
    # a name for each row, unlike those of the other branch
    row = lambda branch: F.concat(F.lit(branch), F.monotonically_increasing_id().cast("string")).alias("row")
    several = several.join(heads, F.col("digest") == F.col("d"), "left").select(*single.columns, row("m"), "head", "head_url")
    single = single.select("*", row("s"), F.lit(None).cast("long").alias("head"), F.lit(None).cast("string").alias("head_url"))

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for a in range(0, batch.num_rows, 256):
                out = []
                for row in zip(*(c[a : a + 256].to_pylist() for c in cols), strict=True):
                    out += records_of(*row, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records = single.mapInArrow(run, "value string").unionAll(several.mapInArrow(run, "value string"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of the records of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
            else:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                last = name.strip().lower()
                fields[last] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", "0")))


_READ = "rid string, kind string, page_id long, uri string, refers_to long, digest string, n long, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path. Responses that are not segmented
    come with digest and length (n) of their decoded payload, and without block."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                rows: list[tuple] = []
                for f, block in parse(stream):
                    number = lambda name: int(f[name]) if f.get(name) else None  # noqa: B023, E731
                    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
                    segment, digest, n = number("warc-segment-number"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, number("x-payload-length")
                    kind = f.get("warc-type")
                    if kind == "response" and segment is None:
                        body = payload_of(block)
                        digest, n = (hashlib.sha256(body).hexdigest(), len(body)) if body is not None else (None, None)
                    rows.append((origin, kind, number("x-page-id"), f.get("warc-target-uri"), number("x-refers-to-page-id"), digest, n, segment, number("warc-segment-total-length"), block if segment is not None else None))
                    if len(rows) == 512:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in _READ.split(", ")), strict=True)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _READ)


def reassemble(records: DataFrame) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to,
    n_segments, intact): a row for each origin record. intact is false, and the
    payload's columns are null, if segments are missing or the framing is broken."""
    whole = records.groupBy("rid").agg(
        *(F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c) for c in ("kind", "page_id", "uri", "refers_to", "digest", "n")),
        F.max("total").alias("total"), F.array_sort(F.collect_set(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("own"),
    )
    # a record without its first segment has no fields of its own
    complete = (F.size("own") == F.element_at("own", -1)["segment"]) & (F.element_at("own", 1)["segment"] == 1)
    joined = F.expr("aggregate(own, cast('' AS binary), (a, x) -> concat(a, x.block))")
    whole = whole.withColumn("n_segments", F.greatest(F.size("own"), F.lit(1)))
    whole = whole.withColumn("block", F.when(F.size("own") > 0, F.when(complete & (F.octet_length(joined) == F.col("total")), joined))).withColumn("cut", F.size("own") > 0).drop("own")
    out = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int, intact boolean"

    def run(batches):
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in ("kind", "digest", "n", "cut", "block")}
            digest, n, intact = list(col["digest"]), list(col["n"]), [d is not None for d in col["digest"]]
            for i, was_cut in enumerate(col["cut"]):
                if was_cut:
                    body = payload_of(col["block"][i]) if col["block"][i] is not None else None
                    intact[i] = body is not None and hashlib.sha256(body).hexdigest() == digest[i]
                    digest[i], n[i] = (hashlib.sha256(body).hexdigest(), len(body)) if body is not None else (None, None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("uri"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(col["kind"], pa.string()), batch.column("refers_to"), batch.column("n_segments"), pa.array(np.array(intact, bool))],
                names=[x.split()[0] for x in out.split(", ")],
            )

    return whole.mapInArrow(run, out)


def op8_query(spark, sf_dir: str) -> DataFrame:
    """Contract: pages written to archives in the shared folder and read back."""
    path = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return reassemble(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "intact")
