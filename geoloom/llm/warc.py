"""WARC archives written from page tables, read back, and assembled into captures.

*Writing.*  Each page gives a request, a response or revisit, and a metadata record; the request and
the metadata are concurrent to the response.  Every record is a gzip member of its own, as
readers of such archives expect.  Members are rows of Spark's text sink, and the line separator is an
empty member, so archives go to any file system that Spark writes, under its commit protocol.
Of pages with equal payloads one is the response, which the others name as WARC-Refers-To.

*Reading.*  Archives written here are split at the empty members, so large files are read in
parallel (:func:`read_members`).  Any others come through Spark's binary file source, and are
unpacked and parsed as streams by their Content-Length (:func:`read_warc`).

*Assembly.*  Request, response and metadata records are joined through their concurrent-to
identifiers into one nested row for each capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.staging import materialize, stage_path

END = b"\r\n\r\n"
#: An empty gzip member, which unpacks to nothing.
EMPTY = gzip.compress(b"", mtime=0)
# Fixed value: the WARC 1.1 profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, kind string, concurrent_to string, target_uri string, date string, payload_digest string, refers_to_uri string, refers_to string, "
    "payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    """The URL with white space and control characters percent-encoded, or a URN of the page."""
    if not url:
        return f"urn:page:{'none' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def _record(kind: str, record_id: str, date: str, uri: str, content_type: str, block: bytes, **more: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": uri, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": content_type, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def _request(uri: str) -> bytes:
    """The request that asks for a URL; a page without one is asked for at a host that cannot exist."""
    parts = urlsplit(uri) if "://" in uri else None
    host = parts.netloc.rpartition("@")[2] if parts else ""
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "") if parts else "/"
    return f"GET {target} HTTP/1.1\r\nHost: {host or 'page.invalid'}\r\nUser-Agent: archive\r\nAccept: */*\r\n\r\n".encode()


def _records(run_id: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, count = uuid.UUID(run_id), 0
        space = uuid.uuid5(first, str(TaskContext.get().partitionId()))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                out = []
                for p in batch.slice(a, 64).to_pylist():
                    count += 1
                    ids = [f"<{uuid.uuid5(space, f'{count}-{k}').urn}>" for k in range(3)]
                    payload, uri = (p["html"] or "").encode("utf-8", "replace"), _uri(p["url"], p["page_id"])
                    digest = f"sha1:{base32_sha1(payload)}"
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    best = p["best"]
                    # the response that others refer to; where rows repeat the winner's id, none is the only one
                    named = None if best is None or best["n"] > 1 else f"<{uuid.uuid5(first, f'{p['sha']}-{best['page_id']}').urn}>"
                    if not p["revisits"]:
                        if named and best["page_id"] == p["page_id"]:
                            ids[0] = named
                        out.append(_record("response", ids[0], date, uri, "application/http; msgtype=response", http + payload, WARC_Payload_Digest=digest))
                    else:
                        there = {"WARC_Refers_To": named} if named else {}
                        out.append(_record("revisit", ids[0], date, uri, "application/http; msgtype=response", http, WARC_Payload_Digest=digest, WARC_Profile=PROFILE, **there, WARC_Refers_To_Target_URI=_uri(best["url"], best["page_id"]), WARC_Refers_To_Date=date))
                    out.append(_record("request", ids[1], date, uri, "application/http; msgtype=request", _request(uri), WARC_Concurrent_To=ids[0]))
                    fields = {"page-id": p["page_id"], "payload-bytes": len(payload), "refers-to-page-id": best["page_id"] if p["revisits"] else None, "has-url": int(p["url"] is not None)}
                    told = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
                    out.append(_record("metadata", ids[2], date, uri, "application/warc-fields", told, WARC_Concurrent_To=ids[0]))
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r + END, 6, mtime=0) for r in out], pa.binary())], names=["value"])

    return run


def records_of(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): the packed records of a page table, by the rules of :func:`write_warc`."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    large = F.octet_length("html") >= min_bytes
    pages_of = src.where(large & F.col("page_id").isNotNull()).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url"))
    best = pages_of.groupBy("sha").agg(F.max(F.struct("page_id", "n", "url")).alias("best"))
    best = materialize(best, "payload-winners")  # as a table of its own the join below has two exchanges, and Spark can split a hot payload
    joined = src.join(best, "sha", "left")
    revisits = F.coalesce(large & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id")), F.lit(False))
    rows = joined.select("page_id", "url", "html", "sha", F.when(large, F.col("best")).alias("best"), revisits.alias("revisits"))
    return rows.mapInArrow(_records(str(uuid.uuid4()), date), "value binary").select(F.col("value").cast("string").alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 60_000) -> None:
    """Write a page table (page_id, url, html) as WARC archives into ``path``, each record a gzip member.

    Of pages whose payloads (html in UTF-8, null as empty) are equal and have at least ``min_bytes``
    bytes, the one with the largest page_id is the response and the others revisit it; smaller
    ones are all responses.  Rows with the winner's own id are responses too, repeated rows among
    them, and revisits then name their URL only; a null id is below all others, and where only null ids share a payload
    all are responses.  Very long pages are records like any other.  An empty table gives no records.  Other columns are
    ignored, whatever their names.
    """
    records = records_of(pages, min_bytes, date)
    records.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an unpacked archive as (headers with lower-case names, block), read as a stream."""
    kept = bytearray()
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(kept) < n:
            x = next(chunks, None)
            if x is None:
                more = False
            else:
                kept.extend(x)
        return len(kept) >= n

    while True:
        while (end := kept.find(b"\r\n\r\n")) < 0 and fill(len(kept) + 1):
            pass
        if end < 0:
            if kept.strip():
                raise ValueError("an archive ends inside a record's header")
            return
        lines = bytes(kept[:end]).decode("utf-8", "replace").split("\r\n")
        while lines and not lines[0]:
            lines.pop(0)
        if not lines:
            del kept[: end + 4]
            continue
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("an archive ends inside a record's block")
        yield head, bytes(kept[end + 4 : end + 4 + size])
        del kept[: end + 4 + size]


def _unpacked(data: bytes, step: int = 1 << 20, taken: int = 1 << 16) -> Iterator[bytes]:
    """The content of a file, gzip members one after the other or plain, in pieces of at most ``step`` bytes; packed ones are taken in less."""
    if data[:2] != b"\x1f\x8b":
        for a in range(0, len(data), step):
            yield data[a : a + step]
        return
    view, at = memoryview(data), 0
    member = zlib.decompressobj(31)
    while at < len(view) or member.unconsumed_tail:
        raw = member.unconsumed_tail or view[at : at + taken]
        if not member.unconsumed_tail:
            at += len(raw)
        yield member.decompress(raw, step)
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 8 + [pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "kind", "concurrent_to", "target_uri", "date", "payload_digest", "refers_to_uri", "refers_to", "payload_bytes", "digest_ok", "fields", "payload"]
        rows, size = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                for head, block in parse(_unpacked(batch.column(0)[i].as_py())):
                    kind, digest = head["warc-type"], head.get("warc-payload-digest")
                    payload = fields = good = None
                    if kind in ("response", "request") and "application/http" in head.get("content-type", ""):
                        payload = block.partition(b"\r\n\r\n")[2]
                        good = None if digest is None else digest == f"sha1:{base32_sha1(payload)}"
                    elif head.get("content-type") == "application/warc-fields":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]
                    named = (head.get(k) for k in ("warc-concurrent-to", "warc-target-uri", "warc-date"))
                    rows.append((head["warc-record-id"], kind, *named, digest and digest.removeprefix("sha1:"), head.get("warc-refers-to-target-uri"), head.get("warc-refers-to"), None if payload is None else len(payload), good, fields, payload if with_payload else None))
                    size += len(block) if with_payload else 0
                    if len(rows) >= 2000 or size > 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in ``path``, plain or packed, one task for each file of at most 2 GB; ``digest_ok`` tells whether a payload has the digest that its header gives."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(with_payload), RECORD)


def read_members(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """As :func:`read_warc`, for archives of :func:`write_warc`: their files are split, and no file is too large."""
    rows = spark.read.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return rows.select(F.col("value").cast("binary").alias("content")).mapInArrow(_read(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: capture_id, target_uri, date, request, response, metadata.

    ``request`` and ``metadata`` are null where no record is concurrent to the capture.  The joins go
    over unique record ids, so no key is hot.
    """
    body = F.struct("record_id", "kind", "payload_digest", "refers_to_uri", "refers_to", "payload_bytes", "digest_ok", "payload")
    main = records.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), "target_uri", "date", body.alias("response"))
    asked = records.where("kind = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "payload_bytes", "payload").alias("request"))
    told = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return main.join(asked, "capture_id", "left").join(told, "capture_id", "left").select("capture_id", "target_uri", "date", "request", "response", "metadata")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of archives written from ``pages`` and read back.

    A revisit's response is found by the record id that it names; only where rows repeat the winner's id, and it
    names none, its metadata tell.  Rules for nulls, ties, repeated and long rows are those of :func:`write_warc`.
    """
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    records = materialize(read_members(spark, path, with_payload=False), "warc-records")
    field = lambda k: F.try_element_at("metadata.fields", F.lit(k)).cast("long")
    bad = F.raise_error(F.concat(F.lit("a payload differs from its digest in "), "capture_id"))
    kind = F.when(F.col("response.digest_ok") == F.lit(False), bad).otherwise(F.col("response.kind"))
    captures = assemble(records).select(
        "capture_id",
        field("page-id").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        kind.alias("record_type"),
        F.col("response.refers_to").alias("named"),
        F.when(F.col("response.refers_to").isNull(), field("refers-to-page-id")).alias("told"),
    )
    captures = materialize(captures, "captures")
    # only named responses, and as a projection of a table, so that a response with very many revisits can be split
    responses = captures.where("record_type = 'response'").select(F.col("capture_id").alias("named"), F.col("page_id").alias("found"))
    whole = captures.where("named IS NULL").withColumn("refers_to", F.col("told"))
    again = captures.where("named IS NOT NULL").join(responses, "named", "left").withColumn("refers_to", F.col("found"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(names).unionByName(again.select(names))
