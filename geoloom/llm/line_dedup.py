"""Removal of lines repeated across documents, with two Bloom filters.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.
Keys of at least ``min_chars`` code points found in at least two documents lose all
their lines but those in the smallest document that holds them.

1. One scan puts each document's distinct keys into a once-seen and a twice-seen filter.
2. A second scan sends on only the keys that the twice-seen filter suspects, as 128-bit
   digests with their document, never as text.
3. An exact count with map-side combining confirms them and picks the first document.
4. The digests to drop go to their documents, and one Arrow pass writes what is left.

The filter has a fixed size.  Beyond the keys that it can tell apart, more suspects are
shuffled, 40 bytes each, and the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.bloom import SCHEMA, bitmap_builder, collect_bitmap, contains
from geoloom.llm.staging import materialize
from geoloom.llm.textkit import as_bytes

BITS = 1 << 27


def line_key(line: bytes, min_chars: int = 10) -> bytes | None:
    """The key of a line, None if it is shorter than ``min_chars`` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def line_digests(text: bytes, min_chars: int = 10) -> list[bytes | None]:
    """For each line, the 128-bit digest of its key, None for a short one."""
    digest = xxhash.xxh3_128_digest
    keys = (line_key(x, min_chars) for x in text.split(b"\n"))
    return [None if k is None else digest(k) for k in keys]


def _distinct(text: bytes, min_chars: int) -> np.ndarray:
    """The text's distinct digests, as rows of two 64-bit words."""
    found = {d for d in line_digests(text, min_chars) if d is not None}
    return np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2)


def _filter_keys(min_chars: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = as_bytes(batch.column(0))
        for a in range(0, len(texts), 256):
            yield np.concatenate([_distinct(t, min_chars)[:, 0] for t in texts[a : a + 256]])

    return keys_of


def _suspects(shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a in range(0, len(texts), 256):
                found = [_distinct(t, min_chars) for t in texts[a : a + 256]]
                rows = np.repeat(np.arange(a, a + len(found)), [len(x) for x in found])
                keys = np.concatenate(found)
                hit = contains(bitmap, keys[:, 0])
                keys, rows = keys[hit].view(np.int64), pa.array(rows[hit])
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows)], names=["k1", "k2", "doc_id", "body"])

    return run


def _rewrite(min_chars: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = as_bytes(batch.column("__text")), batch.column("__drops").to_pylist()
            total, gone, shas, kept_texts = [], [], [], []
            for text, drop in zip(texts, drops, strict=True):
                lines = text.split(b"\n")
                left = lines
                if drop:
                    out = {x["k1"].to_bytes(8, "little", signed=True) + x["k2"].to_bytes(8, "little", signed=True) for x in drop}
                    left = [x for x, d in zip(lines, line_digests(text, min_chars), strict=True) if d not in out]
                kept = text if left is lines else b"\n".join(left)
                total.append(len(lines))
                gone.append(len(lines) - len(left))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            add = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            names = ["__n_lines", "__n_dropped", "__kept_sha256"]
            if keep_text:
                add.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("__kept_text")
            base = [n for n in batch.schema.names if n not in ("__text", "__drops")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in base), *add], names=[*base, *names])

    return run


def repeated_keys(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(doc_id, body, k1, k2): for each document the line keys that an earlier document holds.

    ``docs`` has doc_id, body (a hash of the text) and text.
    """
    sc = docs.sparkSession.sparkContext
    parts = docs.select("text").mapInArrow(bitmap_builder(_filter_keys(min_chars), bits), SCHEMA)
    shared = sc.broadcast(collect_bitmap(parts, bits, "twice").tobytes())
    found = materialize(docs.select("doc_id", "body", "text").mapInArrow(_suspects(shared, min_chars), "k1 long, k2 long, doc_id long, body long"), "suspect-lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    first = found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("k1", "k2", "first")
    first = materialize(first, "first-lines")  # as a table of its own the join below has two exchanges, and Spark can split a hot line
    return found.join(first, ["k1", "k2"]).where(place != F.col("first")).select("doc_id", "body", "k1", "k2")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits: int = BITS, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, n_lines, n_dropped, kept_sha256[, kept_text]) for every input row.

    A null or empty text has one empty line.  Documents are told apart by id: rows
    with one id are one document, so none of them loses a line to another, and rows
    with a null id are together one document that comes last.  Every input row gives
    one output row.  An empty table gives an empty result.  Columns in ``carry`` pass
    through unchanged; others are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    gone = repeated_keys(src.select("doc_id", "body", "text"), min_chars, bits)
    gone = gone.groupBy("doc_id", "body").agg(F.collect_set(F.struct("k1", "k2")).alias("__drops")).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), "__drops")
    whole = src.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body")), "left")
    whole = whole.select("doc_id", *(f"__c_{c}" for c in carry), F.col("text").alias("__text"), "__drops")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[: 1 + len(carry)])
    out = whole.mapInArrow(_rewrite(min_chars, keep_text), f"{kinds}, __n_lines long, __n_dropped long, __kept_sha256 string" + ", __kept_text string" * keep_text)
    names = {"n_lines": "__n_lines", "n_dropped": "__n_dropped", "kept_sha256": "__kept_sha256"} | ({"kept_text": "__kept_text"} if keep_text else {})
    return out.select("doc_id", *(F.col(f"__c_{c}").alias(c) for c in carry), *(F.col(v).alias(k) for k, v in names.items()))
