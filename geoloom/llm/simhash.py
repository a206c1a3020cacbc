"""SimHash near duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits.  The perfect
binary Golay code gives each segment its nearest codeword, at distance 3 or less,
and the codewords within distance 4: one, or six where the nearest is at distance 3.
If two segments differ in at most one bit, each one's nearest codeword is among the
codewords within 4 of the other.

At most three differing bits over three segments leave two segments with at most one
each.  So for each pair of segments (i, j) a fingerprint x takes the keys
``{nearest_i(x)} x near_j(x)`` on the left and ``near_i(x) x {nearest_j(x)}`` on the
right: ``(nearest_i(x), nearest_j(y))`` then is a left key of x and a right key of y.
Both sides have about 5 keys a segment pair.  The join verifies the true distance, so
the links are exactly those with at most ``most`` = 3 differing bits.

Only distinct fingerprints are joined; equal ones have collapsed before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.components import connected_components
from geoloom.llm.staging import materialize
from geoloom.llm.textkit import as_bytes

SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_KEPT: dict = {}


def fingerprint(text: bytes, seed: int = 42, width: int = 3) -> int:
    """Majority bits over the XXH64 of the 3-word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), 0
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
        n, votes = _vote(hashes, n, votes)
    for a in range(0, len(words) - width + 1, 1 << 15):
        part = words[a : a + (1 << 15) + width - 1]
        line = b" ".join(part)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[: len(part) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        n, votes = _vote([digest(line[s:e], seed) for s, e in spans], n, votes)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _vote(hashes: list[int], n: int, votes: np.ndarray) -> tuple[int, np.ndarray]:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return n + len(hashes), votes + bits.sum(axis=0, dtype=np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(t) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row, the fingerprint's 64 bits as a signed long."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_fingerprints, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less, and the five of weight 4 (-1 where there is none)."""
    if "golay" not in _KEPT:
        near, far = np.full(2048, -1, dtype=np.int64), np.full((2048, 5), -1, dtype=np.int64)
        for weight in range(5):
            errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)
            fill = np.zeros(2048, dtype=np.int64)
            for e, s in zip(errors.tolist(), _syndromes(errors).tolist(), strict=True):
                if weight < 4:
                    near[s] = e
                else:
                    far[s, fill[s]] = e
                    fill[s] += 1
        _KEPT["golay"] = near, far
    return _KEPT["golay"]


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the index of the nearest codeword, and a row of the six within distance 4 (-1 where fewer)."""
    near, far = golay_tables()
    s = _syndromes(segment)
    first = (segment ^ near[s]) >> 11
    others = np.where(far[s] >= 0, (segment[:, None] ^ far[s]) >> 11, -1)
    return first, np.concatenate([first[:, None], others], axis=1)


def _keys(side: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [codewords(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
            keys, rows = [], []
            for pair, (i, j) in enumerate(combinations(range(3), 2)):
                one, six = (parts[i][0], parts[j][1]) if side == "left" else (parts[j][0], parts[i][1])
                key = (one[:, None] << 12 | six) if side == "left" else (six << 12 | one[:, None])
                r, c = np.nonzero(six >= 0)
                keys.append((pair << 24 | key)[r, c])
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp.view(np.int64)[np.concatenate(rows)])], names=["key", "fp"])

    return run


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``fp`` that differ in 1 to ``most`` <= 3 bits."""
    if not 0 < most <= 3:
        raise ValueError("the segment argument holds for at most three differing bits")
    left = distinct.select("fp").mapInArrow(_keys("left"), "key long, fp long").withColumnRenamed("fp", "a")
    right = distinct.select("fp").mapInArrow(_keys("right"), "key long, fp long").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def groups(fps: DataFrame, most: int = 3) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fps``; linked fingerprints share the smallest as their root."""
    distinct = materialize(fps.select("fp").distinct(), "distinct-fingerprints")
    roots = connected_components(links(distinct, most))
    return materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "fingerprint-groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every input row.

    Rows whose fingerprints differ in at most ``most`` bits are linked, equal
    fingerprints included; component_id is the smallest non-null id reachable (null
    if the component has only null ids).  Null, empty and white texts have
    fingerprint zero and link like any other.  Repeated rows keep their rows.  An
    empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    member = groups(fps, most)
    lows = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    lowest = materialize(member.join(lows, "fp").groupBy("root").agg(F.min("low").alias("component_id")), "lowest")  # a table, so that Spark can split a large component below
    byfp = member.join(lowest, "root").select("fp", "component_id")
    return fps.join(byfp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """The input rows, all columns, without near duplicates: of each component the row with the smallest id stays.

    Null ids come last, and rows that tie are told apart by an arbitrary row number, so
    exactly one row of a component stays.
    """
    names = docs.columns
    src = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__c_{c}") for c in names if c != text_col), F.monotonically_increasing_id().alias("__row"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    staged = materialize(src.mapInArrow(_with_fingerprint, f"{kinds}, fp long"), "fingerprinted")
    place = F.struct(F.col(f"__c_{id_col}").isNull().alias("none"), F.col(f"__c_{id_col}").alias("id"), F.col("__row").alias("row"))
    best = staged.groupBy("fp").agg(F.min(place).alias("best"))
    stays = groups(staged, most).join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    kept = staged.join(stays, "__row", "left_semi")
    return kept.select(*(F.col("__text" if c == text_col else f"__c_{c}").alias(c) for c in names))


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(t) for t in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=[*batch.schema.names, "fp"])
