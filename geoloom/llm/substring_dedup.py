"""Removal of repeated word windows through a compacted de Bruijn graph.

A window is ``window`` = 35 consecutive words.  Two equal windows choose the same
minimiser, the leftmost of their ``k``-mers of least hash, at the same place.  The k-mers
so chosen are the edges kept of the token de Bruijn graph (about one word in thirteen);
consecutive windows of a document with one minimiser are one *path*: the words from the
first window's start to the last one's end.  A path has an edge hash and a hash of all its
words, both made of its words' 64-bit hashes.

1. A scan emits (edge, path) for every text; a grouped count, combined on the map side,
   keeps edges that occur at least twice.  An edge with a single path is nonbranching and
   all its windows repeat at once; an edge with several is a branching node.
2. Repeated edges go into a Bloom filter of fixed size.  A second scan emits the paths
   that it lets through, with their source coordinates and, for their windows, hashes.
3. Joins drop what the filter let through in error.  At branching nodes every distinct
   path is cut into its windows, and windows are counted over all paths with their copies.
   The result is a bitmap of repeated windows for each distinct path.
4. The paths' coordinates receive those bitmaps by a join, go to their documents, and an
   Arrow pass removes the covered words.

Hot paths are only counted and joined, never gathered, and the joins have an exchange on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.bloom import SCHEMA, bitmap_builder, collect_bitmap, contains
from geoloom.llm.staging import materialize
from geoloom.llm.textkit import as_bytes, chunks, run_hash, run_sums, word_bounds, word_hashes

KMER = 10
BITS = 1 << 26


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the index of its leftmost minimum, by doubling."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        right = best[step:] < best[:n]
        best, at = np.where(right, best[step:], best[:n]), np.where(right, at[step:], at[:n])
        have += step
    return at


def paths(texts: list[bytes], window: int, k: int):
    """The paths of a batch: (text row, first window, windows, edge hash, path hash, run sums, word offsets)."""
    buf, starts, ends, counts = word_bounds(texts)
    hashes = word_hashes(buf, starts, ends)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    sums = run_sums(hashes)
    if len(hashes) < window:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), sums, offsets
    at = np.arange(len(hashes) - k + 1)
    kmers = run_hash(sums, at, at + k)
    chosen = _leftmost_min(kmers, window - k + 1)
    row = np.repeat(np.arange(len(texts)), counts)[: len(chosen)]
    inside = np.arange(len(chosen)) + window <= offsets[row + 1]
    first = np.flatnonzero(inside)
    row, chosen = row[first], chosen[first]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(first)))
    lo = first[begin]
    return row[begin], lo, size, kmers[chosen[begin]], run_hash(sums, lo, lo + size - 1 + window), sums, offsets


def _edges(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts):
                _, _, _, edge, path, _, _ = paths(texts[a:b], window, k)
                yield pa.RecordBatch.from_arrays([pa.array(edge.view(np.int64)), pa.array(path.view(np.int64))], names=["edge", "path"])

    return run


def _occurrences(shared, window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in chunks(texts):
                row, lo, size, edge, path, sums, offsets = paths(texts[a:b], window, k)
                hit = contains(bitmap, edge)
                row, lo, size, edge, path = row[hit], lo[hit], size[hit], edge[hit], path[hit]
                if not len(row):
                    continue
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(lo, size)
                windows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(run_hash(sums, at, at + window).view(np.int64)))
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((lo - offsets[row]).astype(np.int64)), pa.array(edge.view(np.int64)), pa.array(path.view(np.int64)), windows],
                    names=["doc_id", "body", "start", "edge", "path", "windows"],
                )

    return run


def _edge_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window whose bit is set; ``spans`` has a start and a bitmap each."""
    step = np.zeros(n + 1, dtype=np.int64)
    for x in spans or ():
        bits, i = x["bits"], x["start"]
        while bits:
            if bits & 1:
                step[i] += 1
                step[min(n, i + window)] -= 1
            bits >>= 1
            i += 1
    return np.cumsum(step[:n]) > 0


def _rewrite(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, shas, kept_texts = [], [], [], []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                kept = words
                if spans:
                    out = covered(len(words), spans, window)
                    kept = [w for w, drop in zip(words, out.tolist(), strict=True) if not drop]
                line = b" ".join(kept)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                shas.append(hashlib.sha256(line).hexdigest())
                kept_texts.append(line)
            add = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                add.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([batch.column(0), *add], names=names)

    return run


def repeated_paths(docs: DataFrame, window: int, k: int, bits: int) -> DataFrame:
    """(doc_id, body, start, bits): bit j is set if the window at word start + j repeats.  ``docs`` has doc_id, body, text."""
    sc = docs.sparkSession.sparkContext
    edges = docs.select("text").mapInArrow(_edges(window, k), "edge long, path long")
    tally = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"), F.max("path").alias("other"))
    again = materialize(tally.where("n > 1").select("edge", (F.col("one") != F.col("other")).alias("branching")), "repeated-edges")
    parts = again.select("edge").mapInArrow(bitmap_builder(_edge_keys, bits), SCHEMA)
    shared = sc.broadcast(collect_bitmap(parts, bits, "once").tobytes())
    found = docs.select("doc_id", "body", "text").mapInArrow(_occurrences(shared, window, k), "doc_id long, body long, start long, edge long, path long, windows array<long>")
    found = materialize(found, "paths")

    distinct = found.groupBy("edge", "path").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"))
    distinct = materialize(distinct.join(again, "edge"), "distinct-paths")
    every = F.expr("(1L << size(windows)) - 1")
    simple = distinct.where("n > 1").select("edge", "path", every.alias("bits"))
    cut = distinct.where("branching").select("edge", "path", "n", F.posexplode("windows").alias("j", "word_run"))
    twice = cut.groupBy("edge", "word_run").agg(F.sum("n").alias("copies")).where("copies > 1").select("edge", "word_run")
    twice = materialize(twice, "repeated-windows")  # as a table of its own the join below has two exchanges, and Spark can split a hot window
    once = cut.where("n = 1").join(twice, ["edge", "word_run"]).groupBy("edge", "path").agg(F.expr("bit_or(1L << j)").alias("bits"))
    verdict = simple.unionByName(once)
    return found.select("doc_id", "body", "start", "edge", "path").join(verdict, ["edge", "path"]).select("doc_id", "body", "start", "bits")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = KMER, bits: int = BITS, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every input row.

    A word is removed if a window that covers it has a word sequence that also starts
    anywhere else, in the same document too; windows are judged on the input.  Null, empty
    and white texts have no words.  Rows with one id and one text get one and the same
    result (their windows repeat each other's).  An empty table gives an empty result;
    other columns are ignored.
    """
    if not 0 < window - k < 62:
        raise ValueError("a path's windows must fit a 64-bit bitmap, and k must be below the window")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    spans = repeated_paths(src, window, k, bits)
    spans = spans.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "bits")).alias("spans")).select(F.col("doc_id").alias("sid"), F.col("body").alias("sbody"), "spans")
    whole = src.join(spans, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("body") == F.col("sbody")), "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_rewrite(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
