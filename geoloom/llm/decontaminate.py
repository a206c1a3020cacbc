"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of Unicode letters and digits in lower case, and single letters in scripts without spaces.  Test items are taken in blocks of bounded
size; a block is broadcast and every training text is matched against it, so neither
table is shuffled and a passage that many documents share is no hot key.  Two scans for each block:

1. The document frequency, over the whole corpus, of the block's n-grams.  An n-gram is a *rare
   seed* of an item unless it is far more frequent than the item's n-grams usually are;
   that is relative to the item, so an item with very many copies keeps its seeds.
   Items of fewer than ``LONG_ITEM`` words have seeds of two words, longer ones of ``n``.
2. Texts that hold a seed of an item are aligned to it around the seed's diagonal.  The
   score is the local alignment's over that of a perfect copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.staging import share, shared
from geoloom.llm.textkit import as_bytes, chunks, letter_bounds, run_hash, run_sums, word_hashes
from geoloom.llm.toxicity import lowered

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_NGRAMS = 1 << 20
#: An item of fewer words has seeds of two: edits can leave no four words of it in a row though it still scores one half.
LONG_ITEM, SHORT_SEED = 27, 2
#: What the registered queries take for ``min_words``: half of the words of a shorter item stand in many clean texts.
EVIDENCE_WORDS = 8


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two word sequences, and the position in ``words`` past its end."""
    steps = np.arange(len(words) + 1) * -GAP
    row, best, end = np.zeros(len(words) + 1, dtype=np.int64), 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """(score from 0 to 1, start, end): the best local alignment of the item in ``words``."""
    best, end = smith_waterman(item, words)
    _, back = smith_waterman(item[::-1], words[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


class Items:
    """A block of test items: their words, and their n-grams with the places where each occurs."""

    def __init__(self, rows: list[tuple[int | None, str | None]], n: int, min_words: int = 1) -> None:
        texts = [lowered((t or "").encode("utf-8", "replace")) for _, t in rows]
        buf, starts, ends, counts = letter_bounds(texts)
        hashes = word_hashes(buf, starts, ends)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        self.n, self.ids, self.words = n, [], []
        grams, items, places, sizes = [], [], [], []
        for i, (item_id, _) in enumerate(rows):
            w = hashes[offsets[i] : offsets[i + 1]]
            if len(w) < max(1, min_words):
                continue
            size = min(n if len(w) >= LONG_ITEM else SHORT_SEED, n, len(w))
            at = np.arange(len(w) - size + 1)
            grams.append(run_hash(run_sums(w), at, at + size))
            items.append(np.full(len(at), len(self.ids)))
            places.append(at)
            sizes.append(np.full(len(at), size))
            self.ids.append(item_id)
            self.words.append(w)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
        grams, self.item, self.place, sizes = join(grams, np.uint64), join(items, np.int64), join(places, np.int64), join(sizes, np.int64)
        order = np.argsort(grams, kind="stable")
        self.item, self.place, grams = self.item[order], self.place[order], grams[order]
        self._index(grams)
        self.sizes = sorted({int(s) for s in sizes})

    def _index(self, grams: np.ndarray) -> None:
        self.grams, self.first, self.many = np.unique(grams, return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.grams >> np.uint64(48)).astype(np.int64)] = True

    def keep_rare(self, frequency: np.ndarray, floor: int, times: float) -> None:
        """Keep each item's seeds: n-grams found in at most ``floor`` documents or ``times`` the item's median."""
        each = np.repeat(frequency, self.many)
        order = np.lexsort((each, self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        first = np.cumsum(sizes) - sizes
        middle = (each[order[first + (sizes - 1) // 2]] + each[order[first + sizes // 2]]) / 2  # each item has an n-gram at least
        keep = each <= np.maximum(floor, times * middle)[self.item]
        grams = np.repeat(self.grams, self.many)[keep]
        self.item, self.place = self.item[keep], self.place[keep]
        self._index(grams)

    def hits(self, texts: list[bytes]):
        """(starts, ends, hashes, offsets, text row, word, n-gram index) of a batch of lowered texts."""
        buf, starts, ends, counts = letter_bounds(texts)
        hashes = word_hashes(buf, starts, ends)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        sums, row_of = run_sums(hashes), np.repeat(np.arange(len(texts)), counts)
        rows, words, found = [], [], []
        for size in self.sizes:
            if len(hashes) < size or not len(self.grams):
                continue
            at = np.arange(len(hashes) - size + 1)
            grams = run_hash(sums, at, at + size)
            maybe = np.flatnonzero(self.sieve[(grams >> np.uint64(48)).astype(np.int64)] & (at + size <= offsets[row_of[at] + 1]))
            g = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            real = self.grams[g] == grams[maybe]
            rows.append(row_of[maybe[real]])
            words.append(maybe[real])
            found.append(g[real])
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        return starts, ends, hashes, offsets, join(rows), join(words), join(found)


def _frequency(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared(block)
        total = np.zeros(len(items.grams), dtype=np.int64)
        for batch in batches:
            texts = [lowered(t) for t in as_bytes(batch.column(0))]
            for a, b in chunks(texts):
                *_, row, _, gram = items.hits(texts[a:b])
                if len(row):
                    total += np.bincount(np.unique(row * len(items.grams) + gram) % len(items.grams), minlength=len(items.grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["gram", "n"])

    return run


def _regions(item: int, length: int, diagonals: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Windows of the text around the diagonals at which an item's seeds hit, overlapping ones merged."""
    slack = length // 2 + 2
    spans = [(max(0, d - slack), min(limit, d + length + slack)) for d in np.unique(diagonals).tolist()]
    lo, hi = spans[0]
    for a, b in spans[1:]:
        if a > hi:
            yield lo, hi
            lo = a
        hi = max(hi, b)
    yield lo, hi


def _match(block, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared(block)
        for batch in batches:
            texts = [lowered(t) for t in as_bytes(batch.column(1))]
            out: list[tuple] = []
            for a, b in chunks(texts):
                starts, ends, hashes, offsets, row, word, gram = items.hits(texts[a:b])
                if not len(row):
                    continue
                many = items.many[gram]
                each = np.repeat(np.arange(len(row)), many)
                slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + items.first[gram][each]
                item, diagonal = items.item[slot], (word - offsets[row])[each] - items.place[slot]
                owner = row[each]
                order = np.lexsort((diagonal, item, owner))
                owner, item, diagonal = owner[order], item[order], diagonal[order]
                cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(item) != 0)) + 1
                base = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
                for part in np.split(np.arange(len(owner)), cuts):
                    t, i = int(owner[part[0]]), int(item[part[0]])
                    words, target = hashes[offsets[t] : offsets[t + 1]], items.words[i]
                    best = (0.0, 0, 0)
                    for lo, hi in _regions(i, len(target), diagonal[part], len(words)):
                        here = words[lo:hi]
                        if np.isin(target, here).sum() < threshold * len(target):  # it bounds the matches
                            continue
                        score, s, e = align(target, here)
                        best = max(best, (score, lo + s, lo + e), key=lambda x: x[0])
                    if best[0] >= threshold:
                        text = texts[a + t]
                        s, e = int(starts[offsets[t] + best[1]] - base[t]), int(ends[offsets[t] + best[2] - 1] - base[t])
                        begin = len(text[:s].decode("utf-8", "replace"))
                        out.append((a + t, items.ids[i], best[0], begin, begin + len(text[s:e].decode("utf-8", "replace"))))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["row_key", "item_id", "score", "start", "end"],
                )

    return run


def item_blocks(benchmark: DataFrame, n: int, min_words: int = 1, most: int = BLOCK_NGRAMS) -> Iterator[Items]:
    """The benchmark in blocks of about ``most`` n-grams, read one partition at a time."""
    rows, size = [], 0
    for r in benchmark.toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(letter_bounds([(r["text"] or "").encode("utf-8", "replace")])[1])
        if size >= most:
            yield Items(rows, n, min_words)
            rows, size = [], 0
    if rows:
        yield Items(rows, n, min_words)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_col: str = "text", n: int = 4, threshold: float = 0.5, floor: int = 8, times: float = 4.0, min_words: int = 1
) -> DataFrame:
    """(row_key, item_id, score, start, end): every text and test item whose alignment scores at least ``threshold``.

    ``row_key`` is the row's ``key``, a long; ``start`` and ``end`` are code points of the aligned
    passage.  Null, empty and wordless texts and items match nothing, nor do items of fewer than ``min_words``
    words, which are too short to be evidence; an item shorter than ``n``
    words has shorter seeds, one of a word or two is its own.  A pair that shares no seed that was kept
    is not aligned.  Of passages of one text that score alike the first counts.  Whole texts are matched, however long.
    Repeated rows and items each give their rows.  Empty tables give no rows; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text_col).cast("string").alias("text"))
    schema = "row_key long, item_id long, score double, start long, end long"
    out = None
    for items in item_blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), n, min_words):
        if not items.ids:
            continue
        counts = src.select("text").mapInArrow(_frequency(share(spark, items)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(items.grams), dtype=np.int64)
        for r in counts.collect():  # at most the block's n-grams
            frequency[r["gram"]] = r["n"]
        items.keep_rare(frequency, floor, times)
        found = src.mapInArrow(_match(share(spark, items), threshold), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
