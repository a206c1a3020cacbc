"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of 1 to 3 characters, letters lower-cased and
every run of other characters one word boundary.  A document gets the language whose
profile has the smallest out-of-place distance: the sum over the document's ranked
n-grams of the difference between their ranks, ``top`` for one the profile lacks.

Profiles are learnt from at most ``per_language`` labelled documents of each
language, chosen by a hash; every whole text is classified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.staging import bounded_sample, share, shared

UNKNOWN = "und"
_BLOCK = 1 << 21
_KEPT: dict = {}


def _letters() -> np.ndarray:
    """By code point: the code point if it is a letter, else 0."""
    if "letters" not in _KEPT:
        t = np.zeros(0x110000, dtype=np.int64)
        t[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        _KEPT["letters"] = t * np.arange(0x110000)
    return _KEPT["letters"]


def _codes(stream: np.ndarray, known: int) -> np.ndarray:
    """The n-grams that end past the first ``known`` letters of a stream, as integers of 21 bits a character; 0x20 is a word boundary, 0 fills up."""
    mark = np.where(stream == 0, 0x20, stream)
    one = stream[known:]
    two = mark[:-1] | mark[1:] << 21
    three = two[:-1] | mark[2:] << 42
    return np.concatenate([one[one != 0], two[max(0, known - 1) :], three[max(0, known - 2) :][stream[1:-1][max(0, known - 2) :] != 0]])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text and their counts.

    A long text is read block by block; the last two letters of a block go before the next one, so where blocks end makes no difference.
    """
    low = text.lower()
    codes, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    before = np.zeros(1, dtype=np.int64)  # a text begins with a word boundary
    for a in range(0, len(low), _BLOCK):
        points = np.frombuffer(low[a : a + _BLOCK].encode("utf-32-le", "replace"), dtype="<u4")
        c = np.concatenate([before, _letters()[points], np.zeros(int(a + _BLOCK >= len(low)), dtype=np.int64)])
        fresh = np.ones(len(c), dtype=bool)
        fresh[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[fresh]
        if len(c) > 1:
            more, n = np.unique(_codes(c, len(before)), return_counts=True)
            if len(codes):
                codes, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)
            else:
                codes, counts = more, n
        before = c[-2:]
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, ties by code."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


class Profiles:
    """Ranks of n-grams by language, in one table over all their n-grams."""

    def __init__(self, profiles: dict[str, list[int]], top: int) -> None:
        self.names, self.top = sorted(profiles), top
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.ranks = np.full((len(self.codes), len(self.names)), -1, dtype=np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def classify(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties by name, and 1 less its distance over the largest possible one."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        mine = ranked(*ngram_counts(text), self.top)
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        theirs = np.where((self.codes[at] == mine)[:, None], self.ranks[at], -1)
        apart = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (self.top * len(mine)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, codes, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c, n = ngram_counts(text or "")
            langs.append(lang)
            codes.append(c)
            counts.append(n)
        if langs:
            rows = np.repeat(np.arange(len(langs)), [len(c) for c in codes])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(rows)), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "code", "n"])


def learn(labelled: DataFrame, per_language: int = 1500, top: int = 300) -> Profiles:
    """Profiles from at most ``per_language`` rows (doc_id, lang, text) a language; null languages teach nothing."""
    known = labelled.where("lang IS NOT NULL").select("doc_id", "lang", "text")
    chosen = bounded_sample(known, "lang", per_language)
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():  # at most `top` rows a language
        profiles.setdefault(r["lang"], []).append(r["code"])
    return Profiles(profiles, top)


def _classify(model, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = shared(model)
        for batch in batches:
            found = [profiles.classify(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*rest, "__lang_pred", "__score"])

    return run


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carry, lang_pred, score) for every input row; only the text is looked at.

    ``und`` with score 0 for a null text or one without letters (Unicode categories L*),
    or where no language was learnt.  Columns in ``carry`` pass through; others are ignored.
    """
    model = share(docs.sparkSession, profiles)
    where = {c: "__text" if c == text_col else f"__c_{c}" for c in carry}
    src = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(x) for c, x in where.items() if x != "__text"))
    kept = src.schema.fields if text_col in carry else src.schema.fields[1:]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    out = src.mapInArrow(_classify(model, [f.name for f in kept]), f"{kinds}__lang_pred string, __score double")
    return out.select(*(F.col(x).alias(c) for c, x in where.items()), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, per_language: int = 1500, top: int = 300, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carry, held_out, lang_pred, score): learnt from the rows of ``docs`` that are not held out, applied to all."""
    profiles = learn(docs.where(~held_out()).select("doc_id", "lang", "text"), per_language, top)
    out = identify(docs.select(*dict.fromkeys(("text", *carry)), held_out().alias("__held_out")), profiles, "text", (*carry, "__held_out"))
    return out.select(*carry, F.col("__held_out").alias("held_out"), "lang_pred", "score")
