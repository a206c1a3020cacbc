"""Exact duplicate removal with a heavy-hitter split.

Texts are equal when identical after deleting every ``[\\x20\\x09-\\x0D]``.  Only
digests, lengths and ids are shuffled, never texts.

1. One scan writes (doc_id, length, SHA-256 of the normalised text) to a staged table.
2. Misra-Gries counters run over each partition and are merged.  Every digest with
   more than ``rows / (k + 1)`` rows is sure to be among the at most ``k`` survivors.
3. The survivors' winners are verified by an exact count with map-side combining.
   At most ``k`` rows, they are broadcast, and their rows are labelled without a shuffle.
4. The remaining digests, each with at most ``rows / (k + 1)`` rows, go through an ordinary
   window shuffle.  ``k`` follows the number of shuffle partitions, so no task holds a hot group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.staging import materialize, shuffle_partitions

WHITE = " \t\n\x0b\x0c\r"


def normalised(text="text"):
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def misra_gries(counts: Counter, k: int) -> Counter:
    """Reduce summed counters to at most ``k``: subtract the (k+1)-th largest count and drop what is not positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: n - cut for d, n in counts.items() if n > cut})


def _counters(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                kept[pair["values"]] += pair["counts"]
            if len(kept) > 8 * k:
                kept = misra_gries(kept, k)
        kept = misra_gries(kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept.keys()), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["digest", "n"])

    return run


def frequent(digests: DataFrame, k: int) -> list[bytes]:
    """At most ``k`` digests, among them every one with more than rows/(k+1) rows.

    Partitions send at most ``k`` counters each; the sums are merged on executors
    and only the ``k + 1`` largest reach the driver.
    """
    parts = digests.select("digest").mapInArrow(_counters(k), "digest binary, n long")
    top = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k + 1).collect()
    cut = top[k]["n"] if len(top) > k else 0
    return [bytes(r["digest"]) for r in top if r["n"] > max(cut, 1)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays,
    then the smallest id; null ids come last, and rows that tie in everything are
    told apart by an arbitrary row number, so exactly one row of a group is kept.
    Null and empty texts are equal.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    k = k or max(256, 2 * shuffle_partitions(spark))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.char_length(text_col), F.lit(0)).alias("len"),
            F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-digests",
    )
    order = F.struct((-F.col("len")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    hot = spark.createDataFrame([(d,) for d in frequent(rows, k)], "digest binary")
    winners = rows.join(F.broadcast(hot), "digest").groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = spark.createDataFrame(winners.collect(), winners.schema)  # at most k rows

    heavy = rows.join(F.broadcast(winners), "digest")
    w = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(hot), "digest", "left_anti").withColumns({"best": F.min(order).over(w), "group_size": F.count(F.lit(1)).over(w)})
    labelled = heavy.select("doc_id", "row", "digest", "best", "group_size").unionByName(rest.select("doc_id", "row", "digest", "best", "group_size"))
    return labelled.select(
        "doc_id",
        F.col("best.c").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("best.d") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
