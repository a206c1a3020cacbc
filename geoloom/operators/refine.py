"""Checking reverse results against polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refine(results: DataFrame, geometries: DataFrame, contains: Column, failed: Column, verify_limit: int = 10) -> DataFrame:
    """Results (point_id, gers_id, rank, confidence, ...) checked against ``geometries`` (gers_id, ...).

    The first ``verify_limit`` of a point are checked: contained ones get confidence ``exact``; those whose
    geometry could not be read (``failed``) stay as they are; the rest, without a geometry or
    outside of it, go.  Results after the limit stay as they are.
    """
    known = geometries.withColumn("__known", F.lit(True))
    joined = results.join(known, "gers_id", "left")
    checked = F.col("rank") <= verify_limit
    here = F.coalesce(F.col("__known"), F.lit(False))
    broken = here & F.coalesce(failed, F.lit(False))
    inside = here & ~broken & F.coalesce(contains, F.lit(False))
    kept = joined.where(~checked | broken | inside)
    return kept.withColumn("confidence", F.when(checked & inside, "exact").otherwise(F.col("confidence"))).select(*results.columns)


def reverse_and_refine(divisions: DataFrame, places: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """(point_id, divisions, places, addresses): the three lists of each point in rank order; a branch that is not asked for is null."""
    out = None
    for name, df in (("divisions", divisions), ("places", places), ("addresses", addresses)):
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("array<string>"))
            continue
        rows = F.struct("rank", *(c for c in df.columns if c not in ("point_id", "rank")))
        lists = df.groupBy("point_id").agg(F.array_sort(F.collect_list(rows)).alias(name))
        out = lists if out is None else out.join(lists, "point_id", "full")
    return out
