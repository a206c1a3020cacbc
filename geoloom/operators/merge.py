"""Union, deduplication and ranking of candidates from several shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_of(column: Column, default: int = 10, most: int = 40) -> Column:
    """A requested number of results held between 1 and ``most``."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(column, F.lit(default))))


def first_of(df: DataFrame, keys: list[str], order: list[Column], name: str | None = None) -> DataFrame:
    """The first row of each key in a total order."""
    rn = name or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) == 1)
    return out if name else out.drop(rn)


def top_of(df: DataFrame, keys: list[str], order: list[Column], limit: Column | int, name: str = "rank") -> DataFrame:
    """The first rows of each key in a total order, with their rank from 1 as a long."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn(name, rank).where(F.col(name) <= limit)


def merge_results(df: DataFrame, by: str = "best", limit: Column | int = 10, query: str = "query_id") -> DataFrame:
    """Candidates of all shards as one ranked list for each query.

    Of rows with one gers_id ``best`` keeps the most important and ``head_first`` the one from the
    HEAD shard (source_rank 0), else from the shard loaded first.  Ties go by source_rank, then gers_id.
    """
    strong = [F.desc("importance"), F.asc("source_rank")]
    order = {"best": strong, "head_first": [F.asc("source_rank"), F.desc("importance")]}[by]
    one = first_of(df, [query, "gers_id"], order)
    return top_of(one, [query], [*strong, F.asc("gers_id")], limit)
