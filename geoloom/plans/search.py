"""Forward search end to end, for a table of queries.

Order: each shard's best candidates by raw BM25, at least 100 and ten times the limit; population
boost and importance; one row for each place over HEAD and the location's shards; the bonus
for an exact name; the location bias; the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import clamp
from geoloom.functions.score import bias_boost, bias_kind, boosted_score, exact_bonus, importance
from geoloom.operators.bm25 import TextIndex, match, match_few
from geoloom.operators.merge import first_of, limit_of, top_of
from geoloom.operators.shards import HEAD, select_shards


def with_defaults(queries: DataFrame) -> DataFrame:
    """Queries with every column: query_id, text, limit (1 to 40, default 10), autocomplete (default true), bias_country, bias_lat, bias_lon."""
    missing = {"limit": "int", "autocomplete": "boolean", "bias_country": "string", "bias_lat": "double", "bias_lon": "double"}
    for name, kind in missing.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    kind = bias_kind(F.col("bias_country"), F.col("bias_lat"), F.col("bias_lon"))
    return queries.withColumns({"limit": limit_of(F.col("limit")).cast("long"), "autocomplete": F.coalesce("autocomplete", F.lit(True)), "bias": kind})


def fetch_limit(limit: Column) -> Column:
    """How many candidates of a shard go on to the boosts."""
    return F.greatest(10 * limit, F.lit(100))


def scored_candidates(queries: DataFrame, index: TextIndex, places: DataFrame, shards: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Candidates with importance: each query's best of each shard, or of the shards (query_id, shard_id, source_rank) given for it.

    ``few`` is for a bounded number of queries over all shards, none of which asks for autocompletion: they are broadcast.
    """
    hits = (match_few(queries, index) if few else match(queries, index, shards=shards)).withColumnRenamed("doc_id", "gers_id")
    if shards is None:
        hits = hits.withColumn("source_rank", F.lit(0).cast("long"))
    else:
        hits = hits.join(shards.select("query_id", "shard_id", "source_rank"), ["query_id", "shard_id"])
    asked = queries.select("query_id", F.col("text").alias("query"), "limit", "bias", "bias_country", "bias_lat", "bias_lon")
    asked = F.broadcast(asked) if few else asked
    best = top_of(hits.join(asked, "query_id"), ["query_id", "shard_id"], [F.round("bm25", 9), F.asc("gers_id")], fetch_limit(F.col("limit")), "nth")
    found = best.join(places, ["shard_id", "gers_id"])
    return found.withColumn("importance", importance(boosted_score(F.col("bm25"), F.col("population"))))


def ranked(cands: DataFrame) -> DataFrame:
    """Deduplication, bonus, bias and limit; ties run through the earlier scores down to the candidate's place, as stable sorts do."""
    near = lambda c: F.desc(F.round(c, 9))
    one = first_of(cands, ["query_id", "gers_id"], [near("importance"), F.asc("source_rank"), F.asc("nth")])
    boost = bias_boost(F.col("bias"), F.col("bias_country"), F.col("bias_lat"), F.col("bias_lon"), F.col("country"), F.col("lat"), F.col("lon"))
    final = one.withColumnRenamed("importance", "base").withColumn("bonus", exact_bonus(F.col("base"), F.col("name"), F.col("query")))
    final = final.withColumn("importance", F.when(F.col("bias") == "none", F.col("bonus")).otherwise(clamp(F.col("bonus") + boost)))
    order = [near("importance"), near("bonus"), near("base"), F.asc("source_rank"), F.asc("nth"), F.asc("gers_id")]
    return top_of(final, ["query_id"], order, F.col("limit"))


def search(queries: DataFrame, index: TextIndex, places: DataFrame, few: bool = False) -> DataFrame:
    """Ranked results of every query over all shards of the index; ``few`` as in :func:`scored_candidates`."""
    return ranked(scored_candidates(with_defaults(queries), index, places, few=few))


def query_shards(queries: DataFrame, places: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, shard_id, source_rank): HEAD first, then up to four shards of the query's location."""
    if catalog.where(F.col("shard_id") == HEAD).isEmpty():
        raise ValueError("the catalog has no HEAD shard")
    spots = queries.select(F.col("query_id").alias("point_id"), F.col("bias_country").alias("country"), F.col("bias_lat").alias("p_lat"), F.col("bias_lon").alias("p_lon"))
    local = select_shards(spots, places.where(F.col("shard_id") != HEAD), catalog).select(F.col("point_id").alias("query_id"), "shard_id", F.col("rank").alias("source_rank"))
    return queries.select("query_id", F.lit(HEAD).alias("shard_id"), F.lit(0).cast("long").alias("source_rank")).unionByName(local)


def search_sharded(queries: DataFrame, catalog: DataFrame, index: TextIndex, places: DataFrame) -> DataFrame:
    """Ranked results over HEAD and the shards chosen by each query's location.

    Only the postings of those shards are read.  Without HEAD there is no answer (an error); another shard that the catalog
    names but the index lacks is passed over, and :func:`missing_shards` tells which.
    """
    queries = with_defaults(queries)
    return ranked(scored_candidates(queries, index, places, query_shards(queries, places, catalog)))


def missing_shards(queries: DataFrame, catalog: DataFrame, index: TextIndex, places: DataFrame) -> DataFrame:
    """(query_id, shard_id) of the chosen shards that the index does not hold."""
    return query_shards(with_defaults(queries), places, catalog).join(index.shards, "shard_id", "left_anti").select("query_id", "shard_id")


def debug_shards(queries: DataFrame, places: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, debug): the location and the loaded shards with their sizes, in load order."""
    queries = with_defaults(queries)
    loaded = query_shards(queries, places, catalog).join(catalog.select("shard_id", "record_count", "size_bytes"), "shard_id")
    lists = loaded.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_rank", "shard_id", "record_count", "size_bytes"))).alias("shards"))
    return lists.join(queries, "query_id").select("query_id", F.struct("bias_country", "bias_lat", "bias_lon", "shards").alias("debug"))


def first_hits(queries: DataFrame, index: TextIndex, places: DataFrame, few: bool = False) -> DataFrame:
    """The best result of every query text; queries that find nothing are absent; ``few`` as in :func:`scored_candidates`."""
    return search(queries.withColumn("limit", F.lit(1)), index, places, few)
