"""Every operator applied to derived places: the Spark query and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo, names, params, score, wkb
from geoloom.operators import lookup, refine, shards
from geoloom.operators.bm25 import TextIndex, search_text
from geoloom.operators.merge import merge_results
from geoloom.operators.nearby import nearby
from geoloom.operators.reverse import candidates, hierarchy, most_specific, reverse_sharded
from geoloom.plans import search as forward
from geoloom.plans.oracle import bm25_sql, tokens_sql
from geoloom.plans.views import NOUNS, PLACES_SQL, POINTS_SQL, WORDS, _choice, haversine_sql, places, points
from geoloom.sources import catalog, output
from geoloom.sources.readers import non_empty, parsed_response, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLIT_BYTES = 4000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    """A double rounded to six places, so that engines agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# Literal request tables, the same in both dialects.
SEARCHES = [
    (1, "north bridge", True, None, None, None),
    (2, "NEW ford, asia", False, "C3", None, None),
    (3, "saint mi", True, None, 10.0, 20.0),
    (4, "old river a", True, "C7", -30.0, 40.0),
    (5, "great", False, "C2", 5.0, None),
    (6, "...", True, None, None, None),
    (7, "little gate c1", True, "C1", None, None),
]


def _lit(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"


def _values(name: str, rows: list[tuple], cols: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS v({cols}))"


SEARCHES_SQL = _values("queries", SEARCHES, "query_id, text, autocomplete, bias_country, bias_lat, bias_lon")


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id long, text string, autocomplete boolean, bias_country string, bias_lat double, bias_lon double")


def _renamed(df: DataFrame) -> DataFrame:
    """Places for reverse geocoding, without the columns that would clash with points."""
    return df.drop("key", "half", "search_text", "continent")


# --- reverse geocoding ---

CANDS_SQL = f"""
    WITH {PLACES_SQL}, {POINTS_SQL},
    found AS (
        SELECT point_id, p_lat, p_lon, p.*, row_number() OVER (PARTITION BY point_id ORDER BY area, gers_id) AS nth
        FROM points JOIN places p ON xmin <= p_lon AND xmax >= p_lon AND ymin <= p_lat AND ymax >= p_lat
    ),
    cands AS (SELECT * FROM found WHERE nth <= 50)
"""
PRIORITY_SQL = "list_position(['neighborhood', 'macrohood', 'locality', 'localadmin', 'county', 'region', 'country'], subtype)"
CONFIDENCE_SQL = "CASE WHEN area < 0.01 THEN 'high' WHEN area < 0.1 THEN 'medium' ELSE 'low' END"


@query(f"""{CANDS_SQL}
    SELECT point_id, gers_id, name, subtype, round({haversine_sql('p_lat', 'p_lon', 'lat', 'lon')}, 6) AS distance_km, {CONFIDENCE_SQL} AS confidence
    FROM cands WHERE nth = 1""")
def reverse_most_specific(spark, sf_dir):
    out = most_specific(candidates(points(spark, sf_dir).drop("country"), _renamed(places(spark, sf_dir))))
    return out.select("point_id", "gers_id", "name", "subtype", r6("distance_km"), "confidence")


@query(f"""{CANDS_SQL},
    steps AS (SELECT *, {PRIORITY_SQL} AS lvl, row_number() OVER (PARTITION BY point_id, subtype ORDER BY nth) AS k FROM cands)
    SELECT point_id, CAST(lvl AS BIGINT) AS level, subtype, gers_id, name FROM steps WHERE k = 1""")
def reverse_hierarchy(spark, sf_dir):
    return hierarchy(candidates(points(spark, sf_dir).drop("country"), _renamed(places(spark, sf_dir))))


@query(f"""
    WITH {PLACES_SQL}, {POINTS_SQL},
    sharded AS (
        SELECT *, country AS shard_id FROM places
        UNION ALL SELECT *, 'HEAD' AS shard_id FROM places WHERE subtype IN ('country', 'region', 'county') OR coalesce(population >= 500000, false)
    ),
    found AS (
        SELECT point_id, p_lat, p_lon, s.*, CASE WHEN shard_id = q.country THEN 0 ELSE 1 END AS tier
        FROM points q JOIN sharded s ON xmin <= p_lon AND xmax >= p_lon AND ymin <= p_lat AND ymax >= p_lat
        WHERE shard_id = q.country OR shard_id = 'HEAD'
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY tier, area, gers_id) AS k FROM found)
    SELECT point_id, shard_id, gers_id, {CONFIDENCE_SQL} AS confidence FROM best WHERE k = 1""")
def reverse_fallback_head(spark, sf_dir):
    p = places(spark, sf_dir)
    local = p.withColumn("shard_id", F.col("country"))
    head = p.where(shards.in_head(F.col("subtype"), F.col("population"), shards.HEAD_REVERSE, 500_000)).withColumn("shard_id", F.lit("HEAD"))
    return reverse_sharded(points(spark, sf_dir), _renamed(local.unionByName(head))).select("point_id", "shard_id", "gers_id", "confidence")


# --- full-text search ---

BENCH_SQL = "bench AS (SELECT item_id AS query_id, replace(text, '-', ' ') AS text, false AS autocomplete FROM benchmark)"


@query(f"""
    WITH {BENCH_SQL}, corpus AS (SELECT lang AS shard_id, doc_id, text FROM documents), {bm25_sql('corpus', 'bench', False)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY round(bm25, 9), doc_id) AS rank FROM hits)
    SELECT query_id, shard_id, doc_id, round(bm25, 6) AS bm25, rank FROM ranked WHERE rank <= 10""")
def fts_bm25_topk(spark, sf_dir):
    """The documents that have all words of a benchmark item."""
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.replace("text", F.lit("-"), F.lit(" ")).alias("text"), F.lit(False).alias("autocomplete"))
    index = TextIndex.build(read_table(spark, sf_dir, "documents"), "text", "doc_id", "lang")  # a shard for each language
    return search_text(q, index, 10, prefixes=False).select("query_id", "shard_id", "doc_id", r6("bm25"), "rank")


PREFIXES = [(1, "sm", True), (2, "red w", True), (3, "blue", False), (4, "hot gea", True), (5, "zz", True)]


@query(f"""
    WITH {_values('queries', PREFIXES, 'query_id, text, autocomplete')}, corpus AS (SELECT 'ALL' AS shard_id, p_partkey AS doc_id, p_name AS text FROM part),
    {bm25_sql('corpus', 'queries')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), doc_id) AS rank FROM hits)
    SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM ranked WHERE rank <= 20""")
def fts_prefix_autocomplete(spark, sf_dir):
    index = TextIndex.build(read_table(spark, sf_dir, "part"), "p_name", "p_partkey", None)
    q = spark.createDataFrame(PREFIXES, "query_id long, text string, autocomplete boolean")
    return search_text(q, index, 20).select("query_id", "doc_id", r6("bm25"), "rank")


@query("""
    WITH t AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w FROM part),
    q AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'red', 'widget'), (CAST(2 AS BIGINT), 'widget', 'red'), (CAST(3 AS BIGINT), 'hot', 'gear')) AS v(query_id, a, b))
    SELECT query_id, doc_id FROM t JOIN q ON w[1] = a AND w[2] = b""")
def fts_hyphen_phrase(spark, sf_dir):
    index = TextIndex.build(read_table(spark, sf_dir, "part"), "p_name", "p_partkey", None)
    q = spark.createDataFrame([(1, "red-widget", False), (2, "widget-red", False), (3, "Hot-Gear", True)], "query_id long, text string, autocomplete boolean")
    return search_text(q, index, 1_000_000_000, prefixes=True).select("query_id", "doc_id")


@query()
def fts_porter(spark, sf_dir):
    index = TextIndex.build(read_table(spark, sf_dir, "documents"), "text", "doc_id", None, stem=True)
    q = spark.createDataFrame([(1, "eating", False), (2, "anded", True), (3, "the thing", False)], "query_id long, text string, autocomplete boolean")
    return search_text(q, index, 10).select("query_id", "doc_id", r6("bm25"), "rank")


# --- scoring ---


@query(f"""
    WITH {PLACES_SQL}, b AS (SELECT gers_id, population, -(CAST(key % 97 AS DOUBLE)) / 10 AS bm25 FROM places),
    s AS (SELECT gers_id, CASE WHEN population > 0 THEN bm25 - 2 * ln(population + 1.0) ELSE bm25 - 2.0 END AS boosted FROM b)
    SELECT gers_id, round(boosted, 6) AS boosted, round(greatest(0.0, least(1.0, -boosted / 50)), 6) AS importance FROM s""")
def boosted_importance(spark, sf_dir):
    bm25 = -((F.col("key") % 97).cast("double")) / 10
    out = places(spark, sf_dir).withColumn("boosted", score.boosted_score(bm25, F.col("population")))
    return out.select("gers_id", r6("boosted"), r6(score.importance(F.col("boosted")), "importance"))


BONUS = [(1, "red widget"), (2, "RED, bolt"), (3, "re"), (4, "  ")]


@query(rf"""
    WITH {_values('q', BONUS, 'query_id, text')}, p AS (SELECT p_partkey, p_name, CAST(p_partkey % 100 AS DOUBLE) / 100 AS base FROM part),
    t AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s,]+'), lambda x: x <> '')) AS tok FROM q),
    m AS (SELECT DISTINCT query_id, p_partkey FROM t JOIN p ON starts_with(lower(p_name), tok) AND substr(lower(p_name), length(tok) + 1, 1) IN ('', ',', ' '))
    SELECT q.query_id, p.p_partkey, round(CASE WHEN m.p_partkey IS NULL THEN base ELSE least(1.0, base + 0.1) END, 6) AS importance
    FROM q CROSS JOIN p LEFT JOIN m ON m.query_id = q.query_id AND m.p_partkey = p.p_partkey""")
def exact_match_bonus(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", ((F.col("p_partkey") % 100).cast("double") / 100).alias("base"))
    every = p.withColumn("q", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(t).alias("text")) for i, t in BONUS))))
    return every.select("q.query_id", "p_partkey", r6(score.exact_bonus(F.col("base"), F.col("p_name"), F.col("q.text")), "importance"))


def _bias(kind: str, country: str | None, lat: float | None, lon: float | None):
    near = f"0.2 / (1 + {haversine_sql(str(lat), str(lon), 'lat', 'lon')} / 100)"
    boost = {"country": f"CASE WHEN country = '{country}' THEN 0.35 ELSE 0 END", "coordinates": near, "full": f"(CASE WHEN country = '{country}' THEN 0.25 ELSE 0 END) + {near}"}[kind]
    sql = f"WITH {PLACES_SQL} SELECT gers_id, round(greatest(0.0, least(1.0, CAST(key % 100 AS DOUBLE) / 100 + {boost})), 6) AS importance FROM places"

    def run(spark, sf_dir):
        args = [F.lit(country).cast("string"), F.lit(lat).cast("double"), F.lit(lon).cast("double")]
        boost = score.bias_boost(score.bias_kind(*args), *args, F.col("country"), F.col("lat"), F.col("lon"))
        return places(spark, sf_dir).select("gers_id", r6(geo.clamp((F.col("key") % 100).cast("double") / 100 + boost), "importance"))

    run.__name__ = {"country": "bias_country", "coordinates": "bias_coords", "full": "bias_full"}[kind]
    query(sql)(run)


_bias("country", "C3", None, None)
_bias("coordinates", None, 48.85, 2.35)
_bias("full", "C5", -33.9, 151.2)


# --- merging ---

MERGE_SQL = f"""
    WITH {PLACES_SQL},
    two AS (
        SELECT key % 20 AS query_id, gers_id, CAST(0 AS BIGINT) AS source_rank, CAST((key * 37) % 1000 AS DOUBLE) / 1000 AS importance FROM places WHERE subtype = 'county' OR coalesce(population >= 500000, false)
        UNION ALL
        SELECT key % 20 AS query_id, gers_id, CAST(1 AS BIGINT) AS source_rank, CAST((key * 53) % 1000 AS DOUBLE) / 1000 AS importance FROM places
    )"""


def _two(spark, sf_dir):
    """Results from HEAD and from the country shards, which hold every place."""
    p = places(spark, sf_dir)
    side = lambda rows, rank, by: rows.select((F.col("key") % 20).alias("query_id"), "gers_id", F.lit(rank).cast("long").alias("source_rank"), (((F.col("key") * by) % 1000).cast("double") / 1000).alias("importance"))
    return side(p.where(shards.in_head(F.col("subtype"), F.col("population"), shards.HEAD_FORWARD, 500_000)), 0, 37).unionByName(side(p, 1, 53))


def _merge_sql(order: str) -> str:
    return f"""{MERGE_SQL},
    one AS (SELECT *, row_number() OVER (PARTITION BY query_id, gers_id ORDER BY {order}) AS k FROM two),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, source_rank, gers_id) AS rank FROM one WHERE k = 1)
    SELECT query_id, gers_id, source_rank, importance, rank FROM ranked WHERE rank <= 10"""


@query(_merge_sql("importance DESC, source_rank"))
def merge_keep_best(spark, sf_dir):
    return merge_results(_two(spark, sf_dir), "best", 10).select("query_id", "gers_id", "source_rank", "importance", "rank")


@query(_merge_sql("source_rank, importance DESC"))
def merge_head_first(spark, sf_dir):
    return merge_results(_two(spark, sf_dir), "head_first", 10).select("query_id", "gers_id", "source_rank", "importance", "rank")


# --- search end to end ---


def _ranked_sql(places_cte: str, loaded: str | None = None) -> str:
    """From hits, queries and places to ranked results, as plans.search does it: for one shard, or for the ``loaded`` shards of each query."""
    source, also = ("0", "") if loaded is None else ("c.source_rank", " AND c.shard_id = p.shard_id")
    of = "" if loaded is None else f" JOIN (SELECT query_id, shard_id, nth AS source_rank FROM {loaded}) USING (query_id, shard_id)"
    cut = "h.*" if loaded is None else "h.*, source_rank"
    one = "scored" if loaded is None else "(SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, gers_id ORDER BY round(base, 9) DESC, source_rank, nth) = 1)"
    return rf"""
    cut AS (SELECT {cut}, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY round(bm25, 9), doc_id) AS nth FROM hits h{of}),
    scored AS (
        SELECT c.query_id, c.nth, {source} AS source_rank, p.*, q.text AS query, q.bias_country, q.bias_lat, q.bias_lon,
               greatest(0.0, least(1.0, -(CASE WHEN p.population > 0 THEN bm25 - 2 * ln(p.population + 1.0) ELSE bm25 - 2.0 END) / 50)) AS base
        FROM cut c JOIN {places_cte} p ON c.doc_id = p.gers_id{also} JOIN queries q ON q.query_id = c.query_id WHERE nth <= 100
    ),
    bonused AS (
        SELECT *, CASE WHEN len(list_filter(list_filter(regexp_split_to_array(lower(query), '[\s,]+'), lambda x: x <> ''),
                   lambda x: starts_with(lower(name), x) AND substr(lower(name), length(x) + 1, 1) IN ('', ',', ' '))) > 0
                   THEN least(1.0, base + 0.1) ELSE base END AS bonus FROM {one}
    ),
    final AS (
        SELECT *, CASE
            WHEN bias_country IS NOT NULL AND bias_lat IS NOT NULL AND bias_lon IS NOT NULL
                THEN least(1.0, bonus + (CASE WHEN country = bias_country THEN 0.25 ELSE 0 END) + 0.2 / (1 + {haversine_sql('bias_lat', 'bias_lon', 'lat', 'lon')} / 100))
            WHEN bias_lat IS NOT NULL AND bias_lon IS NOT NULL THEN least(1.0, bonus + 0.2 / (1 + {haversine_sql('bias_lat', 'bias_lon', 'lat', 'lon')} / 100))
            WHEN bias_country IS NOT NULL AND bias_lat IS NULL AND bias_lon IS NULL THEN least(1.0, bonus + (CASE WHEN country = bias_country THEN 0.35 ELSE 0 END))
            ELSE bonus END AS importance FROM bonused
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(importance, 9) DESC, round(bonus, 9) DESC, round(base, 9) DESC, source_rank, nth, gers_id) AS rank FROM final
    )"""


SEARCH_SQL = f"""
    WITH {PLACES_SQL}, {SEARCHES_SQL}, corpus AS (SELECT 'ALL' AS shard_id, gers_id AS doc_id, search_text AS text FROM places),
    {bm25_sql('corpus', 'queries')}, {_ranked_sql('places')}"""


def _index(p: DataFrame) -> TextIndex:
    return TextIndex.build(p, "search_text", "gers_id", "shard_id")


def _searched(spark, sf_dir) -> DataFrame:
    p = places(spark, sf_dir).withColumn("shard_id", F.lit("ALL"))
    return forward.search(searches(spark), _index(p), p.drop("search_text"))


@query(f"{SEARCH_SQL} SELECT query_id, gers_id, name, round(importance, 6) AS importance, rank FROM ranked WHERE rank <= 10")
def search_end_to_end(spark, sf_dir):
    return _searched(spark, sf_dir).select("query_id", "gers_id", "name", r6("importance"), "rank")


@query(f"""
    WITH {PLACES_SQL}, queries AS (SELECT p_partkey AS query_id, {_choice(WORDS, 'p_partkey % 11')} || ' ' || {_choice(NOUNS, 'p_partkey % 7')} || CASE WHEN p_size > 25 THEN ' c' || CAST(p_size % 25 AS VARCHAR) ELSE '' END AS text, false AS autocomplete,
                                          NULL AS bias_country, CAST(NULL AS DOUBLE) AS bias_lat, CAST(NULL AS DOUBLE) AS bias_lon FROM part),
    corpus AS (SELECT 'ALL' AS shard_id, gers_id AS doc_id, search_text AS text FROM places),
    {bm25_sql('corpus', 'queries', False)}, {_ranked_sql('places')}
    SELECT query_id, gers_id, round(importance, 6) AS importance FROM ranked WHERE rank = 1""")
def batch_first_hit(spark, sf_dir):
    """Every part asks for a place by a name made of its key, and for some of a country by its size.

    There are 11 words, 7 nouns and 25 countries or none, so at most 2002 texts, however many parts: they and their hits are broadcast.
    """
    p = places(spark, sf_dir).withColumn("shard_id", F.lit("ALL"))
    of = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    country = F.when(F.col("p_size") > 25, F.concat(F.lit("c"), (F.col("p_size") % 25).cast("string")))
    text = F.concat_ws(" ", of(WORDS, F.col("p_partkey") % 11), of(NOUNS, F.col("p_partkey") % 7), country)
    q = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))
    distinct = q.select(F.xxhash64("text").alias("query_id"), "text", F.lit(False).alias("autocomplete")).distinct()
    hits = forward.first_hits(distinct, _index(p), p.drop("search_text"), few=True)
    return q.select("query_id", F.xxhash64("text").alias("h")).join(F.broadcast(hits.select(F.col("query_id").alias("h"), "gers_id", r6("importance"))), "h").drop("h")


# --- shards ---

SIZE_SQL = "CAST(strlen(gers_id) + strlen(name) + strlen(search_text) + 8 AS BIGINT)"
SHARDS_SQL = f"""
    WITH {PLACES_SQL}, sized AS (SELECT *, {SIZE_SQL} AS bytes FROM places),
    big AS (SELECT country, CAST(sum(bytes) AS BIGINT) AS size_bytes FROM sized GROUP BY country HAVING sum(bytes) > {SPLIT_BYTES}),
    assigned AS (
        SELECT s.*, CASE WHEN b.country IS NOT NULL THEN coalesce(s.region, s.country || '-XX') ELSE s.country END AS shard_id
        FROM sized s LEFT JOIN big b ON s.country = b.country
        UNION ALL SELECT *, 'HEAD' AS shard_id FROM sized WHERE subtype = 'county' OR coalesce(population >= 500000, false)
    ),
    stats AS (SELECT shard_id, count(*) AS record_count, CAST(sum(bytes) AS BIGINT) AS size_bytes, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM assigned GROUP BY shard_id)"""


def size():
    return shards.row_bytes("gers_id", "name", "search_text")



def _assigned(spark, sf_dir) -> DataFrame:
    head = shards.in_head(F.col("subtype"), F.col("population"), shards.HEAD_FORWARD, 500_000)
    return shards.assign_shards(places(spark, sf_dir), size(), SPLIT_BYTES, head)


@query(f"{SHARDS_SQL} SELECT shard_id, gers_id FROM assigned")
def shard_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("shard_id", "gers_id")


@query(f"{SHARDS_SQL} SELECT shard_id, record_count, size_bytes, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM stats")
def shard_stats(spark, sf_dir):
    return shards.shard_stats(_assigned(spark, sf_dir), size()).select("shard_id", "record_count", "size_bytes", *(r6(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query(f"WITH {PLACES_SQL} SELECT country, coalesce(region, country || '-XX') AS region, count(*) AS n FROM places GROUP BY country, places.region")
def region_counts(spark, sf_dir):
    return shards.region_counts(places(spark, sf_dir))


@query(f"{SHARDS_SQL} SELECT country, size_bytes FROM big")
def oversize_split(spark, sf_dir):
    return shards.oversize(places(spark, sf_dir), size(), SPLIT_BYTES).select("country", F.col("size_bytes").cast("long").alias("size_bytes"))


@query(f"WITH {PLACES_SQL} SELECT gers_id FROM places WHERE population >= 100000 OR subtype IN ('county')")
def head_forward(spark, sf_dir):
    return places(spark, sf_dir).where(shards.in_head(F.col("subtype"), F.col("population"))).select("gers_id")


@query(f"WITH {PLACES_SQL} SELECT gers_id FROM places WHERE subtype IN ('country', 'region', 'county') OR (population IS NOT NULL AND population >= 100000)")
def head_reverse(spark, sf_dir):
    return places(spark, sf_dir).where(shards.in_head(F.col("subtype"), F.col("population"), shards.HEAD_REVERSE)).select("gers_id")


LOCAL_SQL = f"""
    WITH {PLACES_SQL}, {POINTS_SQL},
    tiles AS (SELECT region AS shard_id, min(xmin) AS xmin, min(ymin) AS ymin, min(xmin) + 4.0 AS xmax, min(ymin) + 4.0 AS ymax FROM places WHERE region IS NOT NULL GROUP BY region)"""


def _tiles(spark, sf_dir) -> DataFrame:
    return places(spark, sf_dir).where("region IS NOT NULL").groupBy(F.col("region").alias("shard_id")).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), (F.min("xmin") + 4.0).alias("xmax"), (F.min("ymin") + 4.0).alias("ymax"))


@query(f"""{LOCAL_SQL},
    d AS (SELECT point_id, shard_id, {haversine_sql('p_lat', 'p_lon', 'greatest(ymin, least(ymax, p_lat))', 'greatest(xmin, least(xmax, p_lon))')} AS km FROM points CROSS JOIN tiles),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(km, 9), shard_id) AS rank FROM d WHERE km <= 200)
    SELECT point_id, shard_id, round(km, 6) AS distance_km, rank FROM k WHERE rank <= 4""")
def select_shards_proximity(spark, sf_dir):
    return shards.shards_near(points(spark, sf_dir), _tiles(spark, sf_dir)).select("point_id", "shard_id", r6("distance_km"), "rank")


@query(f"""{SHARDS_SQL}, {POINTS_SQL},
    counts AS (SELECT country, coalesce(region, country || '-XX') AS shard_id, count(*) AS n FROM places WHERE country IN (SELECT country FROM big) GROUP BY ALL),
    k AS (SELECT country, shard_id, row_number() OVER (PARTITION BY country ORDER BY n DESC, shard_id) AS rank FROM counts),
    known AS (SELECT * FROM k WHERE rank <= 4 UNION ALL SELECT shard_id, shard_id, 1 FROM stats WHERE shard_id IN (SELECT country FROM places) )
    SELECT point_id, shard_id, CAST(rank AS BIGINT) AS rank FROM points JOIN known USING (country)""")
def select_shards_country(spark, sf_dir):
    stats = shards.shard_stats(_assigned(spark, sf_dir), size())
    return shards.shards_of_country(points(spark, sf_dir), places(spark, sf_dir), stats)


LOADED_SQL = f"""
    counts AS (SELECT country, coalesce(region, country || '-XX') AS shard_id, count(*) AS n FROM places WHERE country IN (SELECT country FROM big) GROUP BY ALL),
    k AS (SELECT country, shard_id, row_number() OVER (PARTITION BY country ORDER BY n DESC, shard_id) AS rank FROM counts),
    known AS (SELECT * FROM k WHERE rank <= 4 UNION ALL SELECT shard_id, shard_id, 1 FROM stats WHERE shard_id IN (SELECT country FROM places)),
    near AS (
        SELECT query_id, shard_id, row_number() OVER (PARTITION BY query_id ORDER BY round(km, 9), shard_id) AS rank FROM (
            SELECT query_id, shard_id, {haversine_sql('bias_lat', 'bias_lon', 'greatest(ymin, least(ymax, bias_lat))', 'greatest(xmin, least(xmax, bias_lon))')} AS km
            FROM queries CROSS JOIN stats WHERE bias_lat IS NOT NULL AND bias_lon IS NOT NULL AND shard_id <> 'HEAD') WHERE km <= 200
    ),
    loaded AS (
        SELECT query_id, 'HEAD' AS shard_id, 0 AS nth FROM queries
        UNION ALL SELECT query_id, shard_id, rank FROM near WHERE rank <= 4
        UNION ALL SELECT query_id, shard_id, rank FROM queries JOIN known ON bias_country = country WHERE bias_lat IS NULL OR bias_lon IS NULL
    )"""


@query(f"""{SHARDS_SQL}, {SEARCHES_SQL}, {LOADED_SQL}
    SELECT query_id, CAST(nth AS BIGINT) AS source_rank, shard_id, record_count, size_bytes FROM loaded JOIN stats USING (shard_id)""")
def search_debug_shards(spark, sf_dir):
    p = _assigned(spark, sf_dir)
    local = places(spark, sf_dir).withColumn("shard_id", F.lit(""))
    stats = shards.shard_stats(p, size())
    return forward.debug_shards(searches(spark), local, stats).select("query_id", F.explode("debug.shards").alias("s")).select("query_id", "s.*")


@query(f"""
    WITH {PLACES_SQL}, n AS (SELECT country, coalesce(region, country || '-XX') AS region, count(*) AS n FROM places GROUP BY country, places.region)
    SELECT country, region, row_number() OVER (PARTITION BY country ORDER BY n DESC, region) - 1 AS position FROM n""")
def region_sharded_map(spark, sf_dir):
    return shards.region_map(places(spark, sf_dir)).select("country", F.posexplode("regions").alias("position", "region")).select("country", "region", F.col("position").cast("long").alias("position"))


@query(f"""
    WITH {PLACES_SQL}, h AS (SELECT country, gers_id, substr(sha256(gers_id), 1, 4) AS bucket, sha256(concat_ws('|', gers_id, name, coalesce(CAST(population AS VARCHAR), ''))) AS h FROM places),
    buckets AS (SELECT country, bucket, sha256(string_agg(h, '' ORDER BY gers_id)) AS h FROM h GROUP BY country, bucket)
    SELECT country, sha256(string_agg(h, '' ORDER BY bucket)) AS rows_sha256 FROM buckets GROUP BY country""")
def shard_row_hash(spark, sf_dir):
    return shards.row_hash(places(spark, sf_dir), "gers_id", ["gers_id", "name", "population"], "country")


@query(f"""
    WITH {PLACES_SQL}, wide AS (SELECT gers_id, CASE WHEN xmax > 180 THEN xmax - 360 ELSE xmax END AS xmax, CASE WHEN xmin < -180 THEN xmin + 360 ELSE xmin END AS xmin FROM places)
    SELECT gers_id, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax FROM wide WHERE xmin <= xmax
    UNION ALL SELECT gers_id, round(xmin, 6), 180.0 FROM wide WHERE xmin > xmax
    UNION ALL SELECT gers_id, -180.0, round(xmax, 6) FROM wide WHERE xmin > xmax""")
def antimeridian_split(spark, sf_dir):
    x0, x1 = F.col("xmin"), F.col("xmax")
    wide = places(spark, sf_dir).select("gers_id", F.when(x0 < -180, x0 + 360).otherwise(x0).alias("xmin"), F.when(x1 > 180, x1 - 360).otherwise(x1).alias("xmax"))
    return shards.split_antimeridian(wide).select("gers_id", r6("xmin"), r6("xmax"))


# --- names, lookups, addresses ---


def _divisions(spark, sf_dir) -> DataFrame:
    """Nested divisions made of places, with a country and a region division for each code."""
    p = places(spark, sf_dir)
    rule = lambda v, lang, value: F.struct(F.lit(v).alias("variant"), F.lit(lang).cast("string").alias("language"), value.alias("value"))

    def named(df: DataFrame, subtype, name) -> DataFrame:
        rules = F.array(rule("short", None, F.upper(F.substring(name, 1, 2))), rule("alternate", "en-US", F.concat(F.lit("Alt "), name)), rule("alternate", "fr", F.lit("autre")), rule("official", None, F.concat(F.lit("Official "), name)))
        nested = F.struct(name.alias("primary"), F.create_map(F.lit("en"), F.initcap(name), F.lit("fr"), F.lit("nom")).alias("common"), rules.alias("rules"))
        return df.select(F.col("gers_id").alias("id"), subtype.alias("subtype"), "country", "region", nested.alias("names"))

    locals_ = named(p, F.when(F.col("key") % 2 == 0, F.lit("locality")).otherwise("county"), F.col("name"))
    by_country = p.groupBy("country").agg(F.concat(F.lit("k"), F.min("gers_id")).alias("gers_id")).withColumn("region", F.lit(None).cast("string"))
    by_region = p.where("region IS NOT NULL").groupBy("region").agg(F.concat(F.lit("r"), F.min("gers_id")).alias("gers_id"), F.min("country").alias("country"))
    return locals_.unionByName(named(by_country, F.lit("country"), F.concat(F.lit("Land "), F.col("country")))).unionByName(named(by_region, F.lit("region"), F.concat(F.lit("Area "), F.col("region"))))


@query(f"""
    WITH {PLACES_SQL}, us AS (SELECT *, CASE WHEN country = 'C1' THEN 'US' ELSE country END AS cc, CASE WHEN country = 'C1' THEN replace(region, 'C1-', 'US-') ELSE region END AS rr FROM places)
    SELECT gers_id, CASE WHEN cc = 'US' AND rr IS NOT NULL THEN name || ', ' || replace(rr, 'US-', '') WHEN rr IS NOT NULL THEN name || ', ' || rr ELSE name || ', ' || cc END AS primary_name FROM us""")
def primary_name(spark, sf_dir):
    cc = F.when(F.col("country") == "C1", "US").otherwise(F.col("country"))
    rr = F.when(F.col("country") == "C1", F.replace("region", F.lit("C1-"), F.lit("US-"))).otherwise(F.col("region"))
    return places(spark, sf_dir).select("gers_id", names.primary_name(F.col("name"), cc, rr).alias("primary_name"))


@query(f"""
    WITH {PLACES_SQL}, parts AS (
        SELECT gers_id, concat_ws(' ', name, upper(substr(name, 1, 2)), list_aggregate(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '),
               'Official ' || name, 'Alt ' || name, region, country, 'Land ' || country, 'Land ' || country, upper(substr('Land', 1, 2)), 'Alt Land ' || country, CASE WHEN region IS NOT NULL THEN 'Area ' || region END) AS t FROM places),
    words AS (SELECT DISTINCT gers_id, unnest(string_split(t, ' ')) AS w FROM parts)
    SELECT gers_id, lower(w) AS word, count(*) AS n FROM words WHERE w <> '' AND w NOT IN ('Alt Land') GROUP BY gers_id, lower(w)""")
def search_text_tokens(spark, sf_dir):
    d = _divisions(spark, sf_dir)
    p = d.where("subtype IN ('locality', 'county')").join(lookup.country_names(d), "country", "left").join(lookup.region_names(d), "region", "left")
    text = names.search_text(F.col("names.primary"), F.col("names.rules"), F.col("names.common"), F.col("country"), F.col("region"), F.col("country_name"), F.col("country_common"), F.col("country_short"), F.col("region_name"))
    return p.select(F.col("id").alias("gers_id"), F.explode(F.split(text, " ")).alias("word")).groupBy("gers_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT c_custkey, n_name AS country_name, r_name AS region_name FROM customer
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_left_join(spark, sf_dir):
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    n = lookup.one_per_code(n.where("n_nationkey % 5 <> 0"), "n_nationkey", "n_name")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("c_custkey", F.col("n_name").alias("country_name"), F.col("r_name").alias("region_name"))


@query("""
    WITH a AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, o_orderkey FROM orders)
    SELECT c_custkey, o_orderkey, o_totalprice AS area FROM customer JOIN a ON c_custkey = o_custkey WHERE rn = 1""")
def smallest_area_join(spark, sf_dir):
    areas = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("area"))
    best = lookup.smallest_area(read_table(spark, sf_dir, "customer"), areas, "c_custkey", F.struct("area", "o_orderkey"))
    return best.select("c_custkey", "o_orderkey", "area")


ADDRESS_SQL = """
    WITH a AS (
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 200 AS VARCHAR) END AS number, CASE WHEN s_suppkey % 6 <> 0 THEN 'Main St' END AS street,
               CASE WHEN s_suppkey % 7 = 0 THEN '#2' END AS unit, CASE WHEN s_suppkey % 5 <> 0 THEN ['S' || CAST(s_nationkey AS VARCHAR), 'City ' || CAST(s_suppkey % 4 AS VARCHAR)] ELSE ['S' || CAST(s_nationkey AS VARCHAR)] END AS levels,
               CASE WHEN s_suppkey % 2 = 0 THEN 'Posttown' END AS postal_city, CASE WHEN s_suppkey % 11 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS postcode FROM supplier)"""


@query(f"""{ADDRESS_SQL}
    SELECT s_suppkey, concat_ws(', ', nullif(concat_ws(' ', number, street, unit), ''), coalesce(levels[2], postal_city), concat(levels[1], ' ', postcode)) AS primary_name,
           lower(concat_ws(' ', coalesce(number, ''), coalesce(street, ''), coalesce(levels[2], postal_city, ''), coalesce(levels[1], ''), coalesce(postcode, ''), 'us')) AS search_text FROM a""")
def address_format(spark, sf_dir):
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    value = lambda x: F.struct(x.alias("value"))
    state, city = value(F.concat(F.lit("S"), nation)), value(F.concat(F.lit("City "), (k % 4).cast("string")))
    a = read_table(spark, sf_dir, "supplier").select(
        k, F.when(k % 3 != 0, (k % 200).cast("string")).alias("number"), F.when(k % 6 != 0, "Main St").alias("street"), F.when(k % 7 == 0, "#2").alias("unit"),
        F.when(k % 5 != 0, F.array(state, city)).otherwise(F.array(state)).alias("levels"),
        F.when(k % 2 == 0, "Posttown").alias("postal_city"), F.when(k % 11 != 0, F.lpad(k.cast("string"), 5, "0")).alias("postcode"),
    )
    st, ct = names.level(F.col("levels"), 1), names.level(F.col("levels"), 2)
    c = F.col
    return a.select(k, names.address_name(c("number"), c("street"), c("unit"), ct, c("postal_city"), st, c("postcode")).alias("primary_name"), names.address_text(c("number"), c("street"), ct, c("postal_city"), st, c("postcode")).alias("search_text"))


# --- nearby, polygons, refinement ---


@query(f"""
    WITH {PLACES_SQL}, {POINTS_SQL},
    d AS (SELECT point_id, gers_id, {haversine_sql('p_lat', 'p_lon', 'lat', 'lon')} AS km FROM points JOIN places ON subtype = 'locality' AND abs(lat - p_lat) < 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(km, 9), gers_id) AS rank FROM d WHERE km <= 300)
    SELECT point_id, gers_id, round(km, 6) AS distance_km, rank FROM k WHERE rank <= 5""")
def nearby_radius_topk(spark, sf_dir):
    f = places(spark, sf_dir).select("gers_id", "lat", "lon", F.col("subtype").alias("category"))
    return nearby(points(spark, sf_dir).drop("country"), f, 300.0, 5, "locality").select("point_id", "gers_id", r6("distance_km"), "rank")


RINGS = {1: [(-100.003, -50.001), (120.007, -40.002), (60.001, 70.004)], 2: [(0.003, 0.001), (90.002, 10.003), (30.004, 30.001), (10.001, 90.002)], 3: [(5.0, 5.0), (6.0, 6.0)]}


@query(f"""
    WITH {POINTS_SQL},
    edges AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})' for k, r in RINGS.items() if len(r) > 2 for a, b in zip(r, r[1:] + r[:1], strict=True))}) AS v(ring_id, ax, ay, bx, by_)),
    hit AS (
        SELECT point_id, ring_id, count(*) FILTER (WHERE (ay > p_lat) <> (by_ > p_lat) AND p_lon < (bx - ax) * (p_lat - ay) / CASE WHEN by_ = ay THEN 1 ELSE by_ - ay END + ax) % 2 = 1 AS inside
        FROM points CROSS JOIN edges GROUP BY ALL
    )
    SELECT point_id, CAST(ring_id AS BIGINT) AS ring_id, inside FROM hit UNION ALL SELECT point_id, 3, false FROM points""")
def point_in_ring(spark, sf_dir):
    point = lambda p: F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y"))
    rings = F.array(*(F.struct(F.lit(k).cast("long").alias("ring_id"), F.array(*map(point, r)).alias("ring")) for k, r in RINGS.items()))
    every = points(spark, sf_dir).withColumn("r", F.explode(rings))
    return every.select("point_id", "r.ring_id", geo.point_in_ring(F.col("p_lon"), F.col("p_lat"), F.col("r.ring")).alias("inside"))


@query(f"""
    WITH {POINTS_SQL} SELECT point_id, (p_lon > -120.005 AND p_lon < 100.005 AND p_lat > -60.005 AND p_lat < 70.005) AND NOT (p_lon > -20.005 AND p_lon < 30.005 AND p_lat > -10.005 AND p_lat < 40.005) AS inside,
           (p_lon > -120.005 AND p_lon < 100.005 AND p_lat > -60.005 AND p_lat < 70.005) AS in_outer FROM points""")
def point_in_polygon_holes(spark, sf_dir):
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    shape = F.lit(wkb.encode("Polygon", [box(-120.005, -60.005, 100.005, 70.005), box(-20.005, -10.005, 30.005, 40.005)]))
    p = points(spark, sf_dir).withColumn("g", shape)
    return p.select("point_id", wkb.covers("g", "p_lon", "p_lat").alias("inside"), wkb.covers("g", "p_lon", "p_lat", holes=False).alias("in_outer"))


@query(f"""{CANDS_SQL},
    checked AS (SELECT point_id, gers_id, nth, {CONFIDENCE_SQL} AS confidence, key % 3 AS kind, abs(p_lon - lon) + abs(p_lat - lat) < half * 0.995 + 0.0013 AS inside FROM cands)
    SELECT point_id, gers_id, nth AS rank, CASE WHEN nth <= 3 AND kind = 0 THEN 'exact' ELSE confidence END AS confidence
    FROM checked WHERE nth > 3 OR kind = 2 OR (kind = 0 AND inside)""")
def refine_verify(spark, sf_dir):
    p = places(spark, sf_dir)
    found = candidates(points(spark, sf_dir).drop("country"), _renamed(p))
    results = found.select("point_id", "gers_id", F.col("nth").alias("rank"), geo.area_confidence(F.col("area")).alias("confidence"), "p_lat", "p_lon")
    reach = F.col("half") * 0.995 + 0.0013
    corner = lambda dx, dy: F.struct((F.col("lon") + dx * reach).alias("x"), (F.col("lat") + dy * reach).alias("y"))
    ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))
    shapes = p.where("key % 3 <> 1").select("gers_id", F.when(F.col("key") % 3 == 0, ring).alias("ring"))
    out = refine.refine(results, shapes, geo.point_in_ring(F.col("p_lon"), F.col("p_lat"), F.col("ring")), F.col("ring").isNull(), 3)
    return out.select("point_id", "gers_id", "rank", "confidence")


@query(f"WITH {PLACES_SQL} SELECT gers_id, 'Polygon' AS type, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, round(area, 6) AS area FROM places")
def wkb_decode_area(spark, sf_dir):
    @F.pandas_udf("binary")
    def box(a, b, c, d):
        import pandas as pd

        return pd.Series([wkb.encode("Polygon", [[[w, s], [e, s], [e, n], [w, n], [w, s]]]) for w, s, e, n in zip(a, b, c, d, strict=True)])

    p = places(spark, sf_dir).withColumn("m", wkb.measures(box("xmin", "ymin", "xmax", "ymax")))
    return p.select("gers_id", "m.type", r6("m.xmin", "xmin"), r6("m.ymax", "ymax"), r6("m.area", "area"))


@query(f"""
    WITH {PLACES_SQL}, {POINTS_SQL},
    found AS (SELECT point_id, gers_id, area, row_number() OVER (PARTITION BY point_id ORDER BY area, gers_id) AS nth FROM points JOIN places ON xmin <= p_lon AND xmax >= p_lon AND ymin <= p_lat AND ymax >= p_lat),
    d AS (SELECT point_id, gers_id, {haversine_sql('p_lat', 'p_lon', 'lat', 'lon')} AS km FROM points JOIN places ON subtype = 'county' AND abs(lat - p_lat) < 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(km, 9), gers_id) AS rank FROM d WHERE km <= 200)
    SELECT point_id, 'divisions' AS branch, nth AS rank, gers_id FROM found WHERE nth <= 50 UNION ALL SELECT point_id, 'places' AS branch, rank, gers_id FROM k WHERE rank <= 5""")
def reverse_and_refine(spark, sf_dir):
    pts, p = points(spark, sf_dir).drop("country"), places(spark, sf_dir)
    div = candidates(pts, _renamed(p)).select("point_id", F.col("nth").alias("rank"), "gers_id")
    near = nearby(pts, p.select("gers_id", "lat", "lon", F.col("subtype").alias("category")), 200.0, 5, "county").select("point_id", "rank", "gers_id")
    nested = refine.reverse_and_refine(div, near)
    flat = lambda b: nested.select("point_id", F.lit(b).alias("branch"), F.explode(b).alias("x")).select("point_id", "branch", "x.rank", "x.gers_id")
    return flat("divisions").unionByName(flat("places"))


# --- output, parameters, catalogs ---


@query(f"""{SEARCH_SQL} SELECT query_id, count(*) AS n, min(gers_id) FILTER (WHERE rank = 1) AS first_id, round(min(lat) FILTER (WHERE rank = 1), 6) AS first_lat,
    round(min(xmin) FILTER (WHERE rank = 1), 6) AS first_xmin, count(*) FILTER (WHERE region IS NULL AND rank <= 3) AS bare FROM ranked WHERE rank <= 10 GROUP BY query_id""")
def json_results(spark, sf_dir):
    body = output.json_responses(_searched(spark, sf_dir).withColumnRenamed("subtype", "type"))
    get = lambda path: F.get_json_object("body", path)
    # by key: "region" is also a type
    bare = sum(F.when(~F.array_contains(F.json_object_keys(get(f"$.results[{i}]")), "region"), 1).otherwise(0) for i in range(3))
    return body.select("query_id", F.json_array_length(get("$.results")).cast("long").alias("n"), get("$.results[0].gers_id").alias("first_id"), r6(get("$.results[0].lat").cast("double"), "first_lat"), r6(get("$.results[0].bbox[0]").cast("double"), "first_xmin"), bare.cast("long").alias("bare"))


@query(f"""{SEARCH_SQL} SELECT query_id, count(*) AS n, min(gers_id) FILTER (WHERE rank = 1) AS first_id, round(min(lon) FILTER (WHERE rank = 1), 6) AS first_lon,
    'Point' AS kind, min(region) FILTER (WHERE rank = 1) AS first_region FROM ranked WHERE rank <= 10 GROUP BY query_id""")
def geojson_results(spark, sf_dir):
    body = output.geojson_responses(_searched(spark, sf_dir).withColumnRenamed("subtype", "type"))
    get = lambda path: F.get_json_object("body", path)
    first = "$.features[0]"
    return body.select("query_id", F.json_array_length(get("$.features")).cast("long").alias("n"), get(f"{first}.properties.gers_id").alias("first_id"), r6(get(f"{first}.geometry.coordinates[0]").cast("double"), "first_lon"), get(f"{first}.geometry.type").alias("kind"), get(f"{first}.properties.region").alias("first_region"))


@query(f"WITH {PLACES_SQL} SELECT subtype, count(*) AS n FROM places GROUP BY subtype")
def counts_by_subtype(spark, sf_dir):
    return places(spark, sf_dir).groupBy("subtype").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(f"WITH {PLACES_SQL} SELECT country, count(*) AS n FROM places GROUP BY country ORDER BY n DESC, country LIMIT 20")
def top_countries(spark, sf_dir):
    return places(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country").limit(20)


@query(f"WITH {PLACES_SQL} SELECT DISTINCT country FROM places WHERE country IS NOT NULL")
def distinct_countries(spark, sf_dir):
    return places(spark, sf_dir).where("country IS NOT NULL").select("country").distinct().orderBy("country")


LIMITS, FLAGS, SPOTS, CODES = ("5", "500", "x", None, "0", "-3", "7.5"), ("1", "true", "TRUE", "0", None), ("12.5", "-90", "90.01", "abc", None, "180"), ("US", "us", "GB-ENG", "CN-XX", "usa-MA", None)


def _pick_sql(values: tuple, by: int) -> str:
    return f"list_extract([{', '.join(map(_lit, values))}], CAST(event_id // {by} % {len(values)} + 1 AS INT))"


def pick(values: tuple, by: int):
    """A value for each event, in turn."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.floor(F.col("event_id") / by) % len(values) + 1).cast("int"))


@query(rf"""
    WITH raw AS (SELECT event_id, {_pick_sql(LIMITS, 1)} AS lim, {_pick_sql(FLAGS, 2)} AS flag, {_pick_sql(SPOTS, 1)} AS lat, {_pick_sql(SPOTS, 3)} AS lon, {_pick_sql(CODES, 1)} AS code, repeat(event_type, CAST(event_id % 60 AS INT)) AS q FROM events)
    SELECT event_id, least(coalesce(CASE WHEN regexp_full_match(lim, '\+?\d+') THEN TRY_CAST(lim AS BIGINT) END, 10), 40) AS lim, coalesce(flag IN ('1', 'true'), true) AS autocomplete,
           CASE WHEN q = '' THEN 'missing query' WHEN strlen(q) > 200 THEN 'query too long' END AS query_error,
           CASE WHEN TRY_CAST(lat AS DOUBLE) IS NULL THEN 'bad lat' WHEN TRY_CAST(lon AS DOUBLE) IS NULL THEN 'bad lon' WHEN NOT TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 THEN 'lat out of range' WHEN NOT TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180 THEN 'lon out of range' END AS point_error,
           coalesce(regexp_full_match(code, '[A-Z]{{2}}'), false) AS is_country, coalesce(regexp_full_match(code, '[A-Z]{{2}}-[A-Z0-9]{{1,3}}'), false) AS is_region FROM raw""")
def param_validation(spark, sf_dir):
    raw = read_table(spark, sf_dir, "events").select("event_id", pick(LIMITS, 1).alias("lim"), pick(FLAGS, 2).alias("flag"), pick(SPOTS, 1).alias("lat"), pick(SPOTS, 3).alias("lon"), pick(CODES, 1).alias("code"), F.expr("repeat(event_type, CAST(event_id % 60 AS INT))").alias("q"))
    c = F.col
    return raw.select("event_id", params.limit(c("lim")).alias("lim"), params.flag(c("flag"), True).alias("autocomplete"), params.query_error(c("q")).alias("query_error"), params.point_error(c("lat"), c("lon")).alias("point_error"), params.is_country(c("code")).alias("is_country"), params.is_region(c("code")).alias("is_region"))


LINKS = [("root", "./catalog.json", None), ("child", "./2025-01-15.0/collection.json", None), ("child", "./2025-03-01.0/collection.json", True), ("child", "./2024-12-01.0/collection.json", False)]


@query(rf"""
    WITH {_values('links', LINKS, 'rel, href, latest')}, v AS (SELECT regexp_extract(href, '^(?:\./)?([^/]+)', 1) AS version, coalesce(latest, false) AS latest FROM links WHERE rel = 'child' UNION ALL SELECT '2025-03-01.0', true)
    SELECT version, bool_or(latest) AS latest FROM v GROUP BY version""")
def stac_latest_version(spark, sf_dir):
    links = spark.createDataFrame(LINKS, "rel string, href string, latest boolean")
    return catalog.all_versions(links, "2025-03-01.0").join(catalog.latest_version(links).withColumn("latest", F.lit(True)), "version", "left").select("version", F.coalesce("latest", F.lit(False)).alias("latest"))


RESPONSES = [
    (1, '[{"gers_id": "a", "primary_name": "A", "type": "county", "lat": 1.5, "lon": 2.5, "boundingbox": [1.0, 2.0, 3.0, 4.0]}]'),
    (2, '{"results": [{"gers_id": "b", "name": "B", "type": "locality", "lat": 3.5, "lon": 4.5, "bbox": [5.0, 6.0, 7.0, 8.0]}, {"gers_id": "c", "name": "C"}]}'),
    (3, '{"gers_id": "d", "primary_name": "D", "subtype": "region", "lat": 0.5, "lon": -1.5}'),
    (4, "{}"),
]


@query("""
    SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 'A', 'county', CAST(1.5 AS DOUBLE), CAST(1.0 AS DOUBLE)), (2, 'b', 'B', 'locality', 3.5, 5.0), (2, 'c', 'C', NULL, NULL, NULL), (3, 'd', 'D', 'region', 0.5, NULL)) AS v(response_id, gers_id, name, type, lat, xmin)""")
def response_aliases(spark, sf_dir):
    df = spark.createDataFrame(RESPONSES, "response_id long, body string")
    return df.select("response_id", F.explode(parsed_response(F.col("body"))).alias("r")).select("response_id", "r.gers_id", F.col("r.primary_name").alias("name"), "r.type", "r.lat", F.try_element_at("r.bbox", F.lit(1)).alias("xmin"))


@query("SELECT count(*) AS n FROM part")
def non_empty_gate(spark, sf_dir):
    return non_empty(read_table(spark, sf_dir, "part"), "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {_values('q', [(1, 'Boston MA'), (2, 'St. Louis'), (3, '...')], 'query_id, text')}, t AS (SELECT query_id, {tokens_sql('text')} AS toks FROM q)
    SELECT query_id, unnest(toks) AS token, unnest(list_transform(range(len(toks)), lambda i: i = len(toks) - 1)) AS prefix FROM t""")
def query_tokens(spark, sf_dir):
    from geoloom.functions.text import fts_tokens

    df = spark.createDataFrame([(1, "Boston MA"), (2, "St. Louis"), (3, "...")], "query_id long, text string")
    return df.select("query_id", F.explode(fts_tokens(F.col("text"))).alias("t")).select("query_id", F.col("t.text").alias("token"), "t.prefix")


@query(f"""{SHARDS_SQL}, pairs AS (
        SELECT shard_id, 'type' AS key, CASE WHEN shard_id = 'HEAD' THEN 'head' WHEN contains(shard_id, '-') THEN 'region' ELSE 'country' END AS value FROM stats
        UNION ALL SELECT shard_id, 'record_count', CAST(record_count AS VARCHAR) FROM stats UNION ALL SELECT shard_id, 'version', '2025-01-01.0' FROM stats
        UNION ALL SELECT shard_id, 'country', string_split(shard_id, '-')[1] FROM stats WHERE shard_id <> 'HEAD'
        UNION ALL SELECT shard_id, 'region', shard_id FROM stats WHERE shard_id <> 'HEAD' AND contains(shard_id, '-')
        UNION ALL SELECT shard_id, 'population_threshold', '500000' FROM stats WHERE shard_id = 'HEAD')
    SELECT * FROM pairs""")
def shard_metadata(spark, sf_dir):
    stats = shards.shard_stats(_assigned(spark, sf_dir), size())
    return catalog.shard_metadata(stats, "2025-01-01.0", 500_000).where("key <> 'created_at'")


@query(f"""{SHARDS_SQL} SELECT shard_id, CASE WHEN shard_id <> 'HEAD' AND contains(shard_id, '-') THEN shard_id END AS value FROM stats""")
def metadata_get(spark, sf_dir):
    stats = shards.shard_stats(_assigned(spark, sf_dir), size())
    return catalog.metadata_of(catalog.shard_metadata(stats, "v"), stats, "region")


@query("SELECT count(*) AS n, count(*) > 0 AS accessible, '2025-04-01.0' AS release, '2025-03-01.0' AS published, true AS newer FROM part")
def release_compare(spark, sf_dir):
    links = spark.createDataFrame(LINKS, "rel string, href string, latest boolean")
    return catalog.release_status(read_table(spark, sf_dir, "part"), links, "2025-04-01.0")


@query(f"WITH {PLACES_SQL} SELECT gers_id FROM places WHERE xmin <= 30 AND xmax >= -20 AND ymin <= 50 AND ymax >= 10")
def box_scan(spark, sf_dir):
    from geoloom.sources.readers import in_box

    boxed = places(spark, sf_dir).withColumn("bbox", F.struct("xmin", "ymin", "xmax", "ymax"))
    return in_box(boxed, -20.0, 10.0, 30.0, 50.0).select("gers_id")


@query(f"WITH {PLACES_SQL} SELECT gers_id, name FROM places WHERE key IN (SELECT s_suppkey FROM supplier)")
def features_by_id(spark, sf_dir):
    from geoloom.sources.readers import by_id

    ids = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("gers_id"))
    return by_id(places(spark, sf_dir), ids).select("gers_id", "name")


@query(f"""{SEARCH_SQL} SELECT query_id, rank, name || ' (' || subtype || ', ' || coalesce(country, '??') || ')' AS shown FROM ranked WHERE rank <= 10""")
def text_output(spark, sf_dir):
    lines = output.text_lines(_searched(spark, sf_dir).withColumnRenamed("subtype", "type"))
    return lines.select("query_id", "rank", F.regexp_extract("line", r"^\d+\. (.* \(.*\)) \[", 1).alias("shown"))
