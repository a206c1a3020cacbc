"""Full-text search against SQLite's FTS5, and the ranking rules on a small gazetteer."""

import sqlite3

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions.text import Porter
from geoloom.operators.bm25 import TextIndex, match, match_few
from geoloom.operators.merge import merge_results
from geoloom.plans import search as forward

TEXTS = [
    "boston massachusetts united states ma us suffolk county", "cambridge massachusetts united states ma us middlesex county", "worcester county massachusetts united states ma us",
    "south boston southie massachusetts", "paris france île-de-france fr europe", "jefferson parish louisiana", "new york city nyc ny new york united states", "são paulo brasil",
    "winston-salem north carolina", "winston salem street", "salem winston", "springfield springfields springing", "tokyo japan jp 東京", "", "hopping relational generalization adjustments controlling",
]
QUERIES = [("boston", False), ("bost", True), ("new york", False), ("winston-salem", False), ("winston-sal", True), ("paris", True), ("sao paulo", False), ("são", True), ("massachusett", True), ("springing", False), ("hop relat", True), ("zzz", True), ("- boston", False), ("control", False)]


def sqlite_hits(stem: bool) -> dict:
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{'porter ' if stem else ''}unicode61 remove_diacritics 1')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(TEXTS))
    out = {}
    for i, (q, auto) in enumerate(QUERIES):
        words = [f'"{w}"' for w in q.lower().split()]
        try:
            hits = con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" ".join(words) + "*" * auto,)).fetchall()
        except sqlite3.OperationalError:
            hits = []
        out |= {(i, r): s for r, s in hits}
    return out


@pytest.mark.parametrize("stem", [False, True])
def test_same_hits_and_scores_as_fts5(spark, stem):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    queries = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(QUERIES)], "query_id long, text string, autocomplete boolean")
    got = {(r.query_id, r.doc_id): r.bm25 for r in match(queries, TextIndex.build(docs, "text", "doc_id", None, stem)).collect()}
    want = sqlite_hits(stem)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@settings(max_examples=300, deadline=None)
@example("ies")
@example("sses")
@example("eeds")
@example("yying")
@given(st.text(alphabet="aeioubcdlmnrstyzgv", min_size=3, max_size=12) | st.tuples(st.text(alphabet="aeioubcst", max_size=3), st.sampled_from([*"sed", "ies", "sses", "eed", "ing", "ational", "ies", "iveness", "ll", "ion"])).map("".join).filter(lambda w: len(w) > 2))
def test_porter_as_in_fts5(word):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    con.execute("INSERT INTO t VALUES (?)", (word,))
    assert con.execute("SELECT term FROM v").fetchone()[0] == Porter.stem(word)


def gazetteer(spark):
    rows = [
        ("a", "Paris", "locality", 2_161_000, "FR", 48.8566, 2.3522, "paris france fr"), ("b", "Paris, TX", "locality", 25_000, "US", 33.66, -95.55, "paris texas us"),
        ("c", "Jefferson Parish, LA", "county", 432_000, "US", 29.9, -90.1, "jefferson parish louisiana us"), ("d", "Boston, MA", "locality", 675_647, "US", 42.36, -71.06, "boston massachusetts us"),
        ("e", "South Boston, MA", "macrohood", None, "US", 42.34, -71.05, "south boston massachusetts us"),
    ]
    return spark.createDataFrame(rows, "gers_id string, name string, subtype string, population long, country string, lat double, lon double, search_text string").withColumn("shard_id", F.lit("HEAD")).withColumn("region", F.lit(None).cast("string"))


def ranked(spark, text, **bias):
    p = gazetteer(spark)
    q = spark.createDataFrame([(1, text, bias.get("country"), bias.get("lat"), bias.get("lon"), bias.get("limit"))], "query_id long, text string, bias_country string, bias_lat double, bias_lon double, limit int")
    out = forward.search(q, TextIndex.build(p, "search_text", "gers_id", "shard_id"), p.drop("search_text"))
    return [r.gers_id for r in out.orderBy("rank").collect()]


def test_ranking(spark):
    assert ranked(spark, "paris")[0] == "a"
    assert set(ranked(spark, "paris", country="US")[:2]) == {"b", "c"}  # both American, the more populous parish first
    assert ranked(spark, "paris", lat=33.6, lon=-95.5, country="US")[0] == "b"
    assert ranked(spark, "bost")[0] == "d" and set(ranked(spark, "bost")) == {"d", "e"}
    assert ranked(spark, "...") == [] and ranked(spark, "nothing here") == []
    assert len(ranked(spark, "us", limit=1)) == 1
    assert len(ranked(spark, "us", limit=0)) == 1


def test_merge_rules(spark):
    rows = [(1, "x", 0, 0.2), (1, "x", 1, 0.9), (1, "y", 1, 0.5), (1, "z", 1, 0.5), (1, "w", 0, 0.1)]
    df = spark.createDataFrame(rows, "query_id long, gers_id string, source_rank long, importance double")
    best = [(r.gers_id, r.importance) for r in merge_results(df, "best", 3).orderBy("rank").collect()]
    head = [(r.gers_id, r.importance) for r in merge_results(df, "head_first", 3).orderBy("rank").collect()]
    assert best == [("x", 0.9), ("y", 0.5), ("z", 0.5)]
    assert head == [("y", 0.5), ("z", 0.5), ("x", 0.2)]
    assert merge_results(df.limit(0)).count() == 0


def test_index_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    TextIndex.build(docs, "text", "doc_id", None).write(str(tmp_path))
    q = spark.createDataFrame([(0, "boston", False)], "query_id long, text string, autocomplete boolean")
    assert {r.doc_id for r in match(q, TextIndex.read(spark, str(tmp_path))).collect()} == {0, 3}


def shuffled_bytes(df) -> int:
    """Bytes that the finished plan of a collected table wrote to shuffles, shared ones once."""
    seen, total = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            seen.append(node.plan())
        elif name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleBytesWritten").value()
        seen += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_shuffles_do_not_grow_with_queries_times_postings(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', 'common', concat('a', id % 10), concat('b', id % 300)) AS text")
    index = TextIndex.build(docs, "text", "doc_id", None)

    def asked(copies: int):
        rows = [(10 * c + i, f"common a{i} b{10 * c + i}", False) for c in range(copies) for i in range(10)]
        out = match(spark.createDataFrame(rows, "query_id long, text string, autocomplete boolean"), index, prefixes=False)
        assert sorted((r.query_id, r.doc_id) for r in out.collect()) == sorted((q, d) for q, _, _ in rows for d in range(q, 3000, 300))
        return shuffled_bytes(out)

    assert asked(30) < 6 * asked(3)


def test_few_queries_have_the_same_hits(spark):
    # a phrase of two terms, repeated tokens and terms, several shards, and texts and queries without terms
    texts = [*TEXTS, "salem salem winston", "winston salem winston-salem", "new new york", None]
    docs = spark.createDataFrame([(i, t, f"s{n}") for i, t in enumerate(texts) for n in range(1 + i % 2)] + [(99, "boston", None)], "doc_id long, text string, shard_id string")
    asked = [q for q, _ in QUERIES] + ["winston-salem winston", "new new york", "salem-salem", "boston boston", "united states", ""]
    queries = spark.createDataFrame([(i, q, False) for i, q in enumerate(asked)], "query_id long, text string, autocomplete boolean")
    index = TextIndex.build(docs, "text")
    hits = lambda df: sorted((r.query_id, r.shard_id, r.doc_id, round(r.bm25, 12)) for r in df.collect())
    want = hits(match(queries, index, prefixes=False))
    assert hits(match_few(queries, index)) == want and len({r[0] for r in want}) > 10 and {r[1] for r in want} == {"s0", "s1"}
    assert hits(match_few(queries.limit(0), index)) == [] == hits(match_few(queries, TextIndex.build(docs.limit(0), "text")))
    with pytest.raises(ValueError):
        match_few(queries, index.without(docs.limit(1)))


def test_batch_first_hit_shuffles_no_postings(spark, data, tmp_path):
    from geoloom.plans.registry import QUERIES as registered

    customers = spark.read.parquet(f"{data}/customer.parquet").crossJoin(spark.range(200).withColumnRenamed("id", "copy"))
    customers.withColumn("c_custkey", F.col("c_custkey") + F.col("copy") * 150).drop("copy").coalesce(2).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("nation", "region", "part"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        out = registered["batch_first_hit"](spark, str(tmp_path))
        assert len(out.collect()) == 200
        assert shuffled_bytes(out) < 100 * 200 * 150  # of 30,000 customers
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
