"""Full-text search over an inverted index, ranked by BM25 within each shard.

The index has three tables: postings (shard_id, term, doc_id, position, doc_len), documents (shard_id, doc_id,
doc_len) and, counted from it, shards (shard_id, docs, mean_length).  Query tokens meet postings in an equality join; a prefix token is first
expanded over the distinct terms by an equality join on its first letters.  Only postings of query
terms are shuffled, once for all queries, as counts by shard, document and phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.score import bm25_part, idf, weighted_part
from geoloom.functions.text import fts_tokens, index_terms, porter
from geoloom.operators.merge import top_of

PREFIX_KEY = 3
BUCKETS = 1 << 18


def stemmed(terms: DataFrame, column: str) -> DataFrame:
    """The rows with ``column`` replaced by its stem, computed once for each distinct term."""
    stems = terms.select(F.col(column).alias("__raw")).distinct().withColumn("__stem", porter("__raw"))
    return terms.join(stems, F.col(column) == F.col("__raw")).drop(column, "__raw").withColumnRenamed("__stem", column)


@dataclass
class TextIndex:
    postings: DataFrame
    documents: DataFrame
    stem: bool = False
    #: (shard_id, doc_id, doc_len, words): the terms of each document in order; only of an index just built without stems.
    lists: DataFrame | None = None

    @property
    def shards(self) -> DataFrame:
        """(shard_id, docs, mean_length)."""
        return self.documents.groupBy("shard_id").agg(F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("mean_length"))

    @classmethod
    def build(cls, docs: DataFrame, text: str = "search_text", doc: str = "doc_id", shard: str | None = "shard_id", stem: bool = False) -> TextIndex:
        """Index (shard, doc, text); without a shard column all documents are one shard.  Null texts are empty documents."""
        where = F.col(shard) if shard else F.lit("ALL")
        lists = docs.select(where.alias("shard_id"), F.col(doc).alias("doc_id"), F.coalesce(index_terms(F.col(text)), F.array().cast("array<string>")).alias("terms"))
        # the length first: else every exploded row would carry the whole array
        sized = lists.select("shard_id", "doc_id", F.size("terms").alias("doc_len"), "terms")
        words = sized.select("shard_id", "doc_id", "doc_len", F.posexplode("terms").alias("position", "term"))
        if stem:
            words = stemmed(words, "term")
        return cls(words, sized.select("shard_id", "doc_id", "doc_len"), stem, None if stem else sized.withColumnRenamed("terms", "words"))

    def without(self, ids: DataFrame) -> TextIndex:
        """The index less the documents (shard_id, doc_id) in ``ids``; ids that it does not hold change nothing."""
        gone = ids.select("shard_id", "doc_id").distinct()
        keep = lambda t: t.join(gone, ["shard_id", "doc_id"], "left_anti")
        return TextIndex(keep(self.postings), keep(self.documents), self.stem)

    def updated(self, docs: DataFrame, text: str = "search_text", doc: str = "doc_id", shard: str = "shard_id") -> TextIndex:
        """The index with these documents: those that it holds are replaced, the others added."""
        new = TextIndex.build(docs, text, doc, shard, self.stem)
        old = self.without(docs.select(F.col(shard).alias("shard_id"), F.col(doc).alias("doc_id")))
        names = self.postings.columns
        return TextIndex(old.postings.select(names).unionByName(new.postings.select(names)), old.documents.unionByName(new.documents), self.stem)

    def write(self, path: str) -> None:
        """Save the index; postings are range-partitioned and sorted by term, so that a term's rows lie together and row groups prune."""
        self.postings.repartitionByRange("shard_id", "term").sortWithinPartitions("shard_id", "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.documents.repartitionByRange("shard_id", "doc_id").sortWithinPartitions("shard_id", "doc_id").write.mode("overwrite").parquet(f"{path}/documents")

    def append(self, path: str) -> None:
        """Add these documents, which must be new to it, to a saved index, as files of their own; :meth:`compact` merges them."""
        self.postings.sortWithinPartitions("shard_id", "term", "doc_id").write.mode("append").parquet(f"{path}/postings")
        self.documents.write.mode("append").parquet(f"{path}/documents")

    @classmethod
    def compact(cls, spark: SparkSession, path: str, to: str, stem: bool = False) -> TextIndex:
        """Rewrite a saved index, with all that was appended, in order at another place; the old one stays until readers have moved."""
        cls.read(spark, path, stem).write(to)
        return cls.read(spark, to, stem)

    @classmethod
    def read(cls, spark: SparkSession, path: str, stem: bool = False) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"), stem)


def query_phrases(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, token, phrase, prefix, terms) from queries (query_id, text, autocomplete).

    A token is a phrase of the index terms in it ("winston-salem" has two); only the last term of a
    prefix token is a prefix.  ``phrase`` writes the terms and the prefix out as one key.  Tokens without
    terms are ignored, and a query without any finds nothing.
    """
    tokens = queries.select("query_id", F.posexplode(fts_tokens(F.col("text"), F.col("autocomplete"))).alias("token", "t"))
    phrases = tokens.select("query_id", "token", "t.prefix", index_terms(F.col("t.text")).alias("terms")).where(F.size("terms") > 0)
    if stem:
        parts = stemmed(phrases.select("query_id", "token", "prefix", F.posexplode("terms").alias("part", "term")), "term")
        lists = parts.groupBy("query_id", "token", "prefix").agg(F.array_sort(F.collect_list(F.struct("part", "term"))).alias("parts"))
        phrases = lists.select("query_id", "token", "prefix", F.col("parts.term").alias("terms"))
    key = F.concat(F.concat_ws(" ", "terms"), F.when(F.col("prefix"), "*").otherwise(""))
    return phrases.select("query_id", "token", key.alias("phrase"), "prefix", "terms")


def in_buckets(rows: DataFrame, keys: DataFrame, columns: list[str], mark: str | None = None) -> DataFrame:
    """The rows whose ``columns`` share a hash bucket with some of ``keys``, or all rows with ``mark`` telling which do.

    The broadcast has at most ``BUCKETS`` numbers.  It keeps most other rows from a shuffle; an exact join must follow.
    """
    bucket = F.xxhash64(*columns).bitwiseAND(F.lit(BUCKETS - 1))  # never null: a filter for that would part the branches too
    full = F.broadcast(keys.select(bucket.alias("__bucket")).distinct())
    if mark:
        return rows.join(full, bucket == F.col("__bucket"), "left").withColumn(mark, F.col("__bucket").isNotNull()).drop("__bucket")
    # no semi-join: Spark would push it below an aggregate that several branches share
    return rows.join(full, bucket == F.col("__bucket")).drop("__bucket")


def frequencies(postings: DataFrame, wanted: DataFrame, place: list[str]) -> DataFrame:
    """(shard_id, doc, doc_len, phrase, tf) for the documents that hold a phrase of ``wanted`` (phrase, parts, part, term[, shard_id])."""
    # another name than doc_id: Spark drops an alias to the same name in some branches only, which then share no shuffle
    postings = postings.where("shard_id IS NOT NULL").withColumnRenamed("doc_id", "doc")
    doc = ["shard_id", "doc", "doc_len", "phrase"]
    begin = F.when(F.col("parts") > 1, F.col("position") - F.col("part"))
    hits = in_buckets(postings, wanted, place).join(wanted, place)
    # parts as an aggregate: Spark would push a filter on a key below the shuffle, which both branches share
    begun = hits.groupBy(*doc, begin.alias("begin")).agg(F.count(F.lit(1)).alias("found"), F.max("parts").alias("parts"))
    single = begun.where("parts = 1").select(*doc, F.col("found").alias("tf"))
    return single.unionByName(begun.where("parts > 1 AND found = parts").groupBy(*doc).agg(F.count(F.lit(1)).alias("tf")))


def match(queries: DataFrame, index: TextIndex, prefixes: bool = True, shards: DataFrame | None = None) -> DataFrame:
    """(query_id, shard_id, doc_id, bm25) for the documents that have all tokens of a query.

    With ``prefixes`` off no query may ask for autocompletion, and the distinct terms are not read.  With ``shards``
    (query_id, shard_id) a query reads the postings of its shards alone.

    A phrase is counted once for all queries that ask for it.  A query then meets only documents that hold its
    rarest phrase in the shard, each with the list of its phrases, so that nothing grows with queries times postings.
    """
    phrases = query_phrases(queries, index.stem)
    asked = phrases.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "phrase"))).alias("tokens")).select("query_id", F.col("tokens.phrase").alias("phrases"))
    place, shared = ["term"], ["phrase"]
    if shards is not None:
        chosen = shards.select("query_id", "shard_id").distinct()
        phrases, asked = phrases.join(chosen, "query_id"), asked.join(chosen, "query_id")
        place, shared = ["shard_id", "term"], ["shard_id", "phrase"]
    distinct = phrases.select(*shared, "prefix", "terms").distinct()
    parts = distinct.select(*shared, F.size("terms").alias("parts"), "prefix", F.posexplode("terms").alias("part", "term"))
    last = F.col("prefix") & (F.col("part") == F.col("parts") - 1)
    wanted = parts.where(~last).drop("prefix")
    if prefixes:
        loose = parts.where(last).withColumn("key", F.substring("term", 1, PREFIX_KEY)).drop("prefix")
        words = index.postings.select(F.col("term").alias("word")).distinct()
        keyed = words.withColumn("key", F.explode(F.array_distinct(F.array(*(F.substring("word", 1, n) for n in range(1, PREFIX_KEY + 1))))))
        wanted = wanted.unionByName(loose.join(keyed, "key").where(F.startswith("word", "term")).drop("term", "key").withColumnRenamed("word", "term"))

    counted = frequencies(index.postings, wanted, place)
    # count_if and not count: all branches have to read the same columns to share the shuffle
    spread = counted.groupBy("shard_id", "phrase").agg(F.count_if(F.col("tf") > 0).alias("with_term"))
    needed = asked.withColumn("phrase", F.explode(F.array_distinct("phrases"))).join(spread, shared)
    found = needed.groupBy("query_id", "shard_id", "phrases").agg(
        F.map_from_entries(F.collect_list(F.struct("phrase", "with_term"))).alias("with_terms"), F.min(F.struct("with_term", "phrase"))["phrase"].alias("phrase")
    )
    known = found.where(F.size("with_terms") == F.size(F.array_distinct("phrases")))

    marked = in_buckets(counted, known, ["shard_id", "phrase"], "rare")
    docs = in_buckets(marked, marked.where("rare AND tf > 0"), ["shard_id", "doc"]).groupBy("shard_id", "doc", "doc_len")
    lists = docs.agg(F.map_from_entries(F.collect_list(F.struct("phrase", "tf"))).alias("tfs"), F.collect_list(F.when(F.col("rare"), F.col("phrase"))).alias("rare"))
    held = lists.select("shard_id", "doc", "doc_len", "tfs", F.map_keys("tfs").alias("held"), F.explode("rare").alias("phrase"))
    whole = held.join(known, ["shard_id", "phrase"]).where(F.forall("phrases", lambda p: F.array_contains(F.col("held"), p))).join(index.shards, "shard_id")
    part = lambda p: bm25_part(F.element_at("tfs", p), F.col("docs"), F.element_at("with_terms", p), F.col("doc_len"), F.col("mean_length"))
    return whole.select("query_id", "shard_id", F.col("doc").alias("doc_id"), F.aggregate("phrases", F.lit(0.0), lambda acc, p: acc + part(p)).alias("bm25"))


def match_few(queries: DataFrame, index: TextIndex) -> DataFrame:
    """As :func:`match` without prefixes, for queries whose number the caller bounds, over an index just built.

    The queries go to the documents by broadcasts, a row for each query and shard that can have a hit.  Each candidate,
    found by the first terms of a query's two rarest phrases, is held against the document's own list of terms, which the
    document's row brings along.  So no posting is shuffled; the work for a candidate grows with the document's length.
    """
    if index.lists is None:
        raise ValueError("the index does not hold its documents' terms")
    phrases = query_phrases(queries, index.stem)
    asked = phrases.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "phrase"))).alias("tokens")).select("query_id", F.col("tokens.phrase").alias("phrases"))
    wanted = phrases.select(F.col("terms")[0].alias("term"), "phrase", "terms").distinct()
    rows = index.lists.where("shard_id IS NOT NULL").withColumn("term", F.explode(F.array_distinct("words")))

    words = F.col("words")
    begun = lambda terms: F.size(F.filter(words, lambda w, i: (w == terms[0]) & (F.slice(words, i + 1, F.size(terms)) == terms)))
    count = lambda terms: F.when(F.size(terms) == 1, F.size(words) - F.size(F.array_remove(words, terms[0]))).otherwise(begun(terms))
    held = lambda terms: F.array_contains(words, terms[0]) & ((F.size(terms) == 1) | (begun(terms) > 0))
    spread = rows.join(F.broadcast(wanted), "term").where(held(F.col("terms"))).groupBy("shard_id", "phrase", "terms").agg(F.count(F.lit(1)).alias("with_term"))
    needed = asked.withColumn("phrase", F.explode(F.array_distinct("phrases"))).join(spread, "phrase")
    found = needed.groupBy("query_id", "shard_id", "phrases").agg(F.array_sort(F.collect_list(F.struct("with_term", "phrase", "terms"))).alias("rarest"))
    known = found.where(F.size("rarest") == F.size(F.array_distinct("phrases"))).join(index.shards, "shard_id")
    first = F.transform("rarest", lambda r: r["terms"][0])
    known = known.withColumns({"term": first[0], "other": F.coalesce(F.get(first, F.lit(1)), first[0]), "third": F.coalesce(F.get(first, F.lit(2)), first[0])})
    others = known.groupBy("shard_id", "term").agg(F.collect_set("other").alias("others"))
    facts = F.map_from_entries(F.transform("rarest", lambda r: F.struct(r["phrase"], F.struct(r["terms"], idf(F.col("docs"), r["with_term"]).alias("weight")))))
    # what is the same for all documents is computed here, once
    known = known.withColumn("sought", F.transform("phrases", lambda p: F.element_at(facts, p))).select("query_id", "shard_id", "term", "other", "third", "sought", "mean_length")

    # by two terms of a query: by one alone, a frequent term would meet each document with it once for each query; a third
    # before all others, as that test needs no lambda
    both = rows.join(F.broadcast(others), ["shard_id", "term"]).withColumn("other", F.explode(F.array_intersect("others", "words"))).drop("others")
    pairs = both.join(F.broadcast(known), ["shard_id", "term", "other"]).where(F.array_contains("words", F.col("third"))).where(F.forall("sought", lambda r: held(r["terms"])))
    counted = F.transform("sought", lambda r: F.struct(r["weight"].alias("weight"), count(r["terms"]).alias("tf")))
    part = lambda r: weighted_part(r["weight"], r["tf"], F.col("doc_len"), F.col("mean_length"))
    return pairs.select("query_id", "shard_id", "doc_id", F.aggregate(counted, F.lit(0.0), lambda acc, r: acc + part(r)).alias("bm25"))


def search_text(queries: DataFrame, index: TextIndex, limit: Column | int = 10, prefixes: bool = True) -> DataFrame:
    """:func:`match` cut to the best ``limit`` documents of each query and shard, ties by doc_id."""
    return top_of(match(queries, index, prefixes), ["query_id", "shard_id"], [F.round("bm25", 9), F.asc("doc_id")], limit)
