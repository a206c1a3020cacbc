"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.decontaminate import EVIDENCE_WORDS, contamination
from geoloom.llm.exact_dedup import exact_dedup
from geoloom.llm.language_id import held_out, language_id
from geoloom.llm.line_dedup import line_dedup
from geoloom.llm.packing import pack
from geoloom.llm.secret_scan import find_secrets, secret_digests
from geoloom.llm.simhash import near_duplicates
from geoloom.llm.substring_dedup import substring_dedup
from geoloom.llm.toxicity import learn as learn_toxicity
from geoloom.llm.toxicity import toxicity
from geoloom.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return pack(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a field learnt from the labelled ones that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    field = learn_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), field, carry=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents without lines that an earlier document holds."""
    return line_dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents without repeated windows of 35 words."""
    return substring_dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items that they hold."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_words=EVIDENCE_WORDS).withColumnRenamed("row_key", "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a digest and the list of the secrets in all documents."""
    return secret_digests(find_secrets(_table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages after a round trip through archives."""
    return round_trip(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the labelled ones that are not held out."""
    return language_id(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one of their group that stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_line_dedup, op4_substring_dedup, op5_decontaminate, op6_secrets, op7_warc, op8_language_id, op9_simhash, op10_exact_dedup)}

ORACLES = {
    "op3_line_dedup": r"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ),
        firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        judged AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op4_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ),
        begins AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS run FROM begins),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS n FROM windows) WHERE n > 1),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        marked AS (
            SELECT e.doc_id, e.i, e.word, coalesce(max(a.i) OVER (PARTITION BY e.doc_id ORDER BY e.i) >= e.i - 34, false) AS gone
            FROM each e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.i = e.i
        ),
        kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS line
            FROM marked GROUP BY doc_id
        )
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, body, octet_length(encode(body)) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS best FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                   + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
                   + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
                   + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM w
    """,
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t
        WINDOW best AS (PARTITION BY norm ORDER BY len DESC, doc_id)
    """,
}
