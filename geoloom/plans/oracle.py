"""SQL for the full-text queries: fragments of common table expressions for the same semantics."""

from __future__ import annotations

from geoloom.functions.text import fold_table

_FROM, _TO = fold_table()


def terms_sql(text: str) -> str:
    """The list of index terms of a text."""
    return rf"list_filter(regexp_split_to_array(translate(lower({text}), '{_FROM}', '{_TO}'), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({text}, '[^\p{{L}}\p{{N}}\s-]', ' ', 'g')), '\s+'), lambda t: t <> '')"


def bm25_sql(docs: str, queries: str, prefixes: bool = True) -> str:
    """CTEs ending in hits(query_id, shard_id, doc_id, bm25).

    ``docs`` names (shard_id, doc_id, text), ``queries`` (query_id, text, autocomplete); query tokens have no hyphens.
    Without ``prefixes`` no query asks for autocompletion.
    """
    loose = " OR (t.autocomplete AND t.i = t.n_tok - 1 AND starts_with(p.term, t.tok))" if prefixes else ""
    return f"""
    fts_docs AS (SELECT shard_id, doc_id, coalesce({terms_sql('text')}, []) AS terms FROM {docs}),
    fts_stats AS (SELECT shard_id, CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS mean_len FROM fts_docs GROUP BY shard_id),
    fts_post AS (SELECT shard_id, doc_id, len(terms) AS dl, unnest(terms) AS term FROM fts_docs),
    fts_q AS (SELECT query_id, autocomplete, {tokens_sql('text')} AS toks FROM {queries}),
    fts_tok AS (
        SELECT query_id, unnest(range(len(toks))) AS i, translate(unnest(toks), '{_FROM}', '{_TO}') AS tok,
               len(toks) AS n_tok, autocomplete FROM fts_q
    ),
    fts_tf AS (
        SELECT t.query_id, t.i, t.n_tok, p.shard_id, p.doc_id, p.dl, CAST(count(*) AS DOUBLE) AS tf
        FROM fts_tok t JOIN fts_post p ON p.term = t.tok{loose}
        GROUP BY ALL
    ),
    fts_df AS (SELECT query_id, i, shard_id, CAST(count(*) AS DOUBLE) AS df FROM fts_tf GROUP BY ALL),
    hits AS (
        SELECT f.query_id, f.shard_id, f.doc_id,
               sum(-(CASE WHEN ln((s.n - d.df + 0.5) / (d.df + 0.5)) > 0 THEN ln((s.n - d.df + 0.5) / (d.df + 0.5)) ELSE 1e-6 END)
                   * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.dl / s.mean_len))) AS bm25
        FROM fts_tf f JOIN fts_df d ON f.query_id = d.query_id AND f.i = d.i AND f.shard_id = d.shard_id JOIN fts_stats s ON f.shard_id = s.shard_id
        GROUP BY f.query_id, f.shard_id, f.doc_id, f.n_tok HAVING count(*) = f.n_tok
    )"""
