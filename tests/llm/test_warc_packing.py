"""Archives by round trip, packing by its pieces, the registry against DuckDB, and the pipeline by brute force."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import packing, warc
from geoloom.llm.registry import ORACLES, QUERIES
from geoloom.llm.tokens import default_vocabulary, encoder
from tests.llm.plans import merge_joins

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    winner = {}
    for p, _, h in rows:
        if p is not None:
            winner[h or ""] = max(winner.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and (h or "") in winner and winner[h or ""] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", winner[h or ""] if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    nasty = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/ü x", "same"), (3, None, "same"), (4, "http://c\r\nWARC-Type: x", nasty), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50_000), (8, "u", nasty), (None, "u", "same"), (None, "u", "only"), (9, "u", "\r\n\r\n"), (10, "u", "twice"), (10, "u", "twice")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), least).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows, least)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_captures(spark, tmp_path):
    rows = [(1, "http://a/", "x\r\n\r\ny"), (2, "http://b/", "x\r\n\r\ny")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    got = {r.target_uri: r for r in warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()}
    assert bytes(got["http://b/"].response.payload) == b"x\r\n\r\ny" and got["http://b/"].response.digest_ok
    assert got["http://a/"].response.kind == "revisit" and got["http://a/"].response.refers_to_uri == "http://b/"
    assert got["http://a/"].metadata.fields["refers-to-page-id"] == "2" and got["http://a/"].request is not None


def test_archives_are_as_other_tools_expect(spark, tmp_path):
    """Each record a member of its own, real request lines, and revisits that name their response."""
    long = "é<p>" * 2_000_000
    rows = [(1, "http://a.org/x/y?z=1", "same"), (2, "https://u@b.org:8080", "same"), (3, None, long), (4, "http://c/", long), (5, "http://d/", "twice"), (5, "http://d/", "twice"), (6, "http://e/", "x")]
    clash = [(*r, "clash", "clash") for r in rows]
    warc.write_warc(spark.createDataFrame(clash, PAGES + ", sha string, best string").repartition(2), f"{tmp_path}/w", records_per_file=4)
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    assert len(files) >= 6
    members = 0
    for f in files:
        data = f.read_bytes()
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data) + member.flush()
            assert member.eof and (not record or record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Record-ID:") == 1)
            members += bool(record)
            data = member.unused_data
    assert members == 3 * len(rows)
    whole, split = (sorted(str(r) for r in f(spark, f"{tmp_path}/w").collect()) for f in (warc.read_warc, warc.read_members))
    assert whole == split and len(whole) == members
    records = warc.read_members(spark, f"{tmp_path}/w").collect()
    by_id = {r.record_id: r for r in records}
    assert len(by_id) == len(records)
    for r in records:
        if r.kind == "revisit":
            assert by_id[r.refers_to].target_uri == r.refers_to_uri and by_id[r.refers_to].payload_digest == r.payload_digest
    heads = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert b"GET /x/y?z=1 HTTP/1.1\r\nHost: a.org\r\n" in heads and b"GET / HTTP/1.1\r\nHost: b.org:8080\r\n" in heads and b"WARC-Refers-To-Date: 1970" in heads
    got = warc.round_trip(spark.createDataFrame(clash, PAGES + ", sha string, best string")).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_revisits_are_resolved_by_record_id(spark, monkeypatch):
    """Without the metadata's field the responses are found all the same."""
    real = warc._record

    def without(kind, record_id, date, uri, content_type, block, **more):
        return real(kind, record_id, date, uri, content_type, b"".join(x for x in block.splitlines(keepends=True) if not x.startswith(b"refers-to")) if kind == "metadata" else block, **more)

    monkeypatch.setattr(warc, "_record", without)
    rows = [(i, f"http://h/{i}", f"body {i % 3}") for i in range(20)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_hot_payloads_can_be_split(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i, f"http://h/{i}", f"body {i % 3}") for i in range(20)], PAGES)
        assert merge_joins(warc.round_trip(rows)) == [(True, True)]
        assert merge_joins(warc.records_of(rows)) == [(True, True)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reads_members_and_plain_files(spark, tmp_path):
    records = [warc._record("response", f"<urn:uuid:{i}>", "2025-01-01T00:00:00Z", "http://x/", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * (i * 700_000)) + b"\r\n\r\n" for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == sorted([(f"<urn:uuid:{i}>", i * 700_000) for i in range(4)] * 2)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse(iter([b"".join(records)[:-3000]])))


# --- packing ---


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=40))
def test_plan_places_every_remainder_once(histogram):
    window = 64
    plan = packing.make_plan(histogram, window)
    used = {}
    for r, lo, hi, seq, off in plan.slots:
        for k in range(lo, hi):
            used.setdefault((r, k), []).append((seq + k - lo, off, r))
    for r, lo, hi, base in plan.stream:
        for k in range(lo, hi):
            at, end = base + (k - lo) * r, base + (k - lo + 1) * r
            while at < end:
                seq, begin, stop = plan.segment(at)
                used.setdefault((r, k), []).append((seq, at - begin, min(stop, end) - at))
                at = min(stop, end)
    assert set(used) == {(r, k) for r, n in histogram.items() for k in range(n)}
    fill = {}
    for (r, _), parts in used.items():
        assert sum(n for *_, n in parts) == r
        for seq, off, n in parts:
            fill.setdefault(seq, []).append((off, n))
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == window or at & (at - 1) == 0


def test_least_squares():
    target = {10: 100, 54: 100, 20: 30, 44: 10, 24: 20, 30: 5}
    columns = packing.combinations(list(target), 64)
    x = packing.nnls(columns, target, sweeps=5000, tolerance=1e-9)
    assert min(x) >= 0
    used = Counter()
    for c, n in zip(columns, x, strict=True):
        for a in c:
            used[a] += n
    residual = np.array([target[a] - used[a] for a in target])
    for c, n in zip(columns, x, strict=True):  # the optimum's conditions
        g = sum(residual[list(target).index(a)] for a in c)
        assert g < 1e-3 and (n == 0 or abs(g) < 1e-3)


@pytest.mark.parametrize("scale", [1, 1000])
def test_least_squares_of_a_whole_window(scale):
    """At the query's window and tolerance the solution meets an optimum's conditions."""
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(np.clip(rng.gamma(1.3, 250, 6000).astype(int), 1, 1023), return_counts=True)
    target = {int(a): int(c) * scale for a, c in zip(lengths, counts, strict=True)}
    columns = packing.combinations(list(target), 1024)
    x = packing.nnls(columns, target)
    left = dict(target)
    for c, n in zip(columns, x, strict=True):
        for a in c:
            left[a] -= n
    assert min(x) >= 0 and len(columns) > 20_000
    assert all(sum(left[a] for a in c) <= 0.26 and (n == 0 or sum(left[a] for a in c) >= -0.26) for c, n in zip(columns, x, strict=True))
    plan = packing.make_plan(target, 1024)
    placed = sum(hi - lo for _, lo, hi, _, _ in plan.slots)
    assert placed >= 0.8 * sum(target.values())


def check_pieces(pieces, texts, window):
    ids = {d: np.append(encoder(default_vocabulary())(t or ""), 0).astype("<u4") for d, t in texts}
    by_doc, by_seq = {}, {}
    for p in pieces:
        x = ids[p.doc_id]
        assert p.doc_tokens == len(x) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[d])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        padding += 0 if at & (at - 1) == 0 else window - at
        assert at <= window
    return padding


@pytest.mark.parametrize("with_ids", [False, True])
def test_pack(docs_of, with_ids):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["alpha", "Beta", "ünder", "x1"]) for _ in range(rng.choice([0, 1, 7, 60, 300])))) for i in range(150)]
    texts += [(500 + i, "the same text " * 9) for i in range(80)] + [(900, None), (901, ""), (902, "a <|endoftext|> b"), (903, "long " * 20_000)]
    pieces = packing.pack(docs_of(texts), window=128, with_ids=with_ids).collect()
    assert check_pieces(pieces, texts, 128) == 0
    if with_ids:
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)


def test_pack_edges(docs_of):
    assert packing.pack(docs_of([])).count() == 0
    got = packing.pack(docs_of([(None, None), (None, "x"), (1, "x"), (1, "x")])).collect()
    assert len(got) >= 4 and sum(p.length for p in got) == 7


# --- registry and pipeline ---

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(str(tuple(None if pd.isna(x) else x for x in r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, data), con.sql(ORACLES[name])
    assert {c: KINDS[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    got, sql = df.toPandas(), want.df()
    for c, t in df.dtypes:
        if t == "bigint":
            got[c], sql[c] = got[c].astype("Int64"), sql[c].astype("Int64")
    assert rows_of(got) == rows_of(sql)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import components_brute, line_brute

    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am") for b in ("em", "um", "or", "et", "is", "ad")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    docs = [(i, "\n".join(say(rng.randint(5, 30)) for _ in range(3)) + "\nA common footer line", "xx") for i in range(60)]
    docs += [(100 + i, docs[i][1].split("\n")[0] + "\n" + say(40), "xx") for i in range(5)]
    docs += [(200 + i, f"{say(15)} {items[i][1]} {say(15)}", "xx") for i in range(5)]
    docs += [(300, None, None), (301, "12 34 ..", None), (302, "", "xx"), (303, docs[7][1].replace("\n", " "), "xx"), (304, docs[7][1].replace("\n", " ") + " ", "xx")]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, stages = [(i, t) for i, t, _ in docs], []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{n}")
        df = spark.read.parquet(f"{tmp_path}/{n}")
        stages.append(df.collect())
        if n < 4:
            assert df.columns == list(corpus_pipeline.COLUMNS)
    now = [(i, t) for i, t in now if t and any(c.isalpha() for c in t)]
    assert sorted((r.doc_id, r.text) for r in stages[0]) == sorted(now)
    lines = line_brute(now)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in stages[1]} == {i: x[2] for i, x in lines.items()}
    assert all(r.n_chars == len(r.text) for r in stages[1])
    now = [(r.doc_id, r.text) for r in stages[1]]
    first = {c for _, c in components_brute(now).values()}
    assert {r.doc_id for r in stages[2]} == first and len(stages[2]) == len(first)
    leaked = {200 + i for i in range(5)}
    assert {r.doc_id for r in stages[3]} == first - leaked and leaked <= first
    assert check_pieces(stages[4], [(r.doc_id, r.text) for r in stages[3]], 1024) == 0
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in again) == sum(r.length for r in stages[4]) and {r[0] for r in key(again)} == {r[0] for r in key(stages[4])}


def test_registered_packing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert check_pieces(QUERIES["op1_packing"](spark, data).collect(), [(r.doc_id, r.text) for r in docs], 1024) == 0


def test_registered_decontamination(spark, data):
    """Against the alignment of every document with every item, for a third of the items' longest runs."""
    from geoloom.llm import decontaminate as dec
    from geoloom.llm.textkit import letter_bounds, word_hashes
    from geoloom.llm.toxicity import lowered

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    hashed = lambda t: word_hashes(*letter_bounds([lowered(t.encode())])[:3])
    texts, targets = {k: hashed(t) for k, t in docs.items()}, {k: hashed(t) for k, t in items.items()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, data).collect()}
    want = set()
    for d, w in texts.items():
        for i, x in targets.items():
            if np.isin(x, w).sum() >= 0.5 * len(x) and dec.align(x, w)[0] >= 0.5:  # fewer words in common cannot score one half
                want.add((d, i))
    assert got == want


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, null and repeated ids, null columns, very long texts, and columns beyond those of documents."""
    import corpus_pipeline

    cols = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, __text string"
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "a"), (2, None, None), (2, "the", "b")], "item_id long, text string, start string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], cols).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(n))
    rows = [(i, say(40), "xx" if i % 2 else None, None, None, "a", "b", "c") for i in range(12)]
    rows += [(None, say(50), None, None, None, None, None, None), (7, say(60), "xx", None, None, None, None, None), (90, say(60_000), "xx", "s", 1, "a", "b", "c"), (91, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, cols).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {*range(12), 90, None}
    fill = {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sum(n for _, n in parts) == max(a + n for a, n in parts) for parts in fill.values())
