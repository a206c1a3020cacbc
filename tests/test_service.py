"""Builds, catalogs, indexes that change, requests, and the entry without its optional parts."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from geoloom.__main__ import main
from geoloom.functions import params
from geoloom.operators import shards
from geoloom.operators.bm25 import TextIndex, search_text
from geoloom.plans import build
from geoloom.plans import search as forward
from geoloom.sources import catalog, readers
from geoloom.sources.scratch import scratch_path, table_from_bytes

ROOT = Path(__file__).resolve().parent.parent
PLACES = "gers_id string, name string, subtype string, country string, region string, population long, lat double, lon double, xmin double, ymin double, xmax double, ymax double, area double, search_text string"


@pytest.fixture
def gazette(spark):
    def row(key, subtype, country, region, population):
        return (key, key.title(), subtype, country, region, population, 1.0, 2.0, 1.5, 0.5, 2.5, 1.5, 1.0, f"{key} {country}".lower())

    rows = [row("alpha", "locality", "AA", "AA-1", 500_000), row("beta", "locality", "AA", "AA-2", 10), row("gamma", "county", "BB", None, None), row("delta", "region", "BB", "BB-1", 5), row("lost", "locality", None, None, 900_000)]
    return spark.createDataFrame(rows, PLACES)


def ids(df):
    return sorted((r.shard_id, r.gers_id) for r in df.collect())


def test_plan_options(gazette):
    size = F.lit(10)
    assert ids(build.plan_shards(gazette, size)) == [("AA", "alpha"), ("AA", "beta"), ("BB", "delta"), ("BB", "gamma"), ("HEAD", "alpha"), ("HEAD", "gamma"), ("HEAD", "lost")]
    assert ids(build.plan_shards(gazette, size, skip_head=True, countries=("BB",))) == [("BB", "delta"), ("BB", "gamma")]
    assert ids(build.plan_shards(gazette, size, head_only=True, reverse=True, threshold=600_000)) == [("HEAD", "delta"), ("HEAD", "gamma"), ("HEAD", "lost")]
    assert ids(build.plan_shards(gazette, size, skip_head=True, most=15, countries=("AA",))) == [("AA-1", "alpha"), ("AA-2", "beta")]
    assert build.plan_shards(gazette, size, head_only=True, skip_head=True).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        build.plan_shards(gazette, size, threshold=-1)


def test_build_and_command_line(spark, gazette, tmp_path, capsys):
    gazette.write.parquet(f"{tmp_path}/places")
    main(["build", f"{tmp_path}/places", f"{tmp_path}/out", "--version", "2025-01-01.0"])
    main(["build", f"{tmp_path}/places", f"{tmp_path}/out", "--version", "2025-02-01.0", "--countries", "aa, bb", "--head-threshold", "1"])
    main(["build", f"{tmp_path}/places", f"{tmp_path}/out", "--version", "2025-02-01.0", "--reverse"])
    main(["reverse", f"{tmp_path}/places", "1.0", "2.0"])
    main(["reverse", f"{tmp_path}/places", "80", "80"])
    main(["search", f"{tmp_path}/out/2025-02-01.0/index", f"{tmp_path}/out/2025-02-01.0/shards", "beta", "--json"])
    out = capsys.readouterr().out.strip().split("\n")
    assert out[:3] == ["2025-01-01.0", "2025-02-01.0", "2025-02-01.0"] and json.loads(out[3])["gers_id"] == "alpha" and out[4] == "no place"
    assert json.loads(out[5])["results"][0]["gers_id"] == "beta"
    links = catalog.read_catalog(spark, f"{tmp_path}/out/catalog.json")
    assert [r.version for r in catalog.all_versions(links).collect()] == ["2025-02-01.0", "2025-01-01.0"] and catalog.latest_version(links).first().version == "2025-02-01.0"
    for link in links.collect():
        assert (tmp_path / "out" / link.href).exists()
    assert {r.shard_id: r.record_count for r in catalog.read_collection(spark, f"{tmp_path}/out/2025-02-01.0/reverse-collection.json").collect()} == {"AA": 2, "BB": 2, "HEAD": 4}
    assert catalog.published_versions(spark, f"{tmp_path}/none.json") == []
    with pytest.raises(ValueError, match="country"):
        main(["build", f"{tmp_path}/places", f"{tmp_path}/out", "--countries", "A1"])


def test_index_maintenance(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "shard_id string, doc_id long, text string")
    q = spark.createDataFrame([(1, "red", False)], "query_id long, text string, autocomplete boolean")
    found = lambda index: sorted((r.shard_id, r.doc_id) for r in search_text(q, index).collect())
    index = TextIndex.build(docs(("A", 1, "red one"), ("A", 2, "blue"), ("B", 1, "red"), ("A", 3, None)), "text")
    assert found(index) == [("A", 1), ("B", 1)]
    assert found(index.without(docs(("A", 1, None), ("C", 9, None)))) == [("B", 1)]
    changed = index.updated(docs(("A", 1, "green"), ("A", 2, "red red"), ("C", 1, "red")), "text")
    assert found(changed) == [("A", 2), ("B", 1), ("C", 1)]
    assert {r.shard_id: (r.docs, r.mean_length) for r in changed.shards.collect()} == {"A": (3, 1.0), "B": (1, 1.0), "C": (1, 1.0)}
    changed.write(f"{tmp_path}/a")
    TextIndex.build(docs(("D", 1, "red")), "text").append(f"{tmp_path}/a")
    assert found(TextIndex.compact(spark, f"{tmp_path}/a", f"{tmp_path}/b")) == [("A", 2), ("B", 1), ("C", 1), ("D", 1)]
    assert found(index.updated(docs(), "text")) == found(index) and found(TextIndex.build(docs(), "text")) == []


def test_missing_shards(spark, gazette):
    assigned = build.plan_shards(gazette, F.lit(10))
    index = TextIndex.build(assigned.where("shard_id <> 'AA'"), "search_text", "gers_id", "shard_id")
    stats = shards.shard_stats(assigned, F.lit(10))
    q = spark.createDataFrame([(1, "beta", "AA"), (2, "gamma", "BB")], "query_id long, text string, bias_country string")
    assert [tuple(r) for r in forward.missing_shards(q, stats, index, assigned).collect()] == [(1, "AA")]
    assert [(r.query_id, r.gers_id) for r in forward.search_sharded(q, stats, index, assigned.drop("search_text")).collect()] == [(2, "gamma")]
    with pytest.raises(ValueError, match="HEAD"):
        forward.search_sharded(q, stats.where("shard_id <> 'HEAD'"), index, assigned)


def test_query_strings(spark):
    urls = ["https://h/s?q=a+b%26c&x&q=l%C3%A4st&=v&e=#f", "/s", "/s?%zz=%zz&a=b=c", None, "/s?&&"]
    got = [r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select(params.query_pairs(F.col("u")).alias("p")).collect()]
    assert [[tuple(x) for x in p or []] for p in got] == [[("q", "a b&c"), ("x", ""), ("q", "läst"), ("", "v"), ("e", "")], [], [("%zz", "%zz"), ("a", "b=c")], [], []]
    asked = spark.createDataFrame([("/s?q=x&lat=1&lon=y", "US", "5", "6"), ("/s?q=x&lat=1", "US", "5", "6"), ("/s", None, None, "bad")], "url string, header_country string, header_lat string, header_lon string")
    rows = params.search_request(asked).select("bias_lat", "bias_lon", "error").collect()
    assert [tuple(r) for r in rows] == [(1.0, None, None), (5.0, 6.0, None), (None, None, "missing query")]


def test_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t")
    part = next((tmp_path / "t").glob("*.parquet"))
    assert table_from_bytes(spark, part.read_bytes()).count() == 3
    import hashlib

    assert [r.sha256 for r in readers.file_digests(spark, str(part)).collect()] == [hashlib.sha256(part.read_bytes()).hexdigest()]
    assert readers.some_rows(spark.range(9)).count() == 5
    first = spark.read.parquet(f"{tmp_path}/t")
    assert first.count() == 3
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/t")
    readers.forget(spark, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7
    from types import SimpleNamespace

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn")), "x")


def test_session_of_the_public_store():
    from pyspark.sql import SparkSession

    options = readers.anonymous(SparkSession.Builder(), "4g", 4)._options
    assert options["spark.driver.memory"] == "4g" and options["spark.master"] == "local[4]" and options.items() >= readers.ANONYMOUS_STORE.items()


@pytest.mark.parametrize("missing", ["geoloom.llm", "corpus_pipeline", "xxhash"])
def test_entry_without_optional_parts(missing):
    script = f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, {str(ROOT)!r}); import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print('search_end_to_end' in names, 'pipeline' in names)"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", script], capture_output=True, text=True, check=True, timeout=120)
    assert done.stdout.split() == ["True", "False"]
