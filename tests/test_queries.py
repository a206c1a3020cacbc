"""Every registered query that has SQL against DuckDB, and the rest for their rows."""

import duckdb
import pytest

import geoloom.plans.service  # noqa: F401  registers its queries
from geoloom.plans.registry import ORACLES, QUERIES

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="session")
def duck(data):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(str(tuple(None if x is None or x != x else float(x) if isinstance(x, float) else x for x in r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = df.toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(ORACLES[name])
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    assert rows(got) == rows(want.df())


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_json_results_tells_the_region_key_from_the_region_type(spark, monkeypatch):
    from geoloom.plans import registry

    cols = "query_id long, rank long, gers_id string, name string, subtype string, lat double, lon double, xmin double, ymin double, xmax double, ymax double, importance double, country string, region string"
    kinds = [(1, "region", None), (2, "region", "C1-R1"), (3, '"region":', None), (4, "county", None)]
    found = spark.createDataFrame([(7, n, f"p{n}", "x", kind, 1.0, 2.0, 0.0, 0.0, 3.0, 3.0, 0.5, "C1", region) for n, kind, region in kinds], cols)
    monkeypatch.setattr(registry, "_searched", lambda *_: found)
    assert [tuple(r) for r in QUERIES["json_results"](spark, "").collect()] == [(7, 4, "p1", 1.0, 0.0, 2)]
