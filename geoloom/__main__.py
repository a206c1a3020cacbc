"""Command line: ``python -m geoloom search INDEX PLACES TEXT``, ``reverse PLACES LAT LON``, ``count PLACES``, ``build PLACES ROOT``."""

from __future__ import annotations

import argparse


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="geoloom", description="Search places.")
    commands = parser.add_subparsers(dest="command", required=True)
    count = commands.add_parser("count", help="number of places in a table")
    count.add_argument("places")
    find = commands.add_parser("search", help="search a written index")
    find.add_argument("index")
    find.add_argument("places")
    find.add_argument("text")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--no-autocomplete", action="store_true")
    find.add_argument("--country")
    find.add_argument("--json", action="store_true")
    around = commands.add_parser("reverse", help="the smallest place around a point, and those around that")
    around.add_argument("places")
    around.add_argument("lat", type=float)
    around.add_argument("lon", type=float)
    make = commands.add_parser("build", help="write a version of the shards, with index and catalog")
    make.add_argument("places")
    make.add_argument("root")
    make.add_argument("--version")
    make.add_argument("--head-threshold", type=int)
    make.add_argument("--countries", help="codes separated by commas")
    make.add_argument("--head-only", action="store_true")
    make.add_argument("--skip-head", action="store_true")
    make.add_argument("--reverse", action="store_true")
    return parser


def _search(spark, args) -> list[str]:
    from pyspark.sql import functions as F

    from geoloom.operators.bm25 import TextIndex
    from geoloom.plans.search import search
    from geoloom.sources.output import json_responses, text_lines

    query = spark.createDataFrame([(1, args.text, args.limit, not args.no_autocomplete, args.country)], "query_id long, text string, limit int, autocomplete boolean, bias_country string")
    found = search(query, TextIndex.read(spark, args.index), spark.read.parquet(args.places).drop("search_text")).orderBy("rank").withColumnRenamed("subtype", "type")
    rows = json_responses(found).select(F.col("body").alias("line")) if args.json else text_lines(found)
    return [r["line"] for r in rows.collect()]  # at most 40 lines


def _reverse(spark, args) -> list[str]:
    from pyspark.sql import functions as F

    from geoloom.operators.reverse import reverse

    point = spark.createDataFrame([(1, args.lat, args.lon)], "point_id long, p_lat double, p_lon double")
    item = F.to_json(F.struct("gers_id", "name", "subtype", "distance_km", "confidence", "hierarchy"))
    return [r["line"] for r in reverse(point, spark.read.parquet(args.places)).select(item.alias("line")).collect()] or ["no place"]


def _build(spark, args) -> list[str]:
    from geoloom.functions.params import checked_country
    from geoloom.operators.shards import HEAD_POPULATION, row_bytes
    from geoloom.plans.build import build

    places = spark.read.parquet(args.places)
    countries = None if args.countries is None else tuple(checked_country(c.strip().upper()) for c in args.countries.split(","))
    threshold = HEAD_POPULATION if args.head_threshold is None else args.head_threshold
    return [build(places, args.root, row_bytes(*places.columns), args.version, args.reverse, threshold=threshold, countries=countries, head_only=args.head_only, skip_head=args.skip_head)]


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("geoloom").getOrCreate()
    if args.command == "count":
        print(spark.read.parquet(args.places).count())
        return
    for line in {"search": _search, "reverse": _reverse, "build": _build}[args.command](spark, args):
        print(line)


if __name__ == "__main__":
    main()
