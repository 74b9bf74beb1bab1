"""Command line: run a catalog query, an MQL text over a points table, or show a plan."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalog, mql


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m chartlake.cli")
    parser.add_argument("--master", default="local[*]")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the catalog's queries")
    one = sub.add_parser("query", help="run a catalog query over a folder of tables")
    one.add_argument("name"), one.add_argument("folder")
    for name, text in (("mql", "run a query text"), ("explain", "steps and plan of a query text")):
        p = sub.add_parser(name, help=text)
        p.add_argument("text"), p.add_argument("points", help="Parquet with vec_id and vector")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(catalog.QUERIES))
        return
    spark = SparkSession.builder.master(given.master).getOrCreate()
    if given.command == "query":
        catalog.QUERIES[given.name](spark, given.folder).show(50, truncate=80)
        return
    engine = mql.Engine(spark, {"points": spark.read.parquet(given.points)})
    if given.command == "mql":
        engine.sql(given.text).show(50, truncate=80)
    else:
        print(engine.explain(mql.parse(given.text)))


if __name__ == "__main__":
    main()
