"""Commands: convert, filter, verify."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from annalist.sources.convert import convert
from annalist.sources.subset import write_subset
from annalist.verify import verify_database


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="annalist")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert", help="write a dataset as a database")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("--num_threads", type=int, help="partitions of the database")
    one.add_argument("--lenient", action="store_true", help="join scattered subjects instead of failing")
    two = commands.add_parser("filter", help="write the database of some subjects")
    two.add_argument("source")
    two.add_argument("target")
    two.add_argument("ids", help="file of little-endian 64-bit integers")
    two.add_argument("--num_threads", type=int)
    three = commands.add_parser("verify", help="compare a database with its dataset")
    three.add_argument("dataset")
    three.add_argument("database")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("annalist").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "convert":
        convert(spark, given.source, given.target, given.num_threads, strict=not given.lenient)
    elif given.command == "filter":
        write_subset(spark, given.source, given.target, given.ids)
    elif faults := verify_database(spark, given.dataset, given.database):
        print("\n".join(faults), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
