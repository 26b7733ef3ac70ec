"""Command line: ``python -m lodestar`` or ``spark-submit``.

    import  SOURCE INDEX          load a point file and build its index
    publish INDEX KEY=VALUE...    send the stored points to a topic (Kafka options, or path=FOLDER)
    range   INDEX X Y R           points within R of (X, Y)
    knn     INDEX X Y K           the K nearest points
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestar.constants import PREVIEW_ROWS
from lodestar.functions.geometry import Location
from lodestar.plans.index import load_index
from lodestar.plans.jobs import import_points, publish_index, write_neighbours


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(
        prog="lodestar", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    commands = parser.add_subparsers(dest="command", required=True)

    load = commands.add_parser("import")
    load.add_argument("source")
    load.add_argument("index")
    load.add_argument("--x-pos", type=int)
    load.add_argument("--y-pos", type=int)
    load.add_argument("--file-order", action="store_true", help="choose pivots in the order of the lines")
    load.add_argument("--partitions", type=int, help="number of files; follows from the number of points otherwise")
    load.add_argument("--quarantine", help="store unreadable lines here instead of stopping at the first one")

    publish = commands.add_parser("publish")
    publish.add_argument("index")
    publish.add_argument("options", nargs="+", metavar="KEY=VALUE")

    for name, last, kind in (("range", "r", float), ("knn", "k", int)):
        search = commands.add_parser(name)
        search.add_argument("index")
        search.add_argument("x", type=float)
        search.add_argument("y", type=float)
        search.add_argument(last, type=kind)
        search.add_argument("--out", help="write Parquet here instead of showing the first rows")
    return parser


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "import":
        options = {"x_pos": args.x_pos, "y_pos": args.y_pos, "quarantine": args.quarantine}
        options = {k: v for k, v in options.items() if v is not None}
        import_points(spark, args.source, args.index, args.file_order, args.partitions, **options)
    elif args.command == "publish":
        publish_index(load_index(spark, args.index), dict(option.split("=", 1) for option in args.options))
    else:
        index, q = load_index(spark, args.index), Location(args.x, args.y)
        found = index.range_query(q, args.r) if args.command == "range" else index.knn(q, args.k)
        write_neighbours(found, args.out, PREVIEW_ROWS)


if __name__ == "__main__":
    run(SparkSession.builder.appName("lodestar").getOrCreate(), arguments().parse_args())
