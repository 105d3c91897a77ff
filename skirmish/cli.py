"""Command line: ``python -m skirmish.cli rank --matches M --participants P``."""
from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from skirmish import __version__
from skirmish.plans.engines import POLICIES, rank_entities
from skirmish.sources.tables import read_table, write_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skirmish")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    rank = p.add_subparsers(dest="command", required=True).add_parser("rank", help="rank entities")
    for name in ("matches", "participants"):
        rank.add_argument(f"--{name}", required=True)
    for name in ("appearances", "output"):
        rank.add_argument(f"--{name}")
    rank.add_argument("--component-policy", choices=POLICIES, default="keep_largest")
    rank.add_argument("--now-ts", type=float)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = SparkSession.builder.appName("skirmish").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        tables = [read_table(spark, p) if p else None for p in (args.matches, args.participants, args.appearances)]
        out = rank_entities(*tables, now_ts=args.now_ts, component_policy=args.component_policy).orderBy("player_rank")
        if args.output:
            write_table(out, args.output)
        else:
            out.toPandas().to_csv(sys.stdout, index=False)
    except (ValueError, OSError, PySparkException) as e:
        print(f"skirmish: error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
