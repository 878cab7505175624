"""Commands: run (survivors and metrics of a folder of images, kept by digest), metrics (a formatted report),
cache (what is missing, or a reset)."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from spanloom.functions.heuristics import ALL_FEATURES, ANALYSES, Options
from spanloom.functions.graph import INVARIANTS
from spanloom.functions.isa import ISAS
from spanloom.operators.metrics import run_summary, survivors
from spanloom.sources import images, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("path")
    run.add_argument("--cache", required=True)
    run.add_argument("--isa", choices=sorted(ISAS), default="t8")
    run.add_argument("--rounds", type=int, default=Options.rounds)
    run.add_argument("--tp-threshold", type=float, default=Options.tp_threshold)
    run.add_argument("--heuristics", default=",".join(Options.heuristics), help=f"of {', '.join(ALL_FEATURES)}; unknown names are passed over")
    run.add_argument("--invariants", default=",".join(INVARIANTS))
    run.add_argument("--analyses", default=next(iter(ANALYSES)))
    run.add_argument("--no-converge", action="store_true")
    run.add_argument("--no-protect", action="store_true")
    report = commands.add_parser("metrics")
    report.add_argument("--cache", required=True)
    report.add_argument("--format", required=True, help="a text with %%1, %%2 ... and the metrics they stand for, after commas")
    cache = commands.add_parser("cache")
    cache.add_argument("--cache", required=True)
    cache.add_argument("--reset", action="store_true")
    cache.add_argument("--verify", metavar="PATH", help="print how many images of a folder have no results")
    return top


def options_of(args: argparse.Namespace) -> Options:
    names = lambda text: tuple(x for x in text.split(",") if x)
    return Options(names(args.heuristics), names(args.invariants), names(args.analyses), args.rounds, args.tp_threshold, not args.no_converge, not args.no_protect, isa=args.isa)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    cache = sinks.Cache(spark, args.cache)
    if args.command == "run":
        began, options = time.time(), options_of(args)
        found = images.from_files(spark, args.path)
        digest = sinks.digests(found, options)
        cache.save("metrics", run_summary(found, options).join(digest, "image_id"))
        cache.save("survivors", survivors(found, options).join(digest, "image_id"))
        print(f"{int(time.time() - began)} s")
    elif args.command == "metrics":
        template, *names = args.format.split(",")
        for row in sinks.format_metrics(cache.load("metrics"), template, names).toLocalIterator():
            print(row.text)
    elif args.reset:
        for name in ("metrics", "survivors"):
            cache.reset(name)
    elif args.verify:
        print(cache.missing("metrics", sinks.digests(images.from_files(spark, args.verify), Options()).select("digest")).count())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
