"""Command line of the realignment; ``@file`` reads arguments from a file."""

from __future__ import annotations

import argparse

from .operators.align import GLOBAL, LOCAL, SEMI
from .plans.realign import Config, realign_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description="Realign reads near problem regions.", fromfile_prefix_chars="@")
    p.add_argument("inputs", nargs="+", help="SAM or BAM files")
    p.add_argument("--out", required=True)
    p.add_argument("--ref", required=True, help="FASTA file")
    p.add_argument("--cost", required=True, help="position-dependent costs")
    p.add_argument("--prob", help="problem regions (BED)")
    p.add_argument("--promiscuous", action="store_true", help="realign every record")
    p.add_argument("--overrun", type=int, default=20)
    p.add_argument("--maxexp", type=int, default=-1)
    mode = p.add_mutually_exclusive_group()
    for name, value in (("--atlocal", LOCAL), ("--atsemi", SEMI), ("--atglobal", GLOBAL)):
        mode.add_argument(name, dest="mode", action="store_const", const=value)
    p.add_argument("--rank", type=int, default=0)
    p.add_argument("--count", type=int, default=1)
    p.add_argument("--reclaimsoft", type=int, default=0)
    p.add_argument("--qualm")
    p.add_argument("--hfuzz", type=int, default=0)
    p.add_argument("--thread", type=int, default=1, help="ignored: Spark sets the parallelism")
    p.add_argument("--order", action="store_true")
    p.add_argument("--tagpt", action="append", default=[])
    p.add_argument("--single", action="store_true", help="write one file, through one task")
    return p


def config_of(args: argparse.Namespace) -> Config:
    if not args.prob and not args.promiscuous:
        raise SystemExit("--prob is needed unless --promiscuous is given")
    if args.thread < 1:
        raise SystemExit("--thread must be positive")
    return Config(args.overrun, args.maxexp, args.mode or SEMI, args.rank, args.count, args.reclaimsoft, args.hfuzz, args.promiscuous, args.order, args.tagpt).check()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = config_of(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    realign_files(spark, args.inputs, args.out, args.ref, args.cost, args.prob, args.qualm, config, args.single)


if __name__ == "__main__":
    main()
