"""python -m docvet: the engine's plans from the command line. Exit codes: 0 clean, 1 findings, 2 wrong use, 3 failed scan."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

import docvet
from docvet.functions import fixed
from docvet.operators import reports
from docvet.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("docvet")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "sanitize", "trust", "policy"):
        one = commands.add_parser(name)
        one.add_argument("path")
        if name == "scan":
            one.add_argument("--format", choices=sorted(reports.REPORTERS), default="table")
            one.add_argument("--min-severity", choices=fixed.SEVERITIES, default="info")
            one.add_argument("--skip-detector", action="append", default=[])
            one.add_argument("--no-recursive", action="store_true")
            one.add_argument("--output")
        if name == "policy":
            one.add_argument("--audit")
    audit = commands.add_parser("audit")
    audit.add_argument("log")
    audit.add_argument("-n", type=int, default=50)
    approvals = commands.add_parser("approvals")
    approvals.add_argument("action", choices=("list", "approve", "reject"))
    approvals.add_argument("log")
    approvals.add_argument("id", nargs="?")
    approvals.add_argument("--by", default="")
    for name in ("list-detectors", "version"):
        commands.add_parser(name)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(docvet.__version__)
        return 0
    engine = Engine(spark or SparkSession.builder.getOrCreate())
    show = lambda df: [print(line) for line in df.toJSON().toLocalIterator()]
    if args.command == "scan":
        return scan(engine, args)
    if args.command == "sanitize":
        for r in engine.sanitized(args.path).toLocalIterator():
            print(r.text)
            print(f"{r.path}: removed {r.removed_count}, findings {r.evidence_count}", file=sys.stderr)
    elif args.command == "trust":
        show(engine.trust(args.path))
    elif args.command == "policy":
        show(engine.policy(args.path, args.audit))
    elif args.command == "audit":
        show(engine.audit_tail(args.log, args.n))
    elif args.command == "list-detectors":
        show(engine.detectors())
    elif args.action == "list":
        show(engine.approvals(args.log))
    elif not args.id:
        print("the id of a request is missing", file=sys.stderr)
        return 2
    else:
        status = {"approve": "approved", "reject": "rejected"}[args.action]
        return 0 if engine.decide(args.log, args.id, status, args.by) else 1
    return 0


def scan(engine: Engine, args: argparse.Namespace) -> int:
    from docvet.operators import detectors
    from docvet.sources import readers

    skip, recursive = tuple(args.skip_detector), not args.no_recursive
    if args.output:
        engine.write_reports(args.path, args.output, args.format, recursive, args.min_severity, skip)
    else:
        found = detectors.detect(readers.documents(engine.files(args.path, recursive)), ["path", "length"], skip)
        for r in reports.reporter(args.format)(engine.weaker_left_out(found, args.min_severity)).toLocalIterator():
            print(r[0])
    return engine.exit_code(args.path, recursive, args.min_severity, skip)


if __name__ == "__main__":
    sys.exit(main())
