"""Command line: check a configuration, or evaluate, list, export and convert a history."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check", help="parse a configuration and print it in canonical form, or its errors")
    c.add_argument("file")
    c.add_argument("-r", "--recursive", action="store_true", help="check its imports too")
    c.add_argument("-q", "--quiet", action="store_true", help="print errors only")
    v = sub.add_parser("validate", help="parse an expression")
    v.add_argument("expression")
    e = sub.add_parser("eval", help="evaluate expressions over a history, one JSON object a scrape")
    e.add_argument("history")
    e.add_argument("expression", nargs="+", help="name=expression")
    e.add_argument("--begin", type=datetime.fromisoformat)
    e.add_argument("--end", type=datetime.fromisoformat)
    e.add_argument("--step", default="", help="a duration such as 5m")
    e.add_argument("--numeric", action="store_true")
    for name, text in (("list", "the newest scrape as text"), ("export", "all scrapes as JSON")):
        sub.add_parser(name, help=text).add_argument("history")
    k = sub.add_parser("convert", help="copy a history")
    k.add_argument("source")
    k.add_argument("target")
    k.add_argument("--compression", default="zstd")
    a = p.parse_args(args)
    if a.command == "check":
        from .plans.config import check

        reports = check(a.file, a.recursive)
        for r in reports:
            for x in r.errors:
                print(f"{r.file}: {x}", file=sys.stderr)
            if r.ok and not a.quiet:
                print(r.canonical)
        return int(not all(r.ok for r in reports))
    if a.command == "validate":
        from .plans.evaluate import validate

        found = validate(a.expression)
        print(found.normalized_query if found.ok else "\n".join(found.parse_errors))
        return int(not found.ok)
    if a.command == "eval" and a.end and not a.begin:
        p.error("--end needs --begin")
    return _with_history(a)


def _with_history(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .plans import evaluate
    from .plans.parser import Parser
    from .sinks import lines
    from .sources.history import History, convert

    spark = SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "convert":
        convert(History(spark, a.source), History(spark, a.target, a.compression))
        return 0
    history = History(spark, a.history)
    if a.command == "eval":
        exprs = dict(x.split("=", 1) for x in a.expression)
        step = Parser(a.step).duration() if a.step else 0
        found = evaluate.as_json(evaluate.evaluate(history.scan(), exprs, a.begin, a.end, step), list(exprs), a.numeric).select("json")
    else:
        found = lines.listing(history.scan().points) if a.command == "list" else lines.json_scrapes(history.scan().points).orderBy("ts").select("json")
    for r in found.toLocalIterator():
        print(r[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
