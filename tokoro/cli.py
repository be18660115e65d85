"""Command line: ``python -m tokoro.cli normalize|info|build``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokoro.config import Config
from tokoro.plans.build import build, build_from_catalog
from tokoro.plans.geocode import geocode
from tokoro.sources.fetch import _open
from tokoro.sources.model_http import URL_VARIABLE, configured
from tokoro.sources.sinks import human, info, json_lines
from tokoro.sources.store import Store


def lines(spark: SparkSession, texts: list[str], path: str | None):
    """(qid, query) of arguments or of a text file; blank lines are dropped."""
    if path:
        rows = spark.read.text(path).select(F.trim("value").alias("query"))
        return rows.where("query <> ''").select(F.monotonically_increasing_id().alias("qid"), "query")
    own = [t.strip() for t in texts if t.strip()]
    return spark.createDataFrame(list(enumerate(own)), "qid long, query string")


def main(argv: list[str] | None = None, opener=_open) -> int:
    parser = argparse.ArgumentParser(prog="tokoro")
    commands = parser.add_subparsers(dest="command", required=True)
    n = commands.add_parser("normalize")
    n.add_argument("query", nargs="*")
    n.add_argument("--input")
    n.add_argument("--output", help="folder for JSON lines; else they are printed")
    n.add_argument("--human", action="store_true")
    n.add_argument("--batch-size", type=int, default=64, help="questions in a request")
    n.add_argument("--concurrency", type=int, default=4, help="requests under way at once")
    n.add_argument("--model-url", help=f"a decision model; else ${URL_VARIABLE}")
    n.add_argument("--no-model", action="store_true", help="take what is certain, ask nothing")
    n.add_argument("--always-ask", action="store_true", help="put even what is certain to the model")
    b = commands.add_parser("build")
    b.add_argument("--level", choices=("machiaza", "rsdt", "parcel"), default="machiaza")
    b.add_argument("--pref", action="append", help="two-digit prefecture code; may be repeated")
    b.add_argument("--city", action="append", help="six-digit municipality code; may be repeated")
    b.add_argument("--cache", help="folder for downloads that executors see")
    b.add_argument("--concurrency", type=int, default=4, help="downloads at once")
    b.add_argument("--force", action="store_true", help="read unchanged files too")
    b.add_argument("--no-supplement", action="store_true")
    b.add_argument("--files", help="JSON: paths of zip files by kind, instead of the catalogue")
    b.add_argument("--supplement", help="with --files: the supplement's CSV")
    commands.add_parser("info")
    for p in commands.choices.values():
        p.add_argument("--data", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tokoro").getOrCreate()
    told = lambda phase, done, total, detail: print(f"[{phase}] {done}/{total} {detail}", file=sys.stderr)
    if args.command == "build":
        if args.files:
            report = build(spark, args.data, json.loads(args.files), args.level, args.supplement, force=args.force, progress=told)
        else:
            report = build_from_catalog(spark, args.data, args.level, args.pref, args.city, args.cache, args.concurrency, args.force, not args.no_supplement, opener, told)
        print(json.dumps(report, ensure_ascii=False))
    elif args.command == "info":
        print(info(Store(spark, args.data)))
    else:
        queries = lines(spark, args.query or ([] if args.input else sys.stdin.read().splitlines()), args.input)
        if queries.isEmpty():
            parser.error("no address given")
        cfg = Config(batch_size=args.batch_size, concurrency=args.concurrency, always_ask=args.always_ask)
        results = geocode(queries, Store(spark, args.data).index(), cfg, None if args.no_model else configured(args.model_url))
        shown = human(results) if args.human else json_lines(results)
        if args.output:
            shown.sort("qid").select("value").write.mode("overwrite").text(args.output)
        else:
            for row in shown.sort("qid").toLocalIterator():
                print(row["value"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
