"""python -m pagequarry.cli import|search|discover ...: the library's functions from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.deploy import ship
from pagequarry.operators import runs as R
from pagequarry.operators import upsert as W
from pagequarry.operators.filters import listed
from pagequarry.operators.imports import import_file, organisations_at, searchable_organisations
from pagequarry.operators.profiles import run_discovery
from pagequarry.operators.run_store import RunStore
from pagequarry.schemas import SEARCH_METHODS
from pagequarry.sources.files import newest_source, raw_rows_remote


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("import", help="clean an export and upsert it into the organisations of a folder")
    i.add_argument("--source")
    i.add_argument("--auto", metavar="FOLDER", help="take the newest file of a folder")
    i.add_argument("--out", required=True)
    s = sub.add_parser("search", help="search stored pages for a phrase")
    s.add_argument("text")
    s.add_argument("--districts", required=True)
    s.add_argument("--pages", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--crawl", action="store_true", help="only pages that links from the website lead to")
    s.add_argument("--crawl-depth", type=int, metavar="N", help="as --crawl, at most N links away")
    s.add_argument("--method", choices=SEARCH_METHODS, default="crawler")
    s.add_argument("--answers", help="API answers: id, json")
    s.add_argument("--profiles", help="profiles of the sites' own search, as discover writes them")
    s.add_argument("--events", metavar="PATH", help="append the run's log there")
    d = sub.add_parser("discover", help="find each site's own search among stored pages")
    d.add_argument("--districts", required=True)
    d.add_argument("--pages", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--query", default="calendar")
    d.add_argument("--history", metavar="PATH", help="append the tests that are made there")
    d.add_argument("--known", metavar="PATH", help="profiles so far; sites with a working one are left out")
    d.add_argument("--force", action="store_true")
    d.add_argument("--district-id", type=int, help="this organisation only")
    for x in (s, d):
        x.add_argument("--state", action="append", default=[])
        x.add_argument("--agency-type", action="append", default=[])
        x.add_argument("--min-enrollment", type=int)
        x.add_argument("--max-enrollment", type=int)
        x.add_argument("--limit", type=int, default=25)
    s.add_argument("--batch", type=int, metavar="N", help="store and count the hits of N organisations at a time")
    s.add_argument("--runs", metavar="PATH", help="keep the run there, with its counters; it can be cancelled and goes on where it stopped")
    c = sub.add_parser("cancel", help="cancel a stored run")
    c.add_argument("run", type=int)
    c.add_argument("--runs", metavar="PATH", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args.command == "cancel":
        print(f"run {args.run}: {RunStore(spark, args.runs).cancel(args.run).status}")
        return 0
    if args.command == "import":
        source = args.source or newest_source(spark, args.auto)
        raw = raw_rows_remote(spark, source)
        done = import_file(spark, raw, args.out)
        told = W.import_summary(W.organisations(raw)).first().asDict()
        for name, value in {**told, "inserted": done.inserted, "updated": done.updated, "version": done.version}.items():
            print(f"{name}: {value}")
        return 0
    wanted = {"states": args.state, "agency_types": args.agency_type, "min_enrollment": args.min_enrollment, "max_enrollment": args.max_enrollment}
    districts, pages = _organisations(spark, args.districts), spark.read.parquet(args.pages)
    if args.command == "discover":
        known = spark.read.parquet(args.known) if args.known else None
        some = districts.where(F.col("id") == args.district_id) if args.district_id is not None else listed(districts, max(1, args.limit), **wanted)
        if some.isEmpty():
            print("No organisation matches.")
            return 1
        counts = run_discovery(some, pages, args.out, args.history, query=args.query, known=known, force=args.force)
        for name, value in counts.items():
            print(f"{name}: {value}")
        return 0
    tables = {name: spark.read.parquet(path) if path else None for name, path in (("answers", args.answers), ("profiles", args.profiles))}
    sources = R.Sources(**tables, crawl_depth=args.crawl_depth, crawl=args.crawl)
    made = {"max_districts": args.limit, "method": args.method, **wanted}
    if args.runs:
        store = RunStore(spark, args.runs)
        run = store.add(R.create(districts, store.next_id(), args.text, **made))
        print(f"run {run.id}")
        run = store.execute(run.id, districts, pages, args.out, batch=args.batch, sources=sources, events=args.events)
        found = R.results_at(spark, args.out).where(F.col("search_run_id") == run.id)
    else:
        run, found = R.run_search(spark, districts, pages, args.text, args.out, sources=sources, events=args.events, batch=args.batch, **made)
    print(f"{run.status}: {found.count()} results, {run.districts_searched} searched, {run.districts_failed} failed")
    return 0 if run.status == "completed" else 1


def _organisations(spark: SparkSession, path: str) -> DataFrame:
    """Organisations as import keeps them, or a plain table of them."""
    store = organisations_at(spark, path)
    return searchable_organisations(store.read()) if store.version() else spark.read.parquet(path)


if __name__ == "__main__":
    raise SystemExit(main())
