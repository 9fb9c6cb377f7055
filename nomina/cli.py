"""scan, report, all and clear from the command line (spark-submit -m nomina.cli, or python -m nomina.cli)."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from nomina import vocab
from nomina.operators import spans
from nomina.operators.report import write_report
from nomina.plans.scan import scan
from nomina.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nomina")
    sub = p.add_subparsers(dest="command", required=True)
    scan, report, both, clear = (sub.add_parser(c) for c in ("scan", "report", "all", "clear"))
    for s in (scan, report, both, clear):
        s.add_argument("--cache", default=".nomina_hits")
    for s in (scan, both):
        s.add_argument("pages", help="folder of text files, form feeds between pages")
        s.add_argument("--gazetteer", action="append", default=[])
        s.add_argument("--gazetteer-ambiguous", action="append", default=[])
        s.add_argument("--denylist", action="append", default=[])
        s.add_argument("--gazetteer-score", type=float, default=vocab.DICTIONARY_SCORE)
        s.add_argument("--entities", default="PERSON", help="comma-separated labels of spans that count as names")
        s.add_argument("--cells", help="Parquet of table cells (file, page_num, table_id, r, c, cell)")
        s.add_argument("--chunk-size", type=int, default=files.CHUNK_SIZE, help="pages that are done, or done again, together")
        s.add_argument("--force", action="store_true", help="remove what was found before and scan everything")
        s.add_argument("--as-of", type=int, default=datetime.now(timezone.utc).year)
    for s in (report, both):
        s.add_argument("--out", default="names")
        s.add_argument("--certain", type=float, default=vocab.CERTAIN)
        s.add_argument("--light", type=float, default=vocab.LIGHT)
        s.add_argument("--fuzzy", type=float, default=vocab.FUZZY)
        s.add_argument("--no-fuzzy", action="store_true")
        s.add_argument("--include-suppressed", action="store_true")
    clear.add_argument("--yes", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("nomina").getOrCreate()
    if args.command in ("scan", "all"):
        load = lambda label, paths: files.load_dictionary(spark, *paths, cache=f"{args.cache}.dictionaries", label=label) if paths else None
        names, common, denied = (load(*x) for x in (("names", args.gazetteer), ("ambiguous", args.gazetteer_ambiguous), ("denylist", args.denylist)))
        if names is None and not spans.SOURCES:
            raise SystemExit("no span source: give --gazetteer")
        cells = spark.read.parquet(args.cells) if args.cells else None
        entities = [e.strip() for e in args.entities.split(",") if e.strip()]
        told = scan(files.text_pages(spark, args.pages), names, args.as_of, args.cache, cells, args.chunk_size, args.force, ambiguous=common, denylist=denied, entities=entities, score=args.gazetteer_score)
        print(f"{told['hits']} hits, {told['suppressed']} of them held back", file=sys.stderr)
    if args.command in ("report", "all"):
        pages = files.read_pages(spark, args.cache)
        if pages is None:
            raise SystemExit(f"nothing was scanned into {args.cache}")
        write_report(files.read_hits(spark, args.cache), args.out, pages, include_suppressed=args.include_suppressed, certain=args.certain, light=args.light, fuzzy=None if args.no_fuzzy else args.fuzzy)
    if args.command == "clear" and (args.yes or input(f"Remove {args.cache}? [y/N] ").lower() == "y"):
        print("removed" if files.clear(spark, args.cache) else "nothing of this engine there")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
