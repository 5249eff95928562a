"""Command line: ``python -m simloom.cli [PATH ...]``. Exit code 1 on findings or errors."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from simloom.config import COLORS, FILE_NAME, FORMATS, checked_threshold, load_settings, write_template
from simloom.errors import SimloomError
from simloom.operators.synonyms import cached_edges, load_dictionary
from simloom.plans.report import VERSION, write_report
from simloom.plans.scan import scan, similar_within_files
from simloom.sources.extract import extract_blocks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("simloom", description="Finds near-duplicate blocks across source files.")
    p.add_argument("paths", nargs="*", metavar="PATH")
    p.add_argument("-c", "--config")
    p.add_argument("-t", "--threshold", type=float, metavar="PERCENT")
    p.add_argument("-L", "--min-lines", type=int, dest="min_block_tokens", help="least number of tokens of a block")
    p.add_argument("-o", "--output-format", choices=FORMATS)
    p.add_argument("-j", "--jobs", type=int)
    p.add_argument("-f", "-F", "--frequency-penalty", type=float)
    p.add_argument("--fuzzy-identifiers", action="store_true", default=None)
    p.add_argument("--fuzzy-threshold", type=float, dest="fuzzy_identifier_threshold")
    p.add_argument("--dictionary", help="synonyms for fuzzy identifiers: lines word|syn1,syn2")
    p.add_argument("--dictionary-cache", help="folder for the prepared dictionary, made anew once that is younger")
    p.add_argument("--no-intra-file", action="store_false", default=None, dest="check_intra_file")
    p.add_argument("--intra-file", action="store_true", default=None, dest="intra_file_extension", help="look for duplicates within one file too")
    p.add_argument("--color", choices=COLORS)
    p.add_argument("-q", "--quiet", action="store_true", default=None)
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--generate-config", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.pop("verbose"))], stream=sys.stderr)
    dictionary, cache, config = args.pop("dictionary"), args.pop("dictionary_cache"), args.pop("config")
    try:
        if args.pop("generate_config"):
            write_template()
            print(f"wrote {FILE_NAME}")
            return 0
        if args["threshold"] is not None:
            args["threshold"] = checked_threshold(args["threshold"] / 100)
        args["paths"] = args["paths"] or None
        settings = load_settings(args, config)
        spark = SparkSession.builder.master(f"local[{settings.jobs or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        edges = None
        if dictionary:
            edges = cached_edges(spark, dictionary, cache) if cache else load_dictionary(spark, dictionary)
        pairs, sources = scan(spark, settings, edges)
        inner = settings.check_intra_file and settings.intra_file_extension
        intra = similar_within_files(extract_blocks(sources, settings.min_block_tokens), settings) if inner else None
        return int(write_report(pairs, sources, settings, intra=intra) > 0)
    except SimloomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
