"""Command line: dumps listed, indexed, counted and sampled, and text extracted from them.

``python -m factloom.cli COMMAND FOLDER ...`` with list, index, stats, categories, dataset or extract; ``--help`` tells the options.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import curid_url
from factloom.operators import corpus, sampling
from factloom.plans import articles
from factloom.sources import dumps, stores


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="factloom", description=__doc__)
    commands = whole.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        one.add_argument("folder", help="folder of dumps <lang>wiki-<date>-pages-articles.xml[.bz2]")
        one.add_argument("-l", "--language", action="append", help="a language; may be repeated, all without it")
        return one

    command("list", "dumps by language and date")
    command("index", "write pages by language, sorted by title").add_argument("output")
    command("stats", "pages and categories of each language")
    command("categories", "categories by size").add_argument("--all", action="store_true", help="links without a pipe count too")
    dataset = command("dataset", "a random sample of pages of each language, as text")
    dataset.add_argument("output")
    dataset.add_argument("-n", "--number", type=int, default=100, help="pages of each language")
    dataset.add_argument("--minlen", type=int, default=0, help="least length in bytes")
    dataset.add_argument("--clean", action="store_true", help="remove markup before the length is taken")
    dataset.add_argument("--seed", type=int, default=0)
    extract = command("extract", "articles as documents of plain text")
    extract.add_argument("output")
    extract.add_argument("--options", help="an INI file with a section [extract]; options given here prevail")
    extract.add_argument("-c", "--compress", action="store_true", default=None)
    extract.add_argument("-b", "--records", type=int, help="documents in a file at most")
    extract.add_argument("-k", "--links", action="store_true", default=None, help="keep links")
    extract.add_argument("-s", "--sections", action="store_true", default=None, help="keep headers and list items")
    extract.add_argument("-n", "--namespaces", help="accepted namespaces, with commas between them")
    extract.add_argument("-p", "--prefix", help="beginning of the documents' addresses")
    return whole


def options_of(args: argparse.Namespace) -> dumps.ExtractOptions:
    given = {"keep_links": args.links, "keep_sections": args.sections, "records_per_file": args.records, "prefix": args.prefix, "compression": "bzip2" if args.compress else None, "namespaces": args.namespaces and tuple(args.namespaces.split(","))}
    return dumps.read_options(args.options, {k: v for k, v in given.items() if v is not None})


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    found = dumps.find_dumps(spark, args.folder, args.language)
    pages = dumps.read_dumps(spark, args.folder, args.language)
    if args.command == "list":
        for row in found.orderBy("lang", "date").toLocalIterator():
            print(f"{row['lang']:<20}{row['path']}")
    elif args.command == "index":
        dumps.build_index(pages, args.output)
    elif args.command == "stats":
        print("lang\tpages\tcategories")
        for row in corpus.dump_statistics(pages).toLocalIterator():
            print(f"{row['lang']}\t{row['pages']}\t{row['categories']}")
    elif args.command == "categories":
        for row in corpus.category_sizes(pages, args.all).toLocalIterator():
            print(f"{row['n']:<4} {row['category']}")
    elif args.command == "dataset":
        stores.write_by_language(sampling.sample_pages(pages, args.number, args.seed, args.minlen, args.clean), args.output)
    else:
        options = options_of(args)
        texts = articles.article_documents(dumps.articles(pages, options.namespaces), options)
        stores.write_docs(texts, curid_url(F.lit(options.prefix), F.col("page_id")), args.output, options.compression, options.records_per_file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
