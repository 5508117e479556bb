"""Sources: MediaWiki dumps, work-lists, sentence files, pattern stores."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.fixed import ACCEPTED_NAMESPACES, RAW_PROPERTY

PAGE = "title string, ns int, id bigint, redirect struct<_title: string>, revision struct<id: bigint, text: struct<_VALUE: string>>"
DUMP_NAME = r"([^/]*?)wiki-(\d{8})-pages-articles\.xml"


@dataclass(frozen=True)
class ExtractOptions:
    """Options of a text extraction run: see ``articles.article_documents`` and ``stores.write_docs``."""

    namespaces: tuple[str, ...] = tuple(ACCEPTED_NAMESPACES)
    keep_sections: bool = False
    keep_links: bool = False
    compression: str = "none"
    records_per_file: int = 100_000
    prefix: str = "http://en.wikipedia.org/wiki"


def read_options(path: str | None = None, given: dict | None = None) -> ExtractOptions:
    """Options out of the section [extract] of an INI file, if there is one; those given prevail."""
    known, found = ExtractOptions(), {}
    if path:
        file = configparser.ConfigParser()
        with open(path) as lines:
            file.read_file(lines)
        for name, value in file["extract"].items():
            kind = type(getattr(known, name))
            found[name] = file["extract"].getboolean(name) if kind is bool else tuple(value.split(",")) if kind is tuple else kind(value)
    return replace(known, **found | (given or {}))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows (lang, page_id, title, redirect, text) of plain or bzip2 dumps; the language is the file name's prefix. The schema
    is given, so nothing is scanned to infer it. A null text is empty."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), DUMP_NAME, 1)
    return rows.select(F.when(name != "", name).alias("lang"), F.col("id").alias("page_id"), "title", F.col("redirect._title").alias("redirect"), F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def read_dumps(spark: SparkSession, folder: str, langs: list[str] | None = None) -> DataFrame:
    """All dumps of a folder, or those of some languages."""
    pattern = "*wiki-*-pages-articles.xml*" if langs is None else "{" + ",".join(langs) + "}wiki-*-pages-articles.xml*"
    return read_dump(spark, f"{folder}/{pattern}")


def find_dumps(spark: SparkSession, folder: str, langs: list[str] | None = None) -> DataFrame:
    """Rows (lang, date, path) of the dumps in a folder; lists files only."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*wiki-*-pages-articles.xml*").load(folder).select("path")
    rows = rows.select(F.regexp_extract("path", DUMP_NAME, 1).alias("lang"), F.regexp_extract("path", DUMP_NAME, 2).alias("date"), "path")
    return rows if langs is None else rows.filter(F.col("lang").isin(langs))


def numbered(pages: DataFrame) -> DataFrame:
    """Adds ordinal, from 0 in each language in the order of page_id; numbers are counted in ranges of page_id, so no task sorts a language."""
    rows = pages.withColumn("_range", F.floor(F.col("page_id") / 10_000))
    counts = rows.groupBy("lang", "_range").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("lang", "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_skip"))
    rank = F.row_number().over(Window.partitionBy("lang", "_range").orderBy("page_id")) - 1
    joined = rows.withColumn("_rank", rank).withColumnRenamed("lang", "_lang").withColumnRenamed("_range", "_r")
    joined = joined.join(counts, joined._lang.eqNullSafe(counts.lang) & (joined._r == counts._range))
    return joined.select(*pages.columns, (F.col("_rank") + F.col("_skip")).alias("ordinal"))


def page_at(pages: DataFrame, ordinal: int, lang: str | None = None) -> DataFrame:
    """The page with that number in its language (of each language, without one)."""
    rows = numbered(pages).filter(F.col("ordinal") == ordinal)
    return rows if lang is None else rows.filter(F.col("lang") == lang)


def articles(pages: DataFrame, namespaces: list[str] | tuple[str, ...] = ACCEPTED_NAMESPACES) -> DataFrame:
    """Pages that are neither redirects nor in another namespace than the accepted ones."""
    space = F.split_part(F.col("title"), F.lit(":"), F.lit(1))
    return pages.filter(F.col("redirect").isNull() & (~F.contains("title", F.lit(":")) | space.isin(list(namespaces))))


def build_index(pages: DataFrame, path: str) -> None:
    """Pages as Parquet by language, sorted by title within files, so that lookups by title skip row groups."""
    pages.repartition("lang", F.pmod(F.xxhash64("title"), F.lit(64))).sortWithinPartitions("title").write.mode("overwrite").partitionBy("lang").parquet(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Rows (position, title) of a work-list with one title in a line; positions follow the order of a single file."""
    rows = spark.read.text(path).select(F.trim("value").alias("title"), F.monotonically_increasing_id().alias("position"))
    return rows.filter("title <> ''").select("position", "title")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sent_no, sentence), from 1, of a file with one sentence in a line."""
    rows = spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("sent_no"), F.col("value").alias("sentence"))
    return rows.filter("sentence <> ''")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns without raw properties; the filter reaches the scan."""
    return spark.read.parquet(path).filter(~F.startswith("predicate", F.lit(RAW_PROPERTY)))


def revisions(responses: DataFrame, column: str = "body") -> DataFrame:
    """Rows (page_id, title, text) out of stored answers of a wiki's query interface."""
    shape = "struct<query:struct<pages:map<string,struct<pageid:bigint,title:string,revisions:array<struct<`*`:string>>>>>>"
    rows = responses.select(F.explode(F.from_json(F.col(column), shape)["query"]["pages"]).alias("key", "page"))
    return rows.select("page.pageid", "page.title", F.get("page.revisions", F.lit(0))["*"].alias("text")).withColumnRenamed("pageid", "page_id")
