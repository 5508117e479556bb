"""What galleries of patterns and statements show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patterns_per_predicate(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("predicate").agg(F.count_distinct("hash").alias("patterns"))


def match_totals(matches: DataFrame) -> DataFrame:
    """One row: distinct statements, patterns that gave them, statements with sources."""
    return matches.agg(F.count_distinct("subject_wording", "predicate", "object_wording").alias("triples"), F.count_distinct("pattern").alias("used_patterns"), F.count("*").alias("matches"))


def statement_sources(matches: DataFrame, k: int = 5) -> DataFrame:
    """For each statement its first k sentences and how many more there are.

    Each task keeps the k first sentences of a statement before the shuffle, so a statement with very many is bounded."""
    keys = ["subject_wording", "predicate", "object_wording"]
    rows = matches.select(*keys, "sentence").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("sentence"))).filter(F.col("rank") <= k)
    first = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("sentence")).alias("sentences"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return first.join(counts, keys).select(*keys, "sentences", F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def item(*parts: Column | str) -> Column:
    return F.concat(F.lit("<li>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</li>"))


def gallery_pages(items: DataFrame, group: str, order: list[str], per_page: int, title: str) -> DataFrame:
    """Rows (page, group, html) of a gallery: items(group, html, *order) of a group in pages of ``per_page``, each with links to its neighbours.

    Items are numbered in their group; a page is made where its items are, so a group of any size has pages of a bounded one."""
    ordinal = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    rows = items.withColumn("page", F.floor(ordinal / per_page)).withColumn("ordinal", ordinal)
    pages = rows.groupBy(group, "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "html"))).alias("items"))
    last = F.max("page").over(Window.partitionBy(group))
    link = lambda step, name: F.concat(F.lit('<a href="'), (F.col("page") + step).cast("string"), F.lit(f'.html">{name}</a> '))
    head = F.concat(F.lit(f"<h1>{title}: "), escaped(F.col(group)), F.lit("</h1><p>"), F.when(F.col("page") > 0, link(-1, "previous")).otherwise(""), F.when(F.col("page") < last, link(1, "next")).otherwise(""), F.lit("</p>"))
    return pages.select("page", group, F.concat(head, F.lit("<ul>"), F.array_join(F.transform("items", lambda x: x["html"]), ""), F.lit("</ul>")).alias("html"))


def pattern_gallery(patterns: DataFrame, per_page: int = 10) -> DataFrame:
    """Pages of the pattern library by predicate: each pattern's edges, and what its entities were."""
    edges = F.array_join(F.transform("edges", lambda e: F.concat(e["tail"], F.lit(" -"), e["label"], F.lit("-> "), e["head"])), "; ")
    words = F.array_join(F.transform("entities", lambda x: x["wording"]), ", ")
    items = patterns.select("predicate", "hash", item("<code>", escaped(edges), "</code>", F.when(words != "", F.concat(F.lit(" "), escaped(words))).otherwise("")).alias("html"))
    return gallery_pages(items, "predicate", ["hash"], per_page, "Patterns")


def match_gallery(matches: DataFrame, per_page: int = 10, k: int = 5) -> DataFrame:
    """Pages of statements by predicate: each with its first k sentences and how many more there are."""
    rows = statement_sources(matches, k)
    said = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<q>"), escaped(s), F.lit("</q>"))), " ")
    more = F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    items = rows.select("predicate", "subject_wording", "object_wording", item(escaped(F.col("subject_wording")), " – ", escaped(F.col("object_wording")), ": ", said, more).alias("html"))
    return gallery_pages(items, "predicate", ["subject_wording", "object_wording"], per_page, "Statements")
