"""Articles to sentences, and naive harvesting over articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import admissible, ascii_fold, split_sentences
from factloom.functions.wikitext import clean, compact, compact_with_sections, drop_section_titles, expand_templates
from factloom.functions.wording import English, Locale
from factloom.operators.naive import context_counts, context_rows, subject_coverage, top_contexts
from factloom.operators.triples import without_ignored
from factloom.sources.dumps import ExtractOptions


def article_text(pages: DataFrame, titles: DataFrame, fold: bool = False) -> DataFrame:
    """Pages of the work-list titles(title); a title without a page is left out. With ``fold``, titles meet by their letters
    without marks and in ASCII, and pages keep their own titles."""
    titles = titles.select("title").distinct()
    if fold:
        key = titles.select(ascii_fold("title").alias("_key")).distinct()
        found = pages.withColumn("_key", ascii_fold("title")).join(key, "_key").drop("_key")
    else:
        found = titles.join(pages, "title")
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def paragraphs_of(text: Column, sections: bool = False, links: bool = False) -> Column:
    """Cleaned paragraphs of an article's markup; headers and list items, or links, stay as HTML if asked for."""
    return (compact_with_sections if sections else compact)(clean(text, links))


def paragraph_rows(pages: DataFrame, templates: bool = True, sections: bool = False, links: bool = False) -> DataFrame:
    """Rows (title, para_no, text) of cleaned paragraphs, from 1."""
    text: Column = expand_templates(F.col("text")) if templates else F.col("text")
    return pages.select("title", F.posexplode(paragraphs_of(text, sections, links)).alias("at", "text")).select("title", (F.col("at") + 1).alias("para_no"), "text")


def article_documents(pages: DataFrame, options: ExtractOptions) -> DataFrame:
    """Pages (page_id, title, text) with text as cleaned paragraphs, one in a line."""
    lines = paragraphs_of(F.col("text"), options.keep_sections, options.keep_links)
    return pages.select("page_id", "title", F.array_join(lines, "\n").alias("text"))


def sentence_rows(paragraphs: DataFrame, locale: Locale | None = None) -> DataFrame:
    """Rows (title, para_no, sent_no, sentence) of adjusted, non-empty sentences without section titles, from 1."""
    locale = locale or English()
    rows = paragraphs.select("title", "para_no", F.posexplode(split_sentences(drop_section_titles(F.col("text")))).alias("at", "s"))
    return rows.select("title", "para_no", (F.col("at") + 1).alias("sent_no"), locale.adjust_text(F.col("s")).alias("sentence")).filter("sentence <> ''")


def sentence_population(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """All sentences of the listed articles that a parser would take."""
    return sentence_rows(paragraph_rows(article_text(pages, titles))).filter(admissible(F.col("sentence"), decompose=True))


def naive_harvest(facts: DataFrame, pages: DataFrame, titles: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Coverage of subjects and top contexts of predicates over whole articles, all paragraphs as one text.

    facts(subject, p, wording), where a subject is a title; templates are not expanded here."""
    lines = paragraph_rows(article_text(pages, titles), templates=False)
    texts = lines.groupBy(F.col("title").alias("subject")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    kept = without_ignored(facts)
    return subject_coverage(kept, texts), top_contexts(context_counts(context_rows(kept, texts)), k)


def work_slice(titles: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """Part of a work-list(position, title), to resume one: rows from ``start`` on, at most ``count``."""
    rows = titles.filter(F.col("position") >= start)
    return rows if count is None else rows.filter(F.col("position") < start + count)


def pages_of(rows: DataFrame, order: list[str], per_page: int) -> DataFrame:
    """Adds ordinal and page, both from 0: sorted rows in pages of ``per_page``. For reports, whose rows are groups and few."""
    ordinal = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("ordinal", ordinal).withColumn("page", F.floor(F.col("ordinal") / per_page))
