"""Naive statistics: which facts of a subject its text words, and the words around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import contexts, wording_in_text


def worded_facts(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """facts(subject, p, wording) with the subject's text(subject, text); one shuffle on subject serves all that follows."""
    return facts.filter(F.col("wording").isNotNull() & (F.col("wording") != "")).join(texts, "subject")


def subject_coverage(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (subject, total, present, absent, ratio): distinct predicates with a wording, and those whose wording the text has.

    The ratio is null for a subject without worded predicates; such a subject has a row if it has facts."""
    hit = F.when(wording_in_text(F.col("text"), F.col("wording")), F.col("p"))
    seen = worded_facts(facts, texts).groupBy("subject").agg(F.count_distinct("p").alias("total"), F.count_distinct(hit).alias("present"))
    rows = facts.select("subject").distinct().join(texts.select("subject"), "subject").join(seen, "subject", "left").na.fill(0, ["total", "present"])
    return rows.select("subject", "total", "present", (F.col("total") - F.col("present")).alias("absent"), F.try_divide("present", "total").alias("ratio"))


def context_rows(facts: DataFrame, texts: DataFrame, words: int = 3) -> DataFrame:
    """Rows (p, preceding, following), one for each occurrence. Regular expressions vary by row; a plain search drops
    most rows before them."""
    rows = worded_facts(facts, texts).filter(F.contains(F.lower("text"), F.lower("wording")))
    return rows.select("p", F.explode(contexts(F.col("text"), F.col("wording"), words)).alias("c")).select("p", "c.preceding", "c.following")


def context_counts(rows: DataFrame) -> DataFrame:
    """Rows (p, side, string, n)."""
    sides = F.array(F.struct(F.lit("preceding").alias("side"), F.col("preceding").alias("string")), F.struct(F.lit("following").alias("side"), F.col("following").alias("string")))
    return rows.select("p", F.explode(sides).alias("s")).groupBy("p", "s.side", "s.string").agg(F.count("*").alias("n"))


def top_contexts(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent strings for each predicate and side, ties by string; adds rank."""
    by = Window.partitionBy("p", "side").orderBy(F.desc("n"), "string")
    return counts.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def couplings(rows: DataFrame) -> DataFrame:
    """Distinct pairs of preceding and following strings for each predicate."""
    return rows.groupBy("p").agg(F.count_distinct("preceding", "following").alias("couplings"))


def wordings_by_predicate(facts: DataFrame) -> DataFrame:
    return facts.filter("wording IS NOT NULL").groupBy("p").agg(F.sort_array(F.collect_set("wording")).alias("wordings"))


def predicate_statistics(facts: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """Nested view: wordings, coupling count and top contexts of each predicate."""
    top = top_contexts(context_counts(rows), k).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("side", "rank", "string", "n"))).alias("top"))
    return wordings_by_predicate(facts).join(couplings(rows), "p", "left").join(top, "p", "left")


def predicate_occurrences(facts: DataFrame, sentences: DataFrame) -> DataFrame:
    """Rows (subject, p, occurrences): distinct wordings that some sentence(subject, sentence) holds; predicates without any count 0.

    The join is an equi-join on subject, with containment as its condition."""
    worded = facts.filter(F.col("wording").isNotNull() & (F.col("wording") != "")).select("subject", "p", "wording").distinct()
    s = sentences.select(F.col("subject").alias("article"), "sentence")
    hits = worded.join(s, (F.col("subject") == F.col("article")) & F.contains("sentence", F.col("wording"))).select("subject", "p", "wording").distinct()
    counted = hits.groupBy("subject", "p").agg(F.count("*").alias("occurrences"))
    return worded.select("subject", "p").distinct().join(counted, ["subject", "p"], "left").na.fill(0, ["occurrences"])
