"""Facts as a table: triples(subject, p, o_type, o_value, o_datatype, o_lang, label) and the joins around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.fixed import IGNORED_PREDICATES, NAMESPACES, RAW_PROPERTY

RESOURCE = NAMESPACES["dbpedia"]


def without_ignored(triples: DataFrame) -> DataFrame:
    return triples.filter(~F.col("p").isin(IGNORED_PREDICATES))


def without_raw_properties(triples: DataFrame) -> DataFrame:
    """Reaches the scan as a pushed NOT StartsWith."""
    return triples.filter(~F.startswith("p", F.lit(RAW_PROPERTY)))


def in_language(triples: DataFrame, language: str) -> DataFrame:
    """Objects in the language, resources, and literals other than plain strings of another language."""
    same = F.lower("o_lang").isin(language, "") | F.startswith(F.lower("o_lang"), F.lit(f"{language}-"))
    literal = (F.col("o_type") != "uri") & F.col("o_datatype").isNotNull() & (F.col("o_datatype") != NAMESPACES["xsd"] + "string")
    return triples.filter(F.coalesce(same, F.lit(False)) | (F.col("o_type") == "uri") | literal)


def values_of(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select("subject", "o_value").distinct()


def labels_of(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.filter((F.col("p") == predicate) & F.col("label").isNotNull()).select("subject", "label").distinct()


def all_labels(labels: DataFrame, redirects: DataFrame, language: str) -> DataFrame:
    """(iri, label): labels of a resource itself and of resources that redirect to it."""
    own = labels.filter(F.col("lang") == language).select("iri", "label")
    moved = redirects.join(own, redirects.from_iri == own.iri).select(F.col("to_iri").alias("iri"), "label")
    return own.unionByName(moved).distinct()


def with_labels(triples: DataFrame, labels: DataFrame, redirects: DataFrame, language: str) -> DataFrame:
    """Triples with every label of their objects, or null; distinct."""
    known = all_labels(labels, redirects, language).withColumnRenamed("iri", "o_value")
    return triples.drop("label").join(known, "o_value", "left").distinct()


def alternate_names(labels: DataFrame, redirects: DataFrame, language: str) -> DataFrame:
    """(iri, label): labels of resources that redirect to iri."""
    names = labels.filter(F.col("lang") == language)
    return redirects.join(names, redirects.from_iri == names.iri).select(F.col("to_iri").alias("iri"), "label").distinct()


def resolve_labels(wanted: DataFrame, labels: DataFrame, redirects: DataFrame, language: str) -> DataFrame:
    """(label, iri): for each wanted label the smallest resource that has it, directly or by a redirect; no categories."""
    known = all_labels(labels, redirects, language)
    pages = known.filter(F.startswith("iri", F.lit(RESOURCE)) & ~F.contains("iri", F.lit("Category:")))
    return wanted.select("label").distinct().join(pages, "label").groupBy("label").agg(F.min("iri").alias("iri"))


def classes_of(wanted: DataFrame, labels: DataFrame, redirects: DataFrame, types: DataFrame, language: str) -> DataFrame:
    """(label, classes): classes of what a label (or its lower case) names; ranges first, else types, else owl:Thing.

    One pass over types(iri, kind, class) gathers both tiers, and the first that is not empty counts."""
    keys = wanted.select("label").distinct().withColumn("key", F.explode(F.array_distinct(F.array("label", F.lower("label")))))
    known = keys.join(all_labels(labels, redirects, language).withColumnRenamed("label", "key"), "key", "left")
    tier = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("class"))))
    sets = known.join(types, "iri", "left").groupBy("label").agg(tier("range").alias("ranges"), tier("type").alias("kinds"))
    some: list[Column] = [F.when(F.size(c) > 0, F.col(c)) for c in ("ranges", "kinds")]
    return sets.select("label", F.coalesce(*some, F.array(F.lit(NAMESPACES["owl"] + "Thing"))).alias("classes"))


def predicates_between(pairs: DataFrame, triples: DataFrame, labels: DataFrame, redirects: DataFrame, language: str) -> DataFrame:
    """(subject_label, object_label, p): predicates that link resources with two labels."""
    known = all_labels(labels, redirects, language)
    s = known.select(F.col("iri").alias("subject"), F.col("label").alias("subject_label"))
    o = known.select(F.col("iri").alias("o_value"), F.col("label").alias("object_label"))
    facts = triples.select("subject", "p", "o_value").join(s, "subject").join(o, "o_value")
    return facts.join(pairs, ["subject_label", "object_label"]).select("subject_label", "object_label", "p").distinct()


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def unworded(triples: DataFrame, wording: Column) -> DataFrame:
    """(p, n, objects): facts whose objects have no wording, by predicate, without raw properties."""
    rows = without_raw_properties(triples).filter(wording.isNull())
    return rows.groupBy("p").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("o_value")).alias("objects"))
