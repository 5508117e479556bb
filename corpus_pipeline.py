"""A training corpus in five stages: rate, join near copies, strip repeated passages, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``. Stages select rows and not ids: a row whose doc_id is null or occurs again is
treated like any other. No stage but the last has an SQL twin, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, read
from factloom.llm.mixing import mix_sources
from factloom.llm.ngram_jaccard import BROADCAST_ROWS, ngram_jaccard_classes
from factloom.llm.packing import best_fit_packing
from factloom.llm.quality import quality_model, rate_documents
from factloom.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with doc_id as ``own_id`` and, as doc_id, a key of the row in the order of doc_id, nulls last. Where no doc_id is
    null or occurs again, which a count of ids alone tells, it is the key itself."""
    docs = docs.select(COLUMNS).withColumn("own_id", F.col("doc_id"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return docs
    rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text", "lang", "source", "n_chars"))
    return Scratch(spark, "keyed").save(rows.withColumn("doc_id", F.monotonically_increasing_id()), "rows")


def unkeyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("own_id")).select(COLUMNS)


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is good (neither low nor toxic) with probability 0.4 or more stay."""
    docs = docs.select(COLUMNS)
    return rate_documents(docs, quality_model(spark, docs, sf_dir), enough=2, least=0.4, only_kept=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links, the one with the smallest doc_id stays; of equal ones, one row."""
    docs = keyed(spark, docs)
    classes = Scratch(spark, "classes").save(ngram_jaccard_classes(spark, docs).filter("doc_id <> component_id").select("doc_id"), "copies")
    small = classes.count() <= BROADCAST_ROWS
    return unkeyed(docs.join(F.broadcast(classes) if small else classes, "doc_id", "left_anti"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a text that loses nothing stays as it is, one that loses all its words goes."""
    left = substring_dedup(spark, keyed(spark, docs), carry=("lang", "source", "own_id")).filter("n_removed = 0 OR n_removed < n_words")
    return unkeyed(left.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = keyed(spark, docs)
    copies = mix_sources(spark, docs).select("doc_id", "copies").filter("copies > 0")
    return unkeyed(docs.join(copies, "doc_id").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return best_fit_packing(spark, docs)


STAGES = [("quality classifier", rate), ("n-gram Jaccard join", one_of_each), ("substring dedup", without_repeats), ("mixing sources", mixed), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
