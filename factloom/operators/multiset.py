"""Multisets as tables (elem, n). Elements with n <= 0 vanish from the results of the four operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("elem")).agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts added, whatever their sign."""
    return a.unionByName(b).groupBy("elem").agg(F.sum("n").alias("n"))


def _both(a: DataFrame, b: DataFrame, n: Column) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = a.withColumnRenamed("n", "x").join(b.withColumnRenamed("n", "y"), "elem", "full").select("elem", zero("x").alias("x"), zero("y").alias("y"))
    return rows.select("elem", n.cast("long").alias("n")).filter("n > 0")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(a, b).filter("n > 0")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, F.col("x") - F.col("y"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, F.greatest("x", "y"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, F.least("x", "y"))


def elements(a: DataFrame) -> DataFrame:
    """Each element as often as it counts."""
    return a.filter("n > 0").select("elem", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("elem")


def most_common(a: DataFrame, k: int | None = None) -> DataFrame:
    """By count, ties by element; all without k. With k, a top-k is kept on each executor and no full sort is made."""
    rows = a.orderBy(F.desc("n"), "elem")
    return rows if k is None else rows.limit(k)


def lookup(a: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counts of wanted(elem); 0 for elements that a lacks."""
    return wanted.select("elem").distinct().join(a, "elem", "left").na.fill(0, ["n"])


def discard(a: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts without the elements of gone(elem); one that a lacks does not matter."""
    return a.join(gone.select("elem").distinct(), "elem", "left_anti")


def as_text(a: DataFrame) -> DataFrame:
    """Rows (text), most frequent first: how a multiset reads."""
    return most_common(a).select(F.concat_ws(": ", F.col("elem"), F.col("n").cast("string")).alias("text"))
