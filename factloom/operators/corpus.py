"""Statistics of a corpus of pages: lengths in bytes and in characters, languages, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.wikitext import categories

THRESHOLDS = [5000, 2000, 1000, 500, 200, 100, 50, 20, 10]


def with_lengths(pages: DataFrame) -> DataFrame:
    return pages.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))).withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))


def category_rows(pages: DataFrame, unpiped: bool = False) -> DataFrame:
    return pages.select("page_id", F.explode(categories(F.col("text"), unpiped)).alias("category"))


def category_index(pages: DataFrame, unpiped: bool = False) -> DataFrame:
    """Rows (category, pages): each category's pages in order."""
    return category_rows(pages, unpiped).groupBy("category").agg(F.sort_array(F.collect_list("page_id")).alias("pages"))


def category_sizes(pages: DataFrame, unpiped: bool = False) -> DataFrame:
    return category_rows(pages, unpiped).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def dump_statistics(pages: DataFrame, unpiped: bool = False) -> DataFrame:
    """Rows (lang, pages, categories), most pages first."""
    rows = pages.select("lang", F.explode_outer(categories(F.col("text"), unpiped)).alias("category"), "page_id")
    counted = rows.groupBy("lang").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("category").alias("categories"))
    return counted.orderBy(F.desc("pages"), "lang")


def language_distribution(pages: DataFrame) -> DataFrame:
    return pages.groupBy("lang").agg(F.count("*").alias("pages"))


def length_statistics(pages: DataFrame) -> DataFrame:
    """Rows (lang, median, mean, std) of byte lengths; the deviation is the population's."""
    b = F.col("bytes")
    return with_lengths(pages).groupBy("lang").agg(F.median(b).alias("median"), F.avg(b).alias("mean"), F.stddev_pop(b).alias("std"))


def overall_length_statistics(pages: DataFrame) -> DataFrame:
    """One row: statistics of all lengths, and the means of the languages' statistics."""
    each = length_statistics(pages).agg(F.avg("median").alias("mean_median"), F.avg("mean").alias("mean_mean"), F.avg("std").alias("mean_std"))
    b = F.col("bytes")
    every = with_lengths(pages).agg(F.median(b).alias("median"), F.avg(b).alias("mean"), F.stddev_pop(b).alias("std"))
    return every.join(each, F.lit(True))


def under_thresholds(pages: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """Rows (lang, threshold, under, proportion): documents shorter than each threshold, in one pass."""
    sums = with_lengths(pages).groupBy("lang").agg(F.count("*").alias("all"), F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("bytes") < t).alias("under")) for t in thresholds]).alias("t"))
    return sums.select("lang", "all", F.explode("t").alias("t")).select("lang", "t.threshold", "t.under", (F.col("t.under") / F.col("all")).alias("proportion"))


def documents_under(pages: DataFrame, threshold: int) -> DataFrame:
    """Rows (docid, bytes) of pages shorter than threshold; docid is language and page."""
    return with_lengths(pages).filter(F.col("bytes") < threshold).select(F.concat_ws("_", "lang", F.col("page_id").cast("string")).alias("docid"), "bytes")


def length_histogram(pages: DataFrame, bins: int = 1000) -> DataFrame:
    """Rows (lang, bin, n): counts between ``bins`` edges up to mean + 3 deviations; what is below the first edge or above the
    last is left out, and the last edge itself counts."""
    sized = with_lengths(pages).select("lang", "bytes")
    edge = sized.groupBy("lang").agg(((F.avg("bytes") + 3 * F.stddev_pop("bytes")) / bins).alias("step")).filter("step > 0")
    rows = sized.join(edge, "lang").filter((F.col("bytes") >= F.col("step")) & (F.col("bytes") <= F.col("step") * bins))
    return rows.groupBy("lang", F.least(F.floor(F.col("bytes") / F.col("step")), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def first_of_title(pages: DataFrame) -> DataFrame:
    """The title index: of pages with one title, the first."""
    by = Window.partitionBy("title").orderBy("page_id")
    return pages.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")


def nearest_power_of_ten(x):
    return F.pow(F.lit(10.0), F.round(F.log10(x)))
