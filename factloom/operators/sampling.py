"""Reproducible samples. Order comes from a hash of a key and a seed, so a sample does not depend on partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.wikitext import remove_markup


def draw(key: Column | str, seed: int) -> Column:
    """A hexadecimal string that orders rows at random; another engine can compute it too."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) from 32 bits of the hash."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") / float(2**32)


def exact_sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Exactly k rows (or all) without replacement; each executor keeps its k smallest draws."""
    return rows.withColumn("_draw", draw(key, seed)).orderBy("_draw", key).limit(k).drop("_draw")


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group (or all). Spark keeps the k first of a group on each task before it shuffles."""
    by = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return rows.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= k).drop("_rank")


def sample_pages(pages: DataFrame, n: int, seed: int, least: int = 0, clean: bool = False) -> DataFrame:
    """n pages of each language (or all) out of those that are accepted: at least ``least`` bytes, without markup if ``clean``."""
    if clean:
        pages = pages.withColumn("text", remove_markup(F.col("text")))
    return sample_per_group(pages.filter(F.octet_length("text") >= least), "lang", "page_id", n, seed)


def random_subjects(triples: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct subjects of a table of facts (or all), without replacement."""
    return exact_sample(triples.select("subject").distinct(), "subject", n, seed)


def weighted_choice(items: DataFrame, draws: DataFrame, seed: int, cells: int = 4096) -> DataFrame:
    """For each of draws(draw_id) one of items(item, weight), with replacement: rows (draw_id, item).

    Cumulative weights make an interval for each item. The unit interval is cut into cells; a draw meets the intervals that
    touch its cell by an equi-join, so neither side is broadcast unless it is small."""
    order = Window.orderBy("item").rowsBetween(Window.unboundedPreceding, 0)  # one task sees the items, not the draws
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    positive = items.filter("weight > 0").select("item", F.col("weight").cast("double"), F.sum(F.col("weight").cast("double")).over(order).alias("upto"), F.sum(F.col("weight").cast("double")).over(every).alias("all"))
    cdf = positive.select("item", ((F.col("upto") - F.col("weight")) / F.col("all")).alias("low"), (F.col("upto") / F.col("all")).alias("high"))
    cell = lambda c: F.floor(F.col(c) * cells)
    cdf = cdf.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    u = draws.select("draw_id", uniform("draw_id", seed).alias("u")).withColumn("cell", cell("u"))
    return u.join(cdf, "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("draw_id", "item")


def partition_exact(rows: DataFrame, key: str, weights: list[float], seed: int) -> DataFrame:
    """Adds part: sizes are the floors of n * weight, and what is left over goes to the parts one row each, at random.

    Ranks come from counts of hash ranges and from windows within a range, so no task sorts all rows."""
    total = float(sum(weights))
    n = rows.count()
    sizes = [int(n * w / total) for w in weights]
    rest = n - sum(sizes)
    ranges = max(1, n // 50_000)
    keyed = rows.withColumn("_u", uniform(key, seed)).withColumn("_range", F.floor(F.col("_u") * ranges))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("m"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    skip = counts.select("_range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_skip"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_u", key)) - 1
    ranked = keyed.withColumn("_rank", rank).join(skip, "_range").withColumn("_rank", F.col("_rank") + F.col("_skip"))
    part, start = F.lit(None).cast("int"), rest
    for i, size in enumerate(sizes):
        part = F.when(F.col("_rank") >= start, F.lit(i)).otherwise(part) if size else part
        start += size
    part = F.when(F.col("_rank") < rest, (F.col("_rank") % len(weights)).cast("int")).otherwise(part)
    return ranked.withColumn("part", part).drop("_u", "_range", "_skip", "_rank")


def partition_probabilistic(rows: DataFrame, key: str, weights: list[float], seed: int) -> DataFrame:
    """Adds part, drawn for each row by the weights."""
    total, upto, part = float(sum(weights)), float(sum(weights)), F.lit(len(weights) - 1)
    for i in reversed(range(len(weights) - 1)):
        upto -= weights[i + 1]
        part = F.when(F.col("_u") < upto / total, F.lit(i)).otherwise(part)
    return rows.withColumn("_u", uniform(key, seed)).withColumn("part", part).drop("_u")


def segment_documents(pages: DataFrame, languages: DataFrame, n_docs: int, n_segments: int, seed: int, exclude: DataFrame | None = None, transform: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Documents of n_segments pieces: rows (docid, doc, classes). Texts go through ``transform`` first.

    Each segment draws a language from languages(item, weight), takes that language's next unused page of
    pages(page_id, lang, text), and keeps its share of the page by position. exclude(page_id) is not used.
    A document lacking a page for one of its segments is left out."""
    spark = pages.sparkSession
    if exclude is not None:
        pages = pages.join(exclude.select("page_id"), "page_id", "left_anti")
    slots = spark.range(n_docs * n_segments).select(F.col("id").alias("draw_id"))
    chosen = weighted_choice(languages, slots, seed).withColumnRenamed("item", "lang")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw_id"))
    # ids alone are ranked, and of each language only as many as there are slots stay on any task; texts join what is left
    supply = sample_per_group(pages.select("lang", "page_id"), "lang", "page_id", n_docs * n_segments, seed)
    supply = supply.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(draw("page_id", seed), "page_id")))
    took = chosen.withColumn("turn", turn).join(supply, ["lang", "turn"]).join(pages.select("lang", "page_id", transform(F.col("text")).alias("text")), ["lang", "page_id"])
    k = F.col("draw_id") % n_segments
    start, end = F.floor(F.length("text") * k / n_segments), F.floor(F.length("text") * (k + 1) / n_segments)
    piece = F.col("text").substr((start + 1).cast("int"), (end - start).cast("int"))
    parts = took.select(F.floor(F.col("draw_id") / n_segments).alias("doc"), F.struct(k.alias("k"), "page_id", "lang", piece.alias("piece")).alias("s"))
    docs = parts.groupBy("doc").agg(F.sort_array(F.collect_list("s")).alias("s")).filter(F.size("s") == n_segments)
    join = lambda f, sep: F.array_join(F.transform("s", f), sep)
    return docs.select(join(lambda x: x["page_id"].cast("string"), "-").alias("docid"), join(lambda x: x["piece"], "").alias("doc"), F.transform("s", lambda x: x["lang"]).alias("classes"))


def ceil_half(values: Column) -> Column:
    """The first half of an array; of an odd number of elements, the larger half."""
    return F.slice(values, 1, F.ceil(F.size(values) / 2).cast("int"))
