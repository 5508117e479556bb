"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r; of all rates that give every source its target number of words and stay
between 0 and ``most``, the ones nearest to equal rates in relative entropy have the form
``r = min(most, exp(lambda * size / mean size))`` with one lambda for each source. The lambdas are the
solution of the convex dual; Newton steps find them, kept inside brackets. Documents of one source and
size share a rate, so the steps run over an aggregated table with a row for each (source, size), until no
source is off. Rates become copies by rounding the running sum of expected copies from the longest documents to
the shortest, which leaves a source within half of its longest document of its target; then, in three passes, documents
are taken more or less often, from the shortest on, until what is missing is less than the next size.
Running sums are taken inside ranges of sizes and then over the ranges, so no task holds all sizes of a source.

DataFrame functions only; the state of the iteration is a table with a row for each source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps in one plan, and such plans at most (bisection alone ends within them); a plan's last state is written, which cuts the lineage.
STEPS, ROUNDS = 4, 15
#: Share of a target, and of a word, that a source may be off when the steps end.
OFF = 1e-9
#: Sizes whose running sums one task takes: those of one source with the same size // RANGE.
RANGE = 1024
#: Documents of one source and size that are ranked in one window, on average.
RANKED = 1024


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """Adds weight and target to sources(source, source_size): weights repeat in code point order, null last.

    Targets are ``weight * level`` but at most ``most * source_size``. Ordered by ``source_size / weight``
    the capped sources come first, so one running sum finds the level. One task sees one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    cap = most * F.col("source_size")
    # the tie-break by source keeps the running sums of equal ratios the same in every run
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (budget * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("capped", cap < F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.struct(-F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return rows.withColumn("target", F.when(F.col("capped"), cap).otherwise(F.least(cap, F.col("weight") * level))).select("source", "source_size", "weight", "target")


def newton_step(cells: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """One bracketed Newton step of each source's lambda. cells(source, size, docs); state as in ``solve``."""
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("lam") * x, F.lit(20.0)))
    words = F.col("size") * F.col("docs")
    value = F.sum(words * F.least(raw, F.lit(most))).alias("value")
    slope = F.sum(F.when(raw < most, words * x * raw).otherwise(0.0)).alias("slope")
    sums = cells.join(state.hint("shuffle_hash"), cells.source.eqNullSafe(state.source)).drop(cells.source).groupBy("source", "mean", "target", "lam", "low", "high").agg(value, slope)
    off = F.col("value") - F.col("target")
    low, high = F.when(off < 0, F.col("lam")).otherwise(F.col("low")), F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
    step = F.col("lam") - F.try_divide(off, F.col("slope"))
    inside = (step > low) & (step < high)
    done = F.abs(off) <= OFF * F.greatest(F.col("target"), F.lit(1.0))
    new = F.when(done, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
    return sums.select("source", "mean", "target", new.alias("lam"), low.alias("low"), high.alias("high"), (done | (high - low < 1e-12)).alias("done"))


def solve(scratch: Scratch, cells: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """Rows (source, mean, target, lam): the dual solution for each source with words."""
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"))
    state = mean.join(goals, mean.source.eqNullSafe(goals.source)).drop(goals.source).filter("mean > 0")
    # a source that gets all that it may give has no finite solution; a large lambda takes every document as often as allowed
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = state.select("source", "mean", "target", F.when(full, 4096.0).otherwise(0.0).alias("lam"), F.lit(-4096.0).alias("low"), F.lit(4096.0).alias("high"), full.alias("done"))
    state = scratch.save(state, "state0")
    for k in range(ROUNDS):
        if state.filter(~F.col("done")).isEmpty():
            break
        for _ in range(STEPS):
            state = newton_step(cells, state, most)
        state = scratch.save(state, f"state{k + 1}")
    return state


def running(rows: DataFrame, sums: dict[str, Column], largest_first: bool) -> DataFrame:
    """Adds for each name the sum of the column over the sizes before this one of its source: inside its range of sizes, and of the ranges before."""
    order = (lambda c: F.desc(c)) if largest_first else (lambda c: F.asc(c))
    rows = rows.withColumn("range", F.floor(F.col("size") / RANGE))
    totals = rows.groupBy("source", "range").agg(*[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])
    over = Window.partitionBy("source").orderBy(order("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "range", *[F.coalesce(F.sum(f"{n}_all").over(over), F.lit(0)).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy("source", "range").orderBy(order("size")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}_in") for n, c in sums.items()])
    rows = rows.join(totals, rows.source.eqNullSafe(totals.source) & (rows.range == totals.range)).drop(totals.source).drop(totals.range)
    for n in sums:
        rows = rows.withColumn(n, F.col(f"{n}_in") + F.col(f"{n}_all")).drop(f"{n}_in", f"{n}_all")
    return rows.drop("range")


def copies(scratch: Scratch, cells: DataFrame, solution: DataFrame, most: int) -> DataFrame:
    """Rows (source, size, copies): the copies of all documents of a cell together."""
    x = F.col("size") / F.col("mean")
    rate = F.least(F.exp(F.least(F.col("lam") * x, F.lit(20.0))), F.lit(float(most)))
    rated = cells.filter("size > 0").join(solution, cells.source.eqNullSafe(solution.source)).drop(solution.source)
    rated = rated.select("source", "size", "docs", "target", (F.col("docs") * rate).alias("expected"))
    rated = running(rated, {"earlier": F.col("expected")}, largest_first=True)
    n = F.round(F.col("earlier") + F.col("expected")).cast("long") - F.round("earlier").cast("long")
    rated = rated.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("docs") * most, n)))
    rated = scratch.save(rated.select("source", "size", "docs", "target", "copies"), "rounded0")
    # a pass that rounds up goes beyond the target by less than the size it ends at; the next one comes back from there by shorter documents
    for k, whole in enumerate((F.ceil, F.ceil, F.round)):
        rated = scratch.save(corrected(rated, most, whole), f"rounded{k + 1}")
    return rated.select("source", "size", "copies")


def corrected(rated: DataFrame, most: int, whole: Callable[[Column], Column]) -> DataFrame:
    """rated(source, size, docs, target, copies) with more or fewer copies, from the shortest documents on, by as many words as a source lacks or has too many."""
    taken = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    rated = rated.join(taken, rated.source.eqNullSafe(taken.source)).drop(taken.source)
    # words that a cell's documents can still take, or give back
    room = F.when(F.col("missing") > 0, F.col("docs") * most - F.col("copies")).otherwise(F.col("copies"))
    rated = running(rated.withColumn("room", room), {"before": F.col("room") * F.col("size")}, largest_first=False)
    left = F.greatest(F.lit(0.0), F.abs("missing") - F.col("before"))
    change = F.least(F.col("room"), whole(left / F.col("size")).cast("long"))
    return rated.select("source", "size", "docs", "target", F.when(F.col("missing") > 0, F.col("copies") + change).otherwise(F.col("copies") - change).alias("copies"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("u"))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """Rows (source, source_size, weight, target) of the sources of docs."""
    return targets(sized_documents(docs).groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, float(most))


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """Copies of each document so that sources reach target shares of words.

    Rows (doc_id, size, source_size, target, copies, taken). Sources by code point, null last, weigh
    ``weights`` in turn and share ``budget`` times all words; a source gets at most ``most`` times its
    words, and what exceeds that is shared again. A null text has size 0; a document without words is
    taken with 0 words and 0 copies. Null sources are one source. Rows that repeat a doc_id are separate
    documents with their own copies. The choice among documents of one source and size follows a hash of
    doc_id, so reruns agree; rows with a null doc_id or the same one, source and size are alike. A text of any length
    is read whole. An empty table gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(sized_documents(docs), "sized")
    cells = scratch.save(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = scratch.save(targets(sources, weights, budget, float(most)), "goals")
    given = scratch.save(copies(scratch, cells, solve(scratch, cells, goals, float(most)), most), "given")

    keyed = cells.join(given, cells.source.eqNullSafe(given.source) & (cells.size == given.size), "left").drop(given.source).drop(given.size)
    keyed = keyed.select("source", "size", F.floor(F.coalesce("copies", F.lit(0)) / F.col("docs")).alias("each"), (F.coalesce("copies", F.lit(0)) % F.col("docs")).alias("more"), F.ceil(F.col("docs") / RANKED).alias("parts"))
    keyed = keyed.join(goals, keyed.source.eqNullSafe(goals.source)).drop(goals.source)
    dealt = sized.join(keyed, sized.source.eqNullSafe(keyed.source) & (sized.size == keyed.size)).drop(keyed.source).drop(keyed.size)
    dealt = dealt.withColumn("part", F.pmod("u", "parts"))
    parts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "size", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("u", "doc_id"))
    ranked = dealt.withColumn("rank", rank)
    ranked = ranked.join(parts, ranked.source.eqNullSafe(parts.source) & (ranked.size == parts.size) & (ranked.part == parts.part)).drop(parts.source).drop(parts.size).drop(parts.part)
    n = F.col("each") + F.when(F.col("rank") + F.col("skip") <= F.col("more"), 1).otherwise(0)
    return ranked.select("doc_id", "size", "source_size", "target", n.cast("int").alias("copies"), (n * F.col("size")).alias("taken"))
