"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they occur. For each of ``samples`` seeds a term
draws r and c from Gamma(2, 1) and b from U(0, 1), all from a hash of the term and the seed, and sets
``t = floor(ln(weight) / r + b)`` and ``ln a = ln c - r (t - b + 1)``. The seed's sample is the pair
(term, t) with the smallest a. Two documents draw the same pair with a probability equal to the
generalised Jaccard similarity of their weights, so the share of equal samples estimates it.

DataFrame functions only. Words are counted inside each row (sort, then runs), exploded, and reduced to
one number for each seed before any shuffle: the leading bits order a, the trailing bits name the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, in_ranges

SPACE = r"[\x20\x09-\x0D]+"
#: Documents with neighbouring ids in a bucket, about.
BUCKET = 512
#: Trailing bits of a sample that name the pair.
NAME = 32
#: A document's sample lies beyond its bound with probability e^-SURE.
SURE = 30.0


def term_weights(text: Column) -> Column:
    """Array of (term, weight, share) of a text: hashes of its distinct words, how often each occurs, and that divided by all words; null without words."""
    hashes = F.sort_array(F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))

    def runs(h: Column) -> Column:
        """Pairs of the sorted hashes: positions at which a new one starts, and the end, make the numbers of occurrences."""
        n = F.size(h)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(h, i) != F.get(h, i - 1)))
        return F.transform(F.array(F.struct(h.alias("h"), starts.alias("s"))), lambda x: F.transform(F.sequence(F.lit(0), F.size(x["s"]) - 2), lambda i: term(x["h"], F.get(x["s"], i), F.get(x["s"], i + 1))))[0]

    def term(h: Column, start: Column, end: Column) -> Column:
        weight = (end - start).cast("double")
        return F.struct(F.get(h, start).alias("term"), weight.alias("weight"), (weight / F.size(h)).alias("share"))

    # an array of one element binds a value, so that it is computed once in the lambda's body
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, runs(h)))[0]


def uniform(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / float(1 << 21)


def sample(term: Column, weight: Column, share: Column, seed: int) -> Column:
    """The number of which a document keeps the smallest, for one term (its 64-bit hash) and seed; null if it is too large to be.

    ``a`` is exponential with the weight as its rate, so the document's smallest ``a`` exceeds ``SURE`` over
    its number of words with probability e^-SURE. With ``c = -ln p`` and ``r = -ln q`` as logarithms of
    products of uniforms, ``a >= (1 - p) q / weight``; where that bound is too large, no logarithm is taken."""
    h = F.xxhash64(term, F.lit(seed))
    g = F.xxhash64(h)
    q, u = uniform(h, 0) * uniform(h, 21), uniform(h, 42)
    r = -F.ln(q)
    log_c = F.ln(-F.ln(u * uniform(g, 0)))
    b = uniform(g, 21)
    t = F.floor(F.ln(weight) / r + b)
    log_a = log_c - r * (t - b + 1.0)
    order = F.greatest(F.lit(0.0), F.least(F.lit(float(2**31 - 1)), (log_a + 96.0) * float(1 << 24))).cast("long")
    name = term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit((1 << NAME) - 1))
    return F.when((1.0 - u) * q < SURE * share, F.shiftleft(order, NAME).bitwiseOR(name))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def edited_text() -> Column:
    """The text, its last half of code points replaced by the first ones of the next text."""
    return F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, int(length(text) div 2))"))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_id and next_text: the row with the next larger doc_id, after the last one the first; and bucket and row, which identify a row.

    Ids are cut into ranges of about ``BUCKET`` documents. A range's last row takes the first row of the next
    range, which a table with one row for each range tells; there are at most 131,072 ranges."""
    n = docs.count()
    docs = in_ranges(docs.withColumn("h", F.xxhash64("text")), "doc_id", -(-n // BUCKET))
    heads = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    by = Window.orderBy("bucket")  # one row for each range
    first = F.first("head").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(by), first).alias("head")).select("bucket", F.col("head.doc_id").alias("head"), F.col("head.h").alias("head_h"))
    texts = docs.select(F.col("doc_id").alias("head"), F.col("h").alias("head_h"), "text").join(F.broadcast(heads), ["head", "head_h"])
    texts = texts.groupBy("bucket", "head").agg(F.min("text").alias("head_text"))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "h")
    rows = docs.select("bucket", "doc_id", "text", F.lead("doc_id").over(inside).alias("n_id"), F.lead("text").over(inside).alias("n_text"), F.row_number().over(inside).alias("row"))
    last = F.col("n_id").isNull()
    return rows.join(texts, "bucket", "left").select("bucket", "row", "doc_id", "text", F.when(last, F.col("head")).otherwise(F.col("n_id")).alias("next_id"), F.when(last, F.col("head_text")).otherwise(F.col("n_text")).alias("next_text"))


def signatures(texts: DataFrame, keys: list[str], columns: list[str], samples: int) -> DataFrame:
    """Adds to keys, which identify rows, an array of names for each of the text columns; zeros for a text without words.

    The samples are arguments of the aggregates and not columns: only those are compiled in parts small
    enough for the JIT compiler. If texts are dealt out by one of the keys, nothing is shuffled here."""
    each = [F.struct(F.lit(i).alias("which"), term_weights(F.col(c)).alias("terms")) for i, c in enumerate(columns)]
    rows = texts.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.which", F.inline_outer("x.terms"))
    least = [F.min(sample(F.col("term"), F.col("weight"), F.col("share"), k)).alias(f"s{k}") for k in range(samples)]
    names = F.array(*[F.coalesce(F.col(f"s{k}").bitwiseAND(F.lit((1 << NAME) - 1)), F.lit(0)) for k in range(samples)])
    rows = rows.groupBy(*keys, "which").agg(*least).select(*keys, "which", names.alias("names"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == i, F.col("names"))).alias(f"names{i}") for i in range(len(columns))])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def as_text(names: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(names, lambda x: F.lpad(F.hex(x), NAME // 4, "0"))))


def document_fingerprints(spark: SparkSession, docs: DataFrame, samples: int = 32) -> DataFrame:
    """Fingerprints of documents and of an edited copy of each.

    Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each
    row with a doc_id, equal rows included. doc_ids may be any 64-bit numbers. In the edited text the last half of the code points (rounded down) gives way to as
    many of the next document's first ones, in ascending doc_id; the last document takes the first one. A
    null text counts as empty; texts without words are alike. Rows that repeat a doc_id follow each other
    in the order of a hash of their texts, and such a doc_id is compared by its smallest fingerprint.
    Columns other than doc_id and text are not looked at.
    """
    scratch = Scratch(spark, "fingerprints")
    texts = with_next(texts_of(docs)).select("bucket", "row", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), "text", edited_text().alias("edited"))
    texts = texts.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = scratch.save(signatures(texts, ["bucket", "row", "doc_id", "next_id", "n_chars", "edited_sha256"], ["text", "edited"], samples), "signatures")
    other = rows.groupBy("doc_id").agg(F.min("names0").alias("next_names")).withColumnRenamed("doc_id", "next_id")
    return rows.join(other, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("names0")).alias("fingerprint"), as_text(F.col("names1")).alias("edited_fingerprint"),
        likeness(F.col("names0"), F.col("names1")).alias("near_edited"), likeness(F.col("names0"), F.col("next_names")).alias("near_next"),
    )
