"""Token ids of whole texts, and the exact length histogram.

The vocabulary ``word_bpe_49k`` never joins characters across white space, so the ids of a text are the
ids of its ASCII-space-separated parts put together. Parts repeat, so each worker remembers theirs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, in_parts, word_codes


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PartIds(dict):
    """Little-endian unsigned 32-bit ids of parts of texts; forgets them at ``LIMIT`` parts or ``BYTES`` bytes, so memory is bounded."""

    LIMIT, BYTES, AT_ONCE = 600_000, 128_000_000, 20_000
    #: Marks that are cut off the end of a part, where they follow a letter or a digit: the vocabulary's rule puts a boundary there.
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode, self.held = Tokenizer.from_file(path).encode, 0

    def keep(self, part: str, ids: bytes) -> None:
        self[part] = ids
        self.held += len(part) + len(ids)

    def learn(self, parts: list[str]) -> None:
        """Encode parts that are not known. Words of letters alone, each one word to the vocabulary, are encoded many at once."""
        new = [p for p in parts if p not in self]
        if len(self) + len(new) > self.LIMIT or self.held > self.BYTES:
            self.clear()
            self.held, new = 0, parts
        plain = [p for p in new if p.isalpha() and p.lower().isalpha()]
        for i in range(0, len(plain), self.AT_ONCE):
            some = plain[i : i + self.AT_ONCE]
            found = self.encode(" ".join(some), add_special_tokens=False)
            ids, ends = np.array(found.ids, "<u4").tobytes(), np.searchsorted(np.array(found.word_ids), np.arange(len(some) + 1)).tolist()
            if len(set(found.word_ids)) == len(some):  # no word was cut or lost
                for p, a, b in zip(some, ends[:-1], ends[1:], strict=True):
                    self.keep(p, ids[4 * a : 4 * b])
        for p in new:
            if p not in self:
                self.keep(p, np.array(self.encode(p, add_special_tokens=False).ids, "<u4").tobytes())

    def flat(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in turn, and how many each has. (More parts than the limit at once are not forgotten in between.)"""
        self.learn(parts)
        found = [self[p] for p in parts]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's ids start (and the last end). A-Z is folded first, as the vocabulary
        does it, unless the text may name a special token. Each distinct part of the texts is looked up once."""
        texts = pc.fill_null(texts, "")
        codes, starts, parts = word_codes(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        bare = pc.ascii_rtrim(parts, characters=self.TAIL)
        cut = pc.and_(pc.and_not(pc.not_equal(bare, parts), pc.match_substring(parts, "<|")), pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"))
        tails = pc.if_else(cut, pc.replace_substring_regex(parts, r"(?s)^.*[\p{L}\p{N}]", ""), "")
        both = pa.concat_arrays([pc.if_else(cut, bare, parts), tails]).dictionary_encode()
        ids, ends = gathered(*self.flat(both.dictionary.to_pylist()), both.indices.to_numpy().reshape(2, -1).T.ravel())
        ends = ends[::2]  # a part's bare beginning and its tail together
        ids, ends = gathered(ids, np.diff(ends), codes)
        return ids, ends[starts]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.of(texts)[1])


def gathered(values: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of values with these lengths, those that order names in turn, and where each starts (and the last ends)."""
    first, each = np.cumsum(lengths) - lengths, lengths[order]
    ends = np.r_[0, np.cumsum(each)]
    return values[np.repeat(first[order] - ends[:-1], each) + np.arange(ends[-1])], ends


@functools.lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    return PartIds(path)


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """Rows (n_tokens): one for each document; a null text has none."""

    def count(batches):
        ids = part_ids(path)
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(ids.lengths(batch.column("text")), pa.int64())})

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(counts: DataFrame, block: int = 1024) -> DataFrame:
    """Suffix sums over the exact histogram counts(n_tokens, n_docs).

    Rows (n_tokens, n_docs, docs_ge, tokens_ge, truncated_total, share_le): documents of that length;
    documents and tokens of that length or more; tokens left when every document is cut at n_tokens;
    share of documents that are not longer. The histogram has a row for each length that occurs, which
    the longest document bounds and not the corpus. Suffix sums are taken in blocks of lengths and then
    over the blocks, so no task sorts all lengths. An empty table gives no rows; a null length is left out.
    """
    rows = counts.filter("n_tokens IS NOT NULL").withColumn("block", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", zero(F.sum("d").over(above)).alias("d_up"), zero(F.sum("t").over(above)).alias("t_up"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", F.sum("n_docs").over(inside).alias("d_in"), F.sum(tokens).over(inside).alias("t_in")).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_up"), F.col("t_in") + F.col("t_up")
    return out.select(
        "n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"),
        (F.col("all_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_total"),
        ((F.col("all_docs") - docs_ge + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
    )


def truncated_totals(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (context, kept_tokens) for each context limit in limits(context): tokens left if documents are cut there.

    A limit looks up the next length that occurs: documents of that length or more give the limit each, the others all that they
    have, and both numbers stand in that length's suffix sums. Limits and lengths are put in one order, in ranges of lengths, so
    neither joins the whole of the other. Beyond the longest length all tokens stay; an empty histogram gives 0."""
    lengths = histogram.select(F.col("n_tokens").alias("at"), "docs_ge", "tokens_ge", F.lit(None).cast("long").alias("context"))
    none = F.lit(None).cast("long")
    asked = limits.filter("context IS NOT NULL").select(F.col("context").cast("long")).distinct().select(F.col("context").alias("at"), none.alias("docs_ge"), none.alias("tokens_ge"), "context")
    rows = lengths.unionByName(asked).withColumn("block", F.floor(F.col("at") / 1024))
    found = F.struct("docs_ge", "tokens_ge")
    seen = F.when(F.col("context").isNull(), found)
    heads = rows.filter("context IS NULL").groupBy("block").agg(F.min_by(found, "at").alias("head"))
    blocks = rows.select("block").distinct().join(heads, "block", "left")
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select("block", F.first("head", ignorenulls=True).over(later).alias("after"))
    # of a limit and a length that are equal, the length comes later, so that the limit finds it
    next_ = F.first(seen, ignorenulls=True).over(Window.partitionBy("block").orderBy("at", F.col("context").isNull()).rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", next_).filter("context IS NOT NULL").join(blocks, "block").withColumn("next", F.coalesce("next", "after"))
    total = histogram.agg(F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("all"))
    rows = rows.join(F.broadcast(total), F.lit(True))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("context", (F.col("all") - zero(F.col("next.tokens_ge")) + zero(F.col("next.docs_ge")) * F.col("context")).alias("kept_tokens"))


def token_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Rows (share, n_tokens): the smallest length that at least that share of the documents does not exceed."""
    return histogram.agg(*[F.min(F.when(F.col("share_le") >= q, F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(str(i)).alias("n_tokens")) for i, q in enumerate(shares)])).alias("x")
    ).select("x.*")


def token_histogram(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``length_histogram`` of the whole texts of docs; only the text column is looked at."""
    counts = token_lengths(docs, path or vocabulary_path()).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    return length_histogram(Scratch(spark, "token-histogram").save(counts, "counts"))
