"""What the operators share: scratch tables, word hashes, packed rows and connected components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers, one for each place in a window of words.
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(1, 65)], dtype=U64)


#: Allocations of glibc from this size on are mapped by themselves, and as much free memory at the end of its heap goes back.
MAPPED = 1 << 20


def return_memory() -> None:
    """From now on, memory that this process frees goes back to the system. Spark keeps Python workers between tasks and stages, and what
    allocators hold for later in each of them counts as the executor's: up to some 200 MB a worker, whatever stage runs. Another C library
    than glibc is left as it is."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None) if sys.platform == "linux" else None
    if mallopt:
        mallopt(-1, MAPPED)  # M_TRIM_THRESHOLD
        mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD; set, it does not grow with what is freed


if TaskContext.get() is not None:  # in a Python worker, which imports this module for its first task
    return_memory()


class Scratch:
    """Tables of one operator run below the shared folder that ``spark.checkpoint.dir`` names.

    Writing a table cuts the lineage: a later loss of an executor rereads files instead of
    repeating the stages before them. Where the setting is missing, one process (tests) takes a temporary
    folder, and a cluster gets an error. ``drop`` removes tables that nothing reads any more, and
    ``drop_all`` the tables of all runs of this process, once their results are not needed.
    """

    folders: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="factloom-")
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.folders.append(self.path)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.spark, f"{self.path}/{name}")

    @classmethod
    def drop_all(cls, spark: SparkSession) -> None:
        while cls.folders:
            cls._remove(spark, cls.folders.pop())

    @staticmethod
    def _remove(spark: SparkSession, path: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of all texts in turn: their numbers, where each text's words start (and the last ends),
    and the distinct words. A-Z folds if ``lower``. Work on words is then done once for each distinct one of a part."""
    if texts.type != pa.string():
        texts = pc.cast(texts, pa.string())
    column = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a text without words gives one empty word
    if not some.all():
        flat, starts = flat.filter(pa.array(some)), np.r_[0, np.cumsum(some)][starts]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), starts, coded.dictionary


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, by their bytes, and where each text's words start."""
    codes, starts, words = word_codes(texts, lower)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pc.cast(words, pa.binary()).to_pylist()), U64, len(words))[codes], starts


def pair_of_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as two rows."""
    digests = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.frombuffer(digests, ">u8").reshape(-1, 2).T.astype(U64)


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, with both hashes of ``pair_of_hashes``."""
    codes, starts, words = word_codes(texts)
    return pair_of_hashes(pc.cast(words, pa.binary()).to_pylist())[:, codes], starts


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    return pc.cast(column, pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, so that each bit of the result depends on each bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def windows(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive words, given the words' hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:n] * ODD[0] + U64(seed)
        for i in range(1, k):
            out += words[i : i + n] * ODD[i]
    return mix(out)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each hash; the multiplication keeps it independent of the hashes' order."""
    with np.errstate(over="ignore"):
        return ((hashes * U64(0xD6E8FEB86659FD93)) >> U64(33)) % U64(buckets)


def power_of_two(x: float, least: int, most: int = 1 << 20) -> int:
    return int(min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(x, 1))))))))


def packed(buckets: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Rows (bucket, bytes of each column) of entries put together by bucket."""
    order = np.argsort(buckets, kind="stable")
    ids, starts = np.unique(buckets[order], return_index=True)
    ends = np.r_[starts[1:], len(order)][: len(starts)]
    columns = [c[order] for c in columns]
    for b, i, j in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        yield b, [c[i:j].tobytes() for c in columns]


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """The entries of all rows of a packed column."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=dtype)


def in_parts(batches: Iterable[pa.RecordBatch], limit: int = 8_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about ``limit`` bytes of text each (one text may be longer)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if j > i:
                yield batch.slice(i, j - i)


def texts_in_parts(batches: Iterable[pa.RecordBatch], limit: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """``in_parts``, each with its texts as bytes."""
    for batch in in_parts(batches, limit):
        yield batch, byte_texts(batch.column(batch.schema.get_field_index("text")))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member's index for each of n nodes, under links (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(spark: SparkSession, scratch: Scratch, links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of links (a, b): the smallest node that links reach.

    Each round replaces every node by its smallest neighbour, itself included, and keeps the
    pointers; links inside a replaced node vanish. Pointers only fall, so at most as many rounds
    are needed as doublings of the longest path. At the end the pointers are followed from the last
    round to the first. Every step is a partially aggregated groupBy or an equi-join; a node with
    very many links is only the probed side of a join with one row for each key.
    """
    edges = scratch.save(links.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links0")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(pointers)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = scratch.save(both.groupBy("a").agg(F.min("b").alias("low")).selectExpr("a AS node", "least(a, low) AS low"), f"points{k}")
        pointers.append(point)
        moved = (
            edges.join(point.withColumnRenamed("node", "a").withColumnRenamed("low", "x"), "a")
            .join(point.withColumnRenamed("node", "b").withColumnRenamed("low", "y"), "b")
            .filter("x <> y")
            .selectExpr("greatest(x, y) AS a", "least(x, y) AS b")
            .distinct()
        )
        edges = scratch.save(moved, f"links{k + 1}")
    if not pointers:
        return spark.createDataFrame([], "node long, component long")
    label = pointers[-1].withColumnRenamed("low", "component")
    for point in reversed(pointers[:-1]):
        up = label.withColumnRenamed("node", "low").withColumnRenamed("component", "up")
        label = point.join(up, "low", "left").selectExpr("node", "coalesce(up, low) AS component")
    return label


def in_ranges(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """Adds ``bucket``, the number of one of about ``parts`` ranges of an integer column without nulls, in ascending order.

    Ranges are cut at approximate quantiles: at most 256 coarse ones, whose boundaries the driver holds, and in
    each up to 512 fine ones in a table of one row for each coarse range, at most 1 MB, that is broadcast. Quantiles
    are of the distance to the least value of a range, so neither an outlying value nor values that fill all
    64 bits leave the ranges uneven. Evenness is approximate, the order is not."""
    first = min(256, max(1, parts))

    def quantiles(n: int, low: Column) -> Column:
        distance = F.col(column).cast("decimal(20,0)") - low.cast("decimal(20,0)")
        return F.percentile_approx(distance.cast("double"), F.array(*[F.lit(i / n) for i in range(1, n)] or [F.lit(1.0)]), 16 * n)

    least = rows.agg(F.min(column)).first()[0]
    found = rows.agg(quantiles(first, F.lit(least))).first()[0] if least is not None else None
    lows = [least or 0, *sorted({min(least + int(d), 2**63 - 1) for d in found or []} - {least})]
    second = min(512, max(1, -(-parts // len(lows))))  # more of them if few coarse boundaries differ
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    coarse = rows.withColumn("coarse", F.size(F.filter(longs(lows), lambda v: v <= F.col(column))) - 1)
    low = F.get(longs(lows), F.col("coarse"))
    fine = coarse.withColumn("low", low).groupBy("coarse").agg(F.min("low").alias("low"), quantiles(second, F.col("low")).alias("d"))
    fine = fine.select("coarse", F.transform("d", lambda d: (F.col("low").cast("decimal(20,0)") + d.cast("decimal(20,0)")).cast("long")).alias("cuts"))
    inside = F.size(F.filter("cuts", lambda v: v <= F.col(column)))
    return coarse.join(F.broadcast(fine), "coarse").withColumn("bucket", F.col("coarse").cast("long") * 1024 + inside).drop("coarse", "cuts")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
