"""Embedding near-dedup: PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the principal axes of the whole table, largest first.
Within a label they are sorted by cells of the leading axes and cut into tiles, which keep their ranges on
these axes and their centre. A cell is as wide as the largest distance that reaches the threshold, so a tile
is joined with those of its own and the neighbouring cells only; of these, two tiles meet if the gaps of their
ranges and the distance of their centres, less their radii, allow the threshold. When two tiles meet, the products of
the leading axes are added up first; what the remaining axes can add is bounded by the product of the
two suffix norms, and rows and columns that cannot reach the threshold any more are dropped before the
next axes. The pairs that are left are compared by cosine in double precision of the given numbers.

Equal vectors are put together first and counted, so a hot vector costs one row. Tiles give sums of
links and, for each class of their vectors, links that connect it; pairs are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, local_components

#: Vectors in a tile.
TILE = 512
#: Leading axes whose cells order the vectors.
CELLS = 3
#: Axes whose products are added up before each bound.
AXES = (8, 16, 32)
#: Rounding that the bounds allow for.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of packed vectors of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def packed_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, v) for each row: vectors that can be compared, as bytes of doubles; v is null for the others. Labels become text."""

    def pack(batches):
        for batch in batches:
            lists = batch.column("embedding")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            ends = np.r_[0, np.cumsum(n)]
            bad, some = (np.r_[0, np.cumsum(x)] for x in (~np.isfinite(values), values != 0))
            ids = pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False) & pc.is_valid(batch.column("label")).to_numpy(zero_copy_only=False)
            good = ids & (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            flags = pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
            v = pa.Array.from_buffers(pa.binary(), len(n), [flags, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(n, pa.int32()), v], ["vec_id", "label", "dim", "v"])

    return rows.select(F.col("vec_id").cast("long"), label_text(rows).alias("label"), F.col("embedding").cast("array<double>")).mapInArrow(pack, "vec_id long, label string, dim int, v binary")


def label_text(rows: DataFrame) -> Column:
    """A label of any type as text, so that equal labels and no others have equal texts."""
    kind = rows.schema["label"].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col("label") + F.lit(0.0)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex("label")
    return F.to_json(F.struct("label")) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.col("label").cast("string")


def scaled(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension that occurs, the eigenvectors of all vectors' second moments, largest first."""

    def moments(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = scaled(matrix(batch.column("v").filter(pa.array(dims == d))))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([(x.T @ x).ravel().tolist()], pa.list_(pa.float64()))], ["dim", "m"])

    parts = vectors.select("dim", "v").mapInArrow(moments, "dim int, m array<double>")
    sums = parts.select("dim", F.posexplode("m").alias("at", "x")).groupBy("dim", "at").agg(F.sum("x").alias("x"))
    table = sums.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))  # dim^2 numbers
    axes = {}
    for row in table.toLocalIterator():
        m = np.array([x["x"] for x in row["m"]]).reshape(row["dim"], row["dim"])
        axes[row["dim"]] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def tiles(ones: DataFrame, axes: dict[int, np.ndarray], near: float) -> DataFrame:
    """Tiles of one label and dimension, cut from the order of cells on the leading axes: packed keys, copies and vectors, centre, radius and ranges of cells."""

    def leading(v: np.ndarray, d: int) -> np.ndarray:
        x = scaled(v) @ axes[d][:, :CELLS]
        return np.pad(x, ((0, 0), (0, CELLS - x.shape[1])))

    def place(batches):
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros((batch.num_rows, CELLS))
            for d in np.unique(dims).tolist():
                at = dims == d
                out[at] = leading(matrix(batch.column("v").filter(pa.array(at))), d)
            cells = np.floor(out / near).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(CELLS)], pa.array(out[:, 0])], [*batch.schema.names, *names, "lead"])

    def cut(batches):
        held: dict = {}
        for batch in batches:
            for key, n, label, dim, v in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "label", "dim", "v")), strict=True):
                if held and (len(held["keys"]) == TILE or held["of"] != (label, dim)):
                    yield tile(held)
                    held = {}
                held = held or {"of": (label, dim), "keys": [], "n": [], "v": []}
                held["keys"].append(key)
                held["n"].append(n)
                held["v"].append(v)
        if held:
            yield tile(held)

    def tile(held):
        label, dim = held["of"]
        v = np.frombuffer(b"".join(held["v"]), np.float64).reshape(-1, dim)
        x, at = scaled(v), leading(v, dim)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        keys = np.array(held["keys"], np.int64)
        low, high = at.min(axis=0) - SLACK, at.max(axis=0) + SLACK
        listed = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
        return pa.RecordBatch.from_pydict({
            "label": [label], "dim": pa.array([dim], pa.int32()), "tile": pa.array([int(keys.min())], pa.int64()), "keys": [keys.tobytes()], "n": [np.array(held["n"], np.int64).tobytes()], "v": [v.tobytes()],
            "centre": listed(centre, pa.float64()), "radius": [radius], "low": listed(low, pa.float64()), "high": listed(high, pa.float64()),
            "first": listed(np.floor(low / near).astype(int), pa.int64()), "last": listed(np.floor(high / near).astype(int), pa.int64()),
        })

    names = [f"cell{k}" for k in range(CELLS)]
    ranked = ones.mapInArrow(place, "key long, n long, label string, dim int, v binary, " + ", ".join(f"{c} int" for c in names) + ", lead double")
    order = ["label", "dim", *names, "lead", "key"]
    kind = "label string, dim int, tile long, keys binary, n binary, v binary, centre array<double>, radius double, low array<double>, high array<double>, first array<long>, last array<long>"
    return ranked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, kind)


def tile_pairs(cut: DataFrame, near: float) -> DataFrame:
    """(label, dim, tile, tile2): pairs of tiles, each once, whose ranges and centres lie near enough. Equi-join on cells of two axes:
    one side has all cells that its ranges touch, the other their neighbours too; the lowest common cell counts."""
    spread = lambda k, more: F.explode(F.sequence(F.get("first", F.lit(k)) - more, F.get("last", F.lit(k)) + more))
    side = cut.select("label", "dim", "tile", "centre", "radius", "low", "high", "first", "last")
    one = side.withColumn("i", spread(0, 0)).withColumn("j", spread(1, 0))
    two = side.withColumn("i", spread(0, 1)).withColumn("j", spread(1, 1)).select("label", "dim", "i", "j", *[F.col(c).alias(f"{c}2") for c in side.columns[2:]])
    lowest = lambda c, k: F.col(c) == F.greatest(F.get("first", F.lit(k)), F.get("first2", F.lit(k)) - 1)
    gap = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    apart = length(F.zip_with("centre", "centre2", lambda x, y: x - y)) - F.col("radius") - F.col("radius2")
    met = one.join(two, ["label", "dim", "i", "j"]).filter((F.col("tile") <= F.col("tile2")) & lowest("i", 0) & lowest("j", 1))
    return met.filter((length(gap) <= near) & (apart <= near)).select("label", "dim", "tile", "tile2")


def links_of(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of a, row of b) with cosine >= threshold."""
    x, y = scaled(a) @ axes, scaled(b) @ axes
    ends = [k for k in AXES if k < x.shape[1]] + [x.shape[1]]
    i, j, sums, start, dense = np.arange(len(x)), np.arange(len(y)), np.zeros((len(x), len(y))), 0, True
    for end in ends:
        if dense:
            sums = sums + x[i, start:end] @ y[j, start:end].T
            bound = sums + np.sqrt((x[i, end:] ** 2).sum(axis=1))[:, None] * np.sqrt((y[j, end:] ** 2).sum(axis=1))[None, :]
            can = bound >= threshold - SLACK
            rows, columns = can.any(axis=1), can.any(axis=0)
            if can.sum() * 20 < can.size:  # few pairs are left: go on pair by pair
                p, q = np.nonzero(can)
                i, j, sums, dense = i[p], j[q], sums[p, q], False
            else:
                i, j, sums = i[rows], j[columns], sums[np.ix_(rows, columns)]
        else:
            sums = sums + np.einsum("ij,ij->i", x[i, start:end], y[j, start:end])
            bound = sums + np.sqrt((x[i, end:] ** 2).sum(axis=1) * (y[j, end:] ** 2).sum(axis=1))
            can = bound >= threshold - SLACK
            i, j, sums = i[can], j[can], sums[can]
        start = end
    if dense:
        p, q = np.nonzero(sums >= threshold - SLACK)
        i, j = i[p], j[q]
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        u, v = a[i[s : s + 100_000]], b[j[s : s + 100_000]]
        top = np.abs(u).max(axis=1, keepdims=True), np.abs(v).max(axis=1, keepdims=True)
        u, v = u / top[0], v / top[1]
        cosine = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
        keep[s : s + 100_000] = cosine >= threshold
    return i[keep], j[keep]


def meet(axes: dict[int, np.ndarray], threshold: float):
    """For rows with two tiles (the same one twice counts once): links of each vector, and links that connect its class."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                a, b = (np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]) for c in ("v", "w"))
                keys, other = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["others"], np.int64)
                n, m = np.frombuffer(row["n"], np.int64), np.frombuffer(row["m"], np.int64)
                i, j = links_of(a, b, axes[row["dim"]], threshold)
                if row["tile"] == row["tile2"]:
                    i, j = i[i != j], j[i != j]
                    links = np.bincount(i, weights=n[j], minlength=len(keys)).astype(np.int64)
                    label, every = local_components(len(keys), i, j), keys
                else:
                    links = np.r_[np.bincount(i, weights=m[j], minlength=len(keys)), np.bincount(j, weights=n[i], minlength=len(other))].astype(np.int64)
                    label, every = local_components(len(keys) + len(other), i, j + len(keys)), np.r_[keys, other]
                some = links > 0
                if some.any():
                    yield pa.RecordBatch.from_pydict({"key": every[some], "links": links[some], "with": every[label][some]})

    return run


def embedding_near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links between vectors of one label with cosine >= threshold, as one row for each vector.

    Rows (vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label), whatever their
    order. Vectors that are null, empty or zero, or hold null or non-finite components, and vectors with a null
    label or vec_id, have no links and are their own class. Vectors of different lengths are not compared. Rows
    that repeat a vec_id are vectors of their own: each has its row, links with its namesakes count, and a
    class is named by the smallest vec_id in it. Labels of any type are compared as they are. Other columns are not
    looked at; an empty table gives no rows. A null vec_id has a null component_id and is kept.
    """
    scratch = Scratch(spark, "embeddings")
    given = scratch.save(packed_vectors(vectors), "vectors")
    ones = given.filter("v IS NOT NULL").groupBy("label", "dim", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    ones = scratch.save(ones.withColumn("key", F.monotonically_increasing_id()), "ones")  # the written key stays
    axes = principal_axes(ones)
    near = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6  # largest distance of unit vectors that reach the threshold
    cut = scratch.save(tiles(ones.select("key", "n", "label", "dim", "v"), axes, near), "tiles")
    first = cut.select("tile", "label", "dim", "keys", "n", "v")
    second = cut.select(F.col("tile").alias("tile2"), "label", "dim", F.col("keys").alias("others"), F.col("n").alias("m"), F.col("v").alias("w"))
    both = tile_pairs(cut, near).join(first, ["label", "dim", "tile"]).join(second, ["label", "dim", "tile2"])
    found = scratch.save(both.repartition("tile", "tile2").mapInArrow(meet(axes, threshold), "key long, links long, with long"), "links")
    scratch.drop("tiles")
    label = components(spark, scratch, found.selectExpr("key AS a", "with AS b")).withColumnRenamed("node", "key")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ones = ones.join(links, "key", "left").join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = ones.groupBy("component").agg(F.min("vec_id").alias("class"))
    ones = ones.join(least, "component").select("label", "dim", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class")
    out = given.join(ones, ["label", "dim", "v"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
