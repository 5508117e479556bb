"""Lists of Arrow columns as flat NumPy arrays, so that a step takes all sentences of a part at once.

A part has a bounded number of rows and list elements whatever the size of a batch, and with it a Python worker's memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.functions.fixed import PHRASE_RELATIONS

#: Rows of a part; sentences have at most a few hundred tokens.
PART = 2_000


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def plain(column: pa.Array) -> pa.Array:
    """Strings with offsets of 32 bits, as Spark sends them unless it is told otherwise."""
    return column if column.type == pa.string() else pc.cast(column, pa.string())


def member(structs: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(structs, structs.type.get_field_index(name))


def numbers(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(pc.cast(column, pa.int64()), missing).to_numpy(zero_copy_only=False)


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each list starts among all elements, and the end of the last one."""
    return np.r_[0, np.cumsum(counts)]


def places(counts: np.ndarray) -> np.ndarray:
    """The place of each element in its list, from 0."""
    starts = starts_of(counts)
    return np.arange(starts[-1]) - np.repeat(starts[:-1], counts)


def list_of(counts: np.ndarray, values: pa.Array, mask: np.ndarray | None = None) -> pa.Array:
    """Lists of the given lengths; null where ``mask`` is true."""
    return pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), values, mask=None if mask is None or not mask.any() else pa.array(mask))


def struct_of(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def int32(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def cut(texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """For each row number its text's characters from start up to end."""
    size = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[size[0] : size[-1]]
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, size - size[0])
    chars = np.r_[chars, len(data)]
    most = np.diff(first)[row]
    start = np.clip(start, 0, most)
    end = np.clip(end, start, most)
    begin, counts = chars[first[row] + start], chars[first[row] + end] - chars[first[row] + start]
    out = data[np.arange(counts.sum()) + np.repeat(begin - starts_of(counts)[:-1], counts)]
    return pa.StringArray.from_buffers(len(row), pa.py_buffer(starts_of(counts).astype(np.int32)), pa.py_buffer(out))


@dataclass
class Sentences:
    """Annotated sentences of a part, without those that lack a text, tokens or edges: tokens and edges of all in turn.

    A token's number in its sentence is its place there, from 1. Edges have ``row``; ends that are missing are -1."""

    batch: pa.RecordBatch
    tokens: np.ndarray
    edges: np.ndarray
    words: pa.Array
    row: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    label: pa.Array

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Sentences:
        whole = pc.and_(pc.and_(batch.column("text").is_valid(), batch.column("tokens").is_valid()), batch.column("edges").is_valid())
        if not pc.all(whole).as_py():
            batch = batch.filter(whole)
        tokens, edges = lengths(batch.column("tokens")), lengths(batch.column("edges"))
        es = batch.column("edges").flatten()
        words = plain(member(batch.column("tokens").flatten(), "word"))
        return cls(batch, tokens, edges, words, np.repeat(np.arange(len(edges)), edges), numbers(member(es, "tail"), -1), numbers(member(es, "head"), -1), plain(member(es, "label")))

    def starts(self) -> np.ndarray:
        return starts_of(self.tokens)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token whether it is nested, and the first and last token of its phrase among all tokens."""
        base, most = self.starts()[self.row] - 1, self.tokens[self.row]
        inside = pc.fill_null(pc.is_in(self.label, pa.array(PHRASE_RELATIONS)), False).to_numpy(zero_copy_only=False) & (self.head >= 1) & (self.head <= most)
        nested = np.zeros(len(self.words), bool)
        nested[(base + self.head)[inside & (self.tail != 0)]] = True
        first, last = np.arange(len(self.words)), np.arange(len(self.words))
        inside &= (self.tail >= 1) & (self.tail <= most)
        over, of = (base + self.tail)[inside], (base + self.head)[inside]
        np.minimum.at(first, over, of)
        np.maximum.at(last, over, of)
        return nested, first, last

    def wordings(self, at: np.ndarray, nested: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """What the tokens at these places among all tokens say: their phrase, or their own word if they are nested."""
        ts = self.batch.column("tokens").flatten()
        start, end = numbers(member(ts, "start"), 0), numbers(member(ts, "end"), 2**31 - 1)
        said = cut(plain(self.batch.column("text")), np.repeat(np.arange(len(self.tokens)), self.tokens)[at], start[first[at]], end[last[at]])
        return pc.if_else(pa.array(nested[at]), self.words.take(pa.array(at)), said) if nested[at].any() else said


@dataclass
class Walks:
    """Shortest paths from the roots of many graphs, of equally short ones the smallest: nodes in the order of (row, node),
    with ``parent`` as place among them and ``depth``, both -1 for nodes without a path."""

    row: np.ndarray
    node: np.ndarray
    parent: np.ndarray
    depth: np.ndarray

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the nodes that have a path, the lengths of these, and the nodes of all paths in turn."""
        at = np.flatnonzero(self.depth >= 0)
        counts = self.depth[at] + 1
        out, last, cur = np.empty(counts.sum(), np.int64), np.cumsum(counts) - 1, at
        while len(cur):
            out[last] = self.node[cur]
            more = self.parent[cur] >= 0
            cur, last = self.parent[cur][more], last[more] - 1
        return at, counts, out


def walks(row: np.ndarray, tail: np.ndarray, head: np.ndarray, rows: int) -> Walks:
    """Breadth first from node 0 of every row at once, level by level. Nodes of a level are in the order of their paths, so the
    first edge that leads to a node is on its smallest path."""
    known = (tail >= 0) & (head >= 0)
    row, tail, head = row[known], tail[known], head[known]
    width = int(max(tail.max(initial=0), head.max(initial=0))) + 1
    keys, place = np.unique(np.r_[np.arange(rows) * width, row * width + tail, row * width + head], return_inverse=True)
    roots, tail, head = place[:rows], place[rows : rows + len(row)], place[rows + len(row) :]
    order = np.lexsort((head, tail))
    head, begin = head[order], np.searchsorted(tail[order], np.arange(len(keys) + 1))
    parent, depth = np.full(len(keys), -1), np.full(len(keys), -1)
    depth[roots] = 0
    level, k = roots, 0
    while len(level):
        k += 1
        counts = begin[level + 1] - begin[level]
        nxt = head[np.repeat(begin[level], counts) + places(counts)]
        by = np.repeat(level, counts)
        new = depth[nxt] < 0
        nxt, by = nxt[new], by[new]
        _, at = np.unique(nxt, return_index=True)
        at.sort()
        level = nxt[at]
        parent[level], depth[level] = by[at], k
    return Walks(keys // width, keys % width, parent, depth)
