"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens, and the pieces go to shards of a bounded number
of pieces. Within a shard, best fit places pieces from the longest to the shortest; then local search works on
all underfull sequences, from the fullest to the emptiest: each takes a piece from less full ones, or exchanges
one for one, one for two or two for one with them, so that it becomes as full as it can. Every step
raises the sum of squared fills, so it ends; what is missing gathers in the emptiest sequences until they are
empty. Sequences that are not full then meet those of other shards, in as few groups of a bounded number of
pieces as hold them, and so on while rounds empty sequences and a lower bound is not reached.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_parts
from .tokens import part_ids, vocabulary_path

#: Pieces packed together at most on average.
SHARD = 30_000
#: A round over shards must empty this share of the sequences in it, or it is the last.
GAIN = 1e-4


def pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids, then ``end``, cut where they exceed capacity."""
    def cut(batches):
        encode = part_ids(path)
        for batch in in_parts(batches):
            ids, starts = encode.of(batch.column("text"))
            # the ids of all documents with the end after each, and what a document has of them
            ids = np.insert(ids, starts[1:], end).astype("<u4")
            first, size = starts[:-1] + np.arange(len(starts) - 1), np.diff(starts) + 1
            many = -(-size // capacity)
            own = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, size[own] - start)
            view, at = memoryview(ids).cast("B"), (first[own] + start) * 4
            crc = [zlib.crc32(view[i:j]) for i, j in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; each piece, longest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of pieces in the order given; a mixed start, from which local search often gets further than from the sorted one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


def bins_needed(lengths: list[int], capacity: int) -> int:
    """A number of bins that every packing needs: by the sum, and for each k by pieces over half, which never share a bin,
    and the room that they leave to pieces from k to half (the bound of Martello and Toth)."""
    count = np.bincount(lengths, minlength=capacity + 1)
    half, n, total = capacity // 2, np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(half + 1)
    large, middle = n[capacity] - n[capacity - k], n[capacity - k] - n[half]
    room = middle * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    return int((large + middle + np.maximum(0, -(-(small - room) // capacity))).max())


class Pool:
    """Pieces of sequences that are less full than the one in hand, by length. Bit n of ``mask`` tells that there is one of
    length n, and bit capacity - n of ``mirror`` too, so that one shift and one AND find two that add up to a number."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.mask, self.mirror = lengths, capacity, 0, 0
        self.of: dict[int, list[int]] = {}
        self.count: dict[int, int] = {}
        self.free = [False] * len(lengths)

    def put(self, i: int) -> None:
        n = self.lengths[i]
        self.free[i] = True
        self.of.setdefault(n, []).append(i)
        self.count[n] = self.count.get(n, 0) + 1
        self.mask |= 1 << n
        self.mirror |= 1 << self.capacity - n

    def leave(self, i: int) -> None:
        n = self.lengths[i]
        self.free[i] = False
        self.count[n] -= 1
        if not self.count[n]:
            self.mask &= ~(1 << n)
            self.mirror &= ~(1 << self.capacity - n)

    def last(self, n: int, skip: int | None = None) -> int:
        """A piece of length n, or the next one; those that left are forgotten."""
        while not self.free[self.of[n][-1]]:
            self.of[n].pop()
        return next(x for x in reversed(self.of[n]) if self.free[x] and x != skip) if skip is not None else self.of[n][-1]

    def two(self, n: int) -> tuple[int, int] | None:
        """Lengths of two pieces that add up to n."""
        found = self.mask & (self.mirror >> self.capacity - n)
        if n % 2 == 0 and self.count.get(n // 2, 0) < 2:
            found &= ~(1 << n // 2)
        if not found:
            return None
        a = (found & -found).bit_length() - 1
        return a, n - a


def lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def steps(lengths: list[int], own: list[int], room: int, pool: Pool):
    """Steps of a sequence, those that fill the most of its room first: pieces that it gives and lengths that it takes."""
    by_length = {}
    for i in own:
        by_length.setdefault(lengths[i], []).append(i)
    ones = sum(1 << n for n in by_length)
    twos = 0
    for n, held in by_length.items():
        twos |= (ones if len(held) > 1 else ones & ~(1 << n)) << n
    for gain in range(room, 0, -1):
        if pool.mask >> gain & 1:
            yield (), (gain,)
        if pair := pool.two(gain):
            yield (), pair
        if hit := ones << gain & pool.mask:
            take = lowest(hit)
            yield (by_length[take - gain][0],), (take,)
        if hit := twos << gain & pool.mask:
            take = lowest(hit)
            x = next(n for n in by_length if take - gain - n in by_length and (take - gain != 2 * n or len(by_length[n]) > 1))
            y = by_length[take - gain - x]
            yield (by_length[x][0], y[-1]), (take,)
        for n, held in by_length.items():
            if pair := pool.two(n + gain):
                yield (held[0],), pair


def search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search over all bins that are not full, while it empties some and there are more than every packing needs."""
    need, bins, live = bins_needed(lengths, capacity), [list(b) for b in bins if b], len(bins)
    emptied = live > need
    while emptied and live > need:
        emptied = False
        fill = [sum(lengths[i] for i in b) for b in bins]
        home = {i: b for b, own in enumerate(bins) for i in own if fill[b] < capacity}
        heap = [(-f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        heap.sort()
        pool = Pool(lengths, capacity)
        for _, b in heap:  # the emptiest last, so that it gives first
            for i in bins[b]:
                pool.put(i)
        while heap and live > need:
            f, b = heapq.heappop(heap)
            if -f != fill[b] or not fill[b] or not all(pool.free[i] for i in bins[b]):
                continue  # it has changed since, or had its turn
            for i in bins[b]:
                pool.leave(i)
            while fill[b] < capacity:
                done = next((d for d in (exchange(lengths, bins, fill, home, pool, b, *s, capacity) for s in steps(lengths, bins[b], capacity - fill[b], pool)) if d), None)
                if done is None:
                    break
                for donor in done:
                    if fill[donor]:
                        heapq.heappush(heap, (-fill[donor], donor))
                    else:
                        live, emptied = live - 1, True
        bins = [b for b in bins if b]
    return bins


def exchange(lengths, bins, fill, home, pool: Pool, b: int, give: tuple[int, ...], take: tuple[int, ...], capacity: int) -> list[int] | None:
    """Give pieces of bin b for pieces of the pool of these lengths, if they fit and the sum of squared fills rises; the donors."""
    taken = [pool.last(take[0])]
    if len(take) > 1:
        taken.append(pool.last(take[1], taken[0]) if take[0] == take[1] else pool.last(take[1]))
    donors = sorted({home[i] for i in taken}, key=lambda d: -fill[d])
    after = {d: fill[d] - sum(lengths[i] for i in taken if home[i] == d) for d in donors}
    back = sum(lengths[i] for i in give)
    to = next((d for d in donors if after[d] + back <= capacity), None)
    if to is None:
        return None
    after[to] += back
    new = fill[b] - back + sum(take)
    if new * new - fill[b] * fill[b] + sum(after[d] ** 2 - fill[d] ** 2 for d in donors) <= 0:
        return None
    for i in taken:
        bins[home[i]].remove(i)
        bins[b].append(i)
        home[i] = b
        pool.leave(i)
    for i in give:
        bins[b].remove(i)
        bins[to].append(i)
        home[i] = to
        pool.put(i)
    fill[b] = new
    for d in donors:
        fill[d] = after[d]
    return donors


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit, then local search; if that leaves more bins than the bound, local search from a mixed start too, and the fewer bins."""
    bins = search(lengths, best_fit(lengths, capacity), capacity)
    if len(bins) > bins_needed(lengths, capacity):
        bins = min(bins, search(lengths, next_fit(lengths, capacity), capacity), key=len)
    return bins


def pack_shard(capacity: int, turn: int):
    """Place all pieces of one shard: by best fit in the first turn, else as they are, then by local search. Gives sequence_id, offset and fill."""

    def pack(table: pa.Table) -> pa.Table:
        keys = [table.column(c).to_numpy() for c in ("ids_crc32", "start")] + [table.column("doc_id").fill_null(-1).to_numpy()]
        table = table.take(np.lexsort(keys))
        lengths = table.column("length").to_pylist()
        if turn:
            own: dict[int, list[int]] = {}
            for i, s in enumerate(table.column("sequence_id").to_pylist()):
                own.setdefault(s, []).append(i)
            bins = search(lengths, [own[s] for s in sorted(own)], capacity)
        else:
            bins = pack_lengths(lengths, capacity)
        at, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for b, own_ in enumerate(bins):
            place = 0
            for i in own_:
                at[i], offset[i] = b, place
                place += lengths[i]
            fill[own_] = place
        base = (turn << 56) | (table.column("shard")[0].as_py() << 32)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(at + base)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return pack


def best_fit_packing(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``capacity`` tokens.

    Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece. A null text
    counts as empty and gives the end id alone. Only a document longer than capacity is cut; a text of any length is
    read whole. Rows that repeat a doc_id, and a null doc_id, are packed like any other. Pieces of equal length are
    alike: which of them goes where follows their ids and starts within a shard. Other columns are not looked at; an
    empty table gives no rows. Lengths are whole numbers, so nothing of a sequence is lost between pieces.
    """
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, path or vocabulary_path(), capacity, end), "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    # the number of a written row is the same in every attempt, and deals equal rows to all shards
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(pack_shard(capacity, 0), kind)
    if shards == 1:
        return packed.drop("fill")
    full, turn, before = [], 0, None
    while True:
        packed = scratch.save(packed, f"turn{turn}")
        sequences, tokens, left = packed.agg(F.count_if(F.col("offset") == 0), F.sum("length"), F.count_if(F.col("fill") < capacity)).first()
        if sequences <= -(-(tokens or 0) // capacity) or not left or before is not None and before - sequences <= GAIN * before:
            break
        full.append(packed.filter(F.col("fill") == capacity))
        underfull = packed.filter(F.col("fill") < capacity)
        before, turn = underfull.filter("offset = 0").count(), turn + 1
        underfull = underfull.drop("offset", "fill").withColumn("shard", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(-(-left // SHARD))))
        packed = underfull.groupBy("shard").applyInArrow(pack_shard(capacity, turn), kind)
    for rows in full:
        packed = packed.union(rows)
    return packed.drop("fill")
