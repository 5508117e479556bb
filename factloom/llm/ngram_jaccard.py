"""N-gram Jaccard join: exact set similarity join with set-relation skipping.

A document's set holds its distinct word shingles. The join takes three steps.

*Index.* Every set is ordered by one global order, rare shingles first, and only its prefix enters the
index: two sets with Jaccard similarity t share a shingle in prefixes of ``n - ceil(t n) + 1``. Sets
with the same shingles are put together first, so copies cost nothing more. The index lists are dealt
out in packed buckets, and a list's entries are ordered by (set size, position). A short list is swept by distance in
that order until no pair passes the size bound; what positions rule out is dropped. A long list is cut
into blocks of neighbouring sizes and positions, and pairs of blocks that can reach the overlap by neither are skipped whole.

*Candidates.* Short lists give pairs, whose common prefix shingles are added up and bounded. Long lists,
as near copies by the thousand make them, give no pairs: of the blocks that remain connected, all members meet at
one representative.

*Answers.* The sets that meet are compared in bounded blocks, each with the group's representative. If they resemble
it, each overlap is derived from the overlaps with the representative, which are known, and from the few
shingles in which the two sets differ from it; only the differences are multiplied out. Sets that the
representative's class takes in need no further answers, so a group of near copies takes work in proportion to
its members; only sets outside that class then meet the group's other blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, bucket_of, components, in_parts, joined, local_components, mix, packed, power_of_two, windows, word_hashes

#: Shingles counted as frequent at most; they only settle the global order, so the bound cannot change results.
FREQUENT = 100_000
#: Shingles of documents counted together; those that occur in two documents there are added up over all.
COUNTED = 4_000_000
#: Longest index list whose pairs are listed; longer ones are skipped in blocks and go by a representative. Results don't depend on it.
SHORT_LIST = 32
#: Blocks of a long list at most.
LIST_BLOCKS = 1_024
#: Sets and shingles in one block of sets that are compared with each other.
BLOCK_SETS, BLOCK_SHINGLES = 1_000, 4_000_000
#: Sets that more than this part of all documents hold are hot; there are at most as many.
HOT = 2_000
#: Most rows of document ids that are broadcast; beyond that the join is a shuffle.
BROADCAST_ROWS = 400_000


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z in lower case, words between ASCII spaces."""
    hashes, starts = word_hashes(texts, lower=True)
    whole, out = windows(hashes, k), []  # those across two texts are not used
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        n = j - i
        out.append(np.unique(whole[i : j - k + 1] if n >= k else windows(hashes[i:j], n, seed=n)) if n else np.zeros(0, U64))
    return out


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection that reaches the threshold for sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many documents hold, the most frequent ones last; all documents are counted."""

    def count(batches):
        held, size = [], 0
        for batch in in_parts(batches):
            sets = [s for s in shingle_sets(batch.column("text"), k) if len(s)]
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield repeated(held)
                held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(sets):
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_pydict({"shingle": found[n >= 2].view(np.int64), "n": n[n >= 2]})

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = rows.filter("n >= 6").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    rows = rows.sort_values(["n", "shingle"])
    return rows["shingle"].to_numpy(np.int64).view(U64)


def prefixes(docs: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, fp, rare, common): set size, fingerprint of the set, prefix as rare hashes and ranks of frequent ones."""
    by_hash = np.argsort(frequent)
    table = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash.astype(np.uint32)))

    def cut(batches):
        hashes, ranks = table.value
        for batch in in_parts(batches):
            n, fp, rare, common = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                at = np.minimum(np.searchsorted(hashes, s), max(len(hashes) - 1, 0))
                hot = hashes[at] == s if len(hashes) else np.zeros(len(s), bool)
                p = prefix_length(len(s), percent) if len(s) else 0
                cold = s[~hot][:p]
                rare.append(cold.tobytes())
                common.append(np.sort(ranks[at[hot]])[: p - len(cold)].tobytes() if len(cold) < p else b"")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()), "rare": pa.array(rare, pa.binary()), "common": pa.array(common, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, n_shingles long, fp binary, rare binary, common binary")


def index_entries(sets: DataFrame, buckets: int) -> DataFrame:
    """Packed index entries: hash, document, set size and position for each rare prefix shingle."""

    def emit(batches):
        for batch in batches:
            docs, n = batch.column("doc_id").to_numpy(), batch.column("n_shingles").to_numpy()
            rare = [np.frombuffer(x, U64) for x in batch.column("rare").to_pylist()]
            for i in range(0, len(rare), 1000):
                part = rare[i : i + 1000]
                lengths = np.array([len(x) for x in part])
                if not lengths.sum():
                    continue
                hashes = np.concatenate(part)
                own = np.repeat(np.arange(len(part)), lengths)
                position = (np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
                rows = list(packed(bucket_of(hashes, buckets), hashes, docs[i : i + 1000][own].astype(np.int64), n[i : i + 1000][own].astype(np.uint32), position))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32())} | {c: pa.array([x[j] for _, x in rows], pa.binary()) for j, c in enumerate(("hashes", "docs", "sizes", "places"))})

    return sets.select("doc_id", "n_shingles", "rare").mapInArrow(emit, "bucket int, hashes binary, docs binary, sizes binary, places binary")


def rank_of(docs: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random order of documents; the first in a list represents it."""
    return mix(docs.astype(np.int64).view(U64))


def connected_blocks(n: np.ndarray, p: np.ndarray, percent: int) -> np.ndarray:
    """For entries of one list in the order of (size, position): the number of the group of blocks that each is in.

    A block holds neighbouring entries. Two blocks are skipped if the smallest size of one is too small for the largest
    of the other, or if the shingles before and from the common one cannot add up to the overlap that the smallest sizes need."""
    cut = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (p[1:] != p[:-1])])
    if len(cut) > LIST_BLOCKS:
        cut = cut[np.arange(LIST_BLOCKS) * len(cut) // LIST_BLOCKS]
    ends = np.r_[cut[1:], len(n)]
    low, high = n[cut], n[ends - 1]
    far = np.maximum.reduceat(p, cut)
    after = np.maximum.reduceat(n - p, cut)
    most = np.minimum(far[:, None], far[None, :]) + np.minimum(after[:, None], after[None, :])
    meets = (most >= least_overlap(low[:, None], low[None, :], percent)) & (100 * high[None, :] >= percent * low[:, None]) & (100 * high[:, None] >= percent * low[None, :])
    label, left = np.full(len(cut), -1), np.ones(len(cut), bool)
    for k in range(len(cut)):
        if left[k]:
            front = np.zeros(len(cut), bool)
            front[k] = True
            while front.any():
                label[front], left[front] = k, False
                front = left & meets[front].any(axis=0)
    return np.repeat(label, ends - cut)


def list_candidates(percent: int):
    """For one bucket: pairs of short lists with their number of common prefix shingles, and (representative, member) of long lists, as pairs with n = 0."""

    def scan(table: pa.Table) -> pa.Table:
        hashes, docs = joined(table.column("hashes"), U64), joined(table.column("docs"), np.int64)
        sizes, places = joined(table.column("sizes"), np.uint32).astype(np.int64), joined(table.column("places"), np.uint32).astype(np.int64)
        order = np.lexsort((places, sizes, hashes))
        hashes, docs, sizes, places = hashes[order], docs[order], sizes[order], places[order]
        starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        length = np.diff(np.r_[starts, len(hashes)])
        of_list = np.repeat(length, length)
        found = []
        keep = (of_list > 1) & (of_list <= SHORT_LIST)
        h, d, n, p = hashes[keep], docs[keep], sizes[keep], places[keep]
        for step in range(1, SHORT_LIST):
            same = h[:-step] == h[step:] if len(h) > step else np.zeros(0, bool)
            if not same.any():
                break
            i = np.flatnonzero(same)
            j = i + step
            fits = 100 * n[i] >= percent * n[j]
            if not fits.any():
                break
            i, j = i[fits], j[fits]
            need = least_overlap(n[i], n[j], percent)
            most = np.minimum(p[i], p[j]) + np.minimum(n[i] - p[i], n[j] - p[j])
            ok = (most >= need) & (d[i] != d[j])
            found.append(np.stack([d[i][ok], d[j][ok], n[i][ok], n[j][ok]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        swap = pairs[0] > pairs[1]
        pairs[:, swap] = pairs[:, swap][[1, 0, 3, 2]]
        pairs, count = np.unique(pairs, axis=1, return_counts=True) if pairs.shape[1] else (pairs, np.zeros(0, np.int64))
        found = [pairs]
        for start, m in zip(starts[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist(), strict=True):
            d, n, p = docs[start : start + m], sizes[start : start + m], places[start : start + m]
            own = connected_blocks(n, p, percent)
            first = np.lexsort((rank_of(d), own))
            lead = first[np.flatnonzero(np.r_[True, own[first][1:] != own[first][:-1]])]
            at = np.searchsorted(own[lead], own)
            other = d[lead][at] != d
            found.append(np.stack([d[lead][at], d, n[lead][at], n])[:, other])
        if len(found) > 1:
            long = np.unique(np.concatenate(found[1:], axis=1), axis=1)
            pairs, count = np.concatenate([pairs, long], axis=1), np.r_[count, np.zeros(long.shape[1], np.int64)]
        return pa.table({"x": pairs[0], "y": pairs[1], "nx": pairs[2], "ny": pairs[3], "n": count.astype(np.int64)})

    return scan


def common_leaders(sets: DataFrame) -> DataFrame:
    """(representative, member) for the lists of frequent shingles; the representatives of at most FREQUENT lists are broadcast."""

    def least(batches):
        for batch in batches:
            ranks = [np.frombuffer(x, np.uint32) for x in batch.column("common").to_pylist()]
            own = np.repeat(np.arange(len(ranks)), [len(x) for x in ranks])
            if not len(own):
                continue
            ranks, docs = np.concatenate(ranks), batch.column("doc_id").to_numpy()
            first = np.lexsort((rank_of(docs[own]), ranks))
            first = first[np.flatnonzero(np.r_[True, ranks[first][1:] != ranks[first][:-1]])]
            d = docs[own[first]]
            yield pa.RecordBatch.from_pydict({"rank": ranks[first].astype(np.int64), "order": rank_of(d).view(np.int64), "x": d, "nx": batch.column("n_shingles").to_numpy()[own[first]]})

    held = sets.select("doc_id", "n_shingles", "common").filter("length(common) > 0")
    # the order is unsigned; flipping the sign bit keeps it under Spark's signed comparison
    lead = held.mapInArrow(least, "rank long, order long, x long, nx long").groupBy("rank").agg(F.min(F.struct((F.col("order").bitwiseXOR(F.lit(-(2**63)))).alias("order"), "x", "nx")).alias("lead"))
    rows = lead.select("rank", "lead.x", "lead.nx").toPandas().sort_values("rank")
    table = sets.sparkSession.sparkContext.broadcast((rows["rank"].to_numpy(np.int64), rows["x"].to_numpy(np.int64), rows["nx"].to_numpy(np.int64)))

    def meet(batches):
        known, x, nx = table.value
        for batch in batches:
            docs, n = batch.column("doc_id").to_numpy(), batch.column("n_shingles").to_numpy()
            out = []
            for d, m, ranks in zip(docs, n, batch.column("common").to_pylist(), strict=True):
                at = np.searchsorted(known, np.frombuffer(ranks, np.uint32).astype(np.int64))
                lead, first = np.unique(x[at], return_index=True)
                out.append(np.stack([lead, np.full(len(lead), d), nx[at][first], np.full(len(lead), m)]))
            if out:
                c = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_pydict({"x": c[0], "y": c[1], "nx": c[2], "ny": c[3]})

    return held.mapInArrow(meet, "x long, y long, nx long, ny long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. The representative is the set with the most in common with the group's frequent shingles;
    if the sets resemble it, overlaps come from what each set lacks and has beyond it."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    vocabulary, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    held = np.bincount(column, minlength=len(vocabulary))
    like = np.bincount(row, weights=held[column], minlength=m) / np.maximum(sizes, 1)
    lead = int(np.argmax(like))
    in_lead = np.zeros(len(vocabulary), bool)
    in_lead[column[row == lead]] = True
    with_lead = np.bincount(row, weights=in_lead[column], minlength=m)
    out = np.zeros((m, m), np.float32)
    if with_lead.sum() >= 0.5 * sizes.sum():
        lacks = in_lead & (held < m)
        number = np.cumsum(lacks) - 1
        absent = np.ones((m, int(lacks.sum())), bool) if m * int(lacks.sum()) <= 80_000_000 else None
        if absent is not None:
            mine = lacks[column]
            absent[row[mine], number[column[mine]]] = False
            out += np.float32(in_lead.sum()) - (in_lead.sum() - with_lead)[:, None].astype(np.float32) - (in_lead.sum() - with_lead)[None, :].astype(np.float32)
            shared = absent[:, absent.sum(axis=0) > 1].astype(np.float32)
            out += shared @ shared.T
            rest = ~in_lead[column] & (held[column] > 1)
            row, column = row[rest], column[rest]
    common = held[column] > 1
    row, column = row[common], column[common]
    used, column = np.unique(column, return_inverse=True)
    for start in range(0, len(used), 4096):
        part = (column >= start) & (column < start + 4096)
        block = np.zeros((m, min(4096, len(used) - start)), np.float32)
        block[row[part], column[part] - start] = 1
        out += block @ block.T
    return out


def compare(percent: int, first: bool):
    """For the sets that meet in one block: links (a, b) that connect each class of them, with key 0; in the first turn of
    a group of several blocks also (key, a) with a null b for each set outside the class of the group's representative."""

    def links(table: pa.Table) -> pa.Table:
        docs, at = np.unique(table.column("doc_id").to_numpy(), return_index=True)
        packed_sets = table.column("shingles").to_pylist()
        sets = [np.frombuffer(packed_sets[i], U64) for i in at.tolist()]
        label = np.arange(len(docs))
        if len(docs) > 1:
            o, n = overlaps(sets).astype(np.float64), np.array([len(s) for s in sets], dtype=np.float64)
            i, j = np.nonzero(np.triu(100 * o >= percent * (n[:, None] + n[None, :] - o), 1))
            label = local_components(len(docs), i, j)
        moved = label != np.arange(len(docs))
        a, b = docs[moved], docs[label[moved]]
        out = pa.table({"key": np.zeros(len(a), np.int64), "a": a, "b": b})
        if first and table.column("blocks")[0].as_py() > 1:
            lead = np.searchsorted(docs, table.column("lead")[0].as_py())
            rest = docs[label != label[lead]]
            out = pa.concat_tables([out, pa.table({"key": np.full(len(rest), table.column("key")[0].as_py()), "a": rest, "b": pa.nulls(len(rest), pa.int64())})])
        return out

    return links


def fetched_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """needed(doc_id, key, p, q, lead, blocks) with the shingles of each document, made once for each document from its text."""
    columns = ["key", "p", "q", "lead", "blocks"]
    small = needed.select("doc_id").distinct().count() <= BROADCAST_ROWS
    wanted = needed.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("at"))
    texts = docs.join(F.broadcast(wanted) if small else wanted, "doc_id")

    def to_sets(batches):
        for batch in in_parts(batches, 8_000_000):
            packed_sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), packed_sets], ["doc_id", "at", "shingles"])

    full = texts.select("doc_id", "at", "text").mapInArrow(to_sets, "doc_id long, at array<struct<key: long, p: int, q: int, lead: long, blocks: int>>, shingles binary")
    return full.select("doc_id", "shingles", F.explode("at").alias("at")).select("doc_id", "shingles", "at.*")


def ngram_jaccard_classes(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their word shingles: (doc_id, n_shingles, component_id).

    docs needs doc_id (unique, long) and text; other columns are not looked at. A null or empty text, or
    one without words, has an empty set and is linked with nothing. A row without doc_id keeps its
    n_shingles and has a null component. Rows that repeat a doc_id are returned each, in the same class.
    Equal sets are linked. The result has one row for each input row; an empty table gives none.
    """
    scratch = Scratch(spark, "ngram-jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = scratch.save(prefixes(docs, frequent_shingles(docs, k), k, percent), "sets", "lz4")
    known = sets.filter("doc_id IS NOT NULL AND n_shingles > 0")
    one = known.groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "rare", "common")).alias("s")).select("s.*")
    entries = known.agg(F.coalesce(F.sum(F.length("rare")), F.lit(0))).first()[0] // 8
    buckets = power_of_two(entries / 300_000, 64)
    heads = index_entries(one, buckets).groupBy("bucket").applyInArrow(list_candidates(percent), "x long, y long, nx long, ny long, n long")
    found = scratch.save(heads, "candidates", "lz4")
    largest = F.greatest("nx", "ny")
    pairs = (
        found.filter("n > 0").groupBy("x", "y").agg(F.sum("n").alias("n"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
        .filter(F.col("n") + F.floor((percent * largest + 99) / 100) - 1 >= F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent)))
    )
    pairs = scratch.save(pairs.select("x", "y", "nx", "ny"), "pairs")
    ends = pairs.select(F.col("x").alias("d"), F.col("y").alias("e")).union(pairs.select("y", "x"))
    home = ends.groupBy("d").agg(F.least(F.min("e"), F.col("d")).alias("home"))
    keyed = (
        pairs.join(home.selectExpr("d AS x", "home AS hx"), "x").join(home.selectExpr("d AS y", "home AS hy"), "y")
        .select(F.least("hx", "hy").alias("key"), F.explode(F.array(F.struct(F.col("x").alias("doc_id"), F.col("nx").alias("n")), F.struct(F.col("y").alias("doc_id"), F.col("ny").alias("n")))).alias("s"))
        .select("key", "s.doc_id", "s.n")
    )
    meets = found.filter("n = 0").select("x", "y", "nx", "ny").union(common_leaders(one)).distinct()
    led = meets.selectExpr("-x - 1 AS key", "y AS doc_id", "ny AS n").union(meets.selectExpr("-x - 1 AS key", "x AS doc_id", "nx AS n"))
    members = scratch.save(keyed.union(led).distinct(), "members")
    size = members.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("t"), F.min("doc_id").alias("lead")).filter("m > 1")
    size = size.selectExpr("key", "lead", f"int(ceil(greatest(m / {BLOCK_SETS}, t / {BLOCK_SHINGLES}))) AS blocks")
    spread = members.join(size, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = scratch.save(spread.select("doc_id", "key", "own", "lead", "blocks"), "spread")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    none = F.lit(0)
    # each set in its own block, and the representative in all
    needed = spread.select("doc_id", "key", F.col("own").alias("p"), none.alias("q"), "lead", "blocks").union(
        spread.filter("doc_id = lead AND blocks > 1").select("doc_id", "key", every.alias("p"), none, "lead", "blocks").filter(F.col("p") != F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    )
    kind = "key long, a long, b long"
    links = scratch.save(fetched_sets(docs, scratch.save(needed, "needed"), k).groupBy("key", "p", "q").applyInArrow(compare(percent, True), kind), "answers")
    rest = links.filter("b IS NULL").select("key", F.col("a").alias("doc_id")).distinct()
    links = links.filter("b IS NOT NULL").select("a", "b")
    if not rest.isEmpty():
        # sets outside their representative's class meet every block of the group
        groups = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts"))
        rest = rest.join(groups, "key").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int"))
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        other = spread.join(groups, "key").select("doc_id", "key", parts.alias("p"), F.col("own").alias("q"), "lead", "blocks")
        outside = rest.join(size, "key").select("doc_id", "key", F.col("part").alias("p"), every.alias("q"), "lead", "blocks")
        more = fetched_sets(docs, scratch.save(other.union(outside), "needed2"), k).groupBy("key", "p", "q").applyInArrow(compare(percent, False), kind)
        links = links.union(scratch.save(more, "answers2").select("a", "b"))
    label = components(spark, scratch, links)
    ones = known.groupBy("fp").agg(F.min("doc_id").alias("one"), F.count("*").alias("copies"))
    ones = scratch.save(ones.join(label, F.col("one") == F.col("node"), "left").select("fp", F.coalesce("component", "one").alias("class"), "copies"), "classes")
    scratch.drop("candidates", "pairs", "members", "spread", "needed", "needed2")
    # sets that a HOT-th of all documents hold, so HOT of them at most, are broadcast; their documents are dealt out by
    # themselves in the join of the others, so no set has more than that many rows in one task
    rows = known.count()
    hot = ones.filter(F.col("copies") * HOT >= F.lit(max(rows, HOT))).select(F.col("fp").alias("hot_fp"), F.col("class").alias("hot_class"))
    out = sets.select("doc_id", "n_shingles", "fp").join(F.broadcast(hot), F.col("fp") == F.col("hot_fp"), "left")
    alone = F.unhex(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("alone"))))
    out = out.withColumn("fp", F.when(F.col("hot_class").isNull(), F.col("fp")).otherwise(alone))
    rest = ones.filter(F.col("copies") * HOT < F.lit(max(rows, HOT))).select("fp", F.col("class").alias("own_class"))
    out = out.join(rest, "fp", "left").withColumn("class", F.coalesce("hot_class", "own_class"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class"))).otherwise(F.col("doc_id")).alias("component_id"))
