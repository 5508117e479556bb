"""Substring dedup on a log-structured fingerprint index.

The index takes documents in batches of ascending ids and holds *runs*, immutable sorted tables with one packed
row for each bucket, of two kinds, and the texts of its batches, compressed by chunks of neighbouring ids.

*Fingerprints.* A fingerprint is the hash of a short word sequence that is smallest among those inside a window
(winnowing), so equal windows have equal fingerprints while about a fifth of all places enter the index. A batch's
fingerprints are merge-joined with the runs of their bucket. One that a second document holds proposes the windows
that have it and is *settled* from then on: only the first time, the one chunk that held it before is read again.

*Windows.* Proposed windows are verified by 96 bits of two independent hashes of their words: a window goes if it
also starts in a document with a smaller id, of the batch or among the windows of settled fingerprints, which runs
of their own keep. So a passage that all of history holds is looked up, and no text of history is read for it.

Each batch writes new runs; every ``RUNS`` batches what they hold is compacted into one. Documents are dealt out in
chunks. What documents of a chunk share is settled inside it and leaves it once. Replies are places of windows, so
texts are hashed for fingerprints and for proposed windows only.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ODD, U64, Scratch, bucket_of, joined, mix, packed, power_of_two, texts_in_parts, windows, word_pairs

#: Documents of a chunk have the same id // CHUNK, a power of two.
CHUNK = 64
#: Words in the sequence of a fingerprint.
SHORT = 5
#: Runs that a batch is merged with before they are compacted.
RUNS = 3
#: Shares of all documents up to which a whole table's batches reach; as each equals what came before, merging stays linear.
SHARES = (1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: Words of text for which a bucket is made.
BUCKET_WORDS = 1_500_000

PLACES = "at long, part int, a binary, b binary, rows binary, places binary"


def least_of(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive numbers."""
    n, held = 1, x
    while 2 * n <= span:
        held = np.minimum(held[:-n], held[n:])
        n *= 2
    size = len(x) - span + 1
    return np.minimum(held[:size], held[span - n : span - n + size])


def fingerprints_of(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in the order of a text, given its words' first hashes, and how many consecutive windows have each."""
    span = width - SHORT + 1
    if len(words) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    least = least_of(windows(words, SHORT), span)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[starts], np.diff(np.r_[starts, len(least)])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows, from those of the short sequences that cover them."""
    short = windows(words, SHORT)
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        return mix(sum(short[o : o + n] * ODD[j] for j, o in enumerate([*range(0, width - SHORT, SHORT), width - SHORT])))


def number_of(fingerprints: np.ndarray, buckets: int) -> np.ndarray:
    """A fingerprint's bucket and its last 32 bits. Buckets grow with the index, so few different fingerprints share a number;
    if they do, windows are proposed for nothing."""
    return (bucket_of(fingerprints, buckets) << U64(32)) | (fingerprints & U64(0xFFFFFFFF))


def stored(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Rows (chunk, size, blob): documents of a chunk that lie together, with the columns that they carry, compressed."""

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, texts in texts_in_parts(batches):
            ids = batch.column("doc_id").to_numpy()
            chunks = ids >> (CHUNK.bit_length() - 1)
            order = np.argsort(chunks, kind="stable")
            starts = np.flatnonzero(np.r_[True, chunks[order][1:] != chunks[order][:-1]]) if len(order) else order
            rows = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                at = order[i:j]
                held = [texts[k] for k in at.tolist()]
                own = [batch.column(f"own_{c}").take(pa.array(at)).to_pylist() for c in carry]
                rows.append((int(chunks[at[0]]), sum(len(t or b"") for t in held), squeeze.compress(pickle.dumps((ids[at].tolist(), held, own), 5))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "size", "blob"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(pack, "chunk long, size long, blob binary")


def opened(blobs: list[bytes], carried: int) -> list[tuple]:
    """(id, text, columns...) of the documents in blobs, by id and text."""
    rows = []
    for blob in blobs:
        ids, texts, own = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        rows += zip(ids, texts, *own[:carried], strict=True)
    return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or b""))


def fingerprints(store: DataFrame, width: int, buckets: int) -> DataFrame:
    """Packed entries for each bucket: the last bits of fingerprints, and twice their chunk plus whether documents of it share them."""

    def entries(held: list[bytes | None], owner: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        (words, _), starts = word_pairs(pa.array(held, pa.binary()))
        found = [fingerprints_of(words[i:j], width)[0] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        f, n = np.concatenate(found), [len(x) for x in found]
        if not len(f):
            return
        chunk, doc = (np.repeat(np.array(x, np.int64), n) for x in zip(*owner, strict=True))
        order = np.lexsort((doc, f, chunk))
        f, doc, chunk = f[order], doc[order], chunk[order]
        starts = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (chunk[1:] != chunk[:-1])])
        several = np.maximum.reduceat(doc, starts) != doc[starts]
        f, at = f[starts], chunk[starts] * 2 + several
        rows = list(packed(bucket_of(f, buckets), (f & U64(0xFFFFFFFF)).astype(np.uint32), at))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "f": pa.array([x[0] for _, x in rows], pa.binary()), "at": pa.array([x[1] for _, x in rows], pa.binary()), "fresh": [True] * len(rows)})

    def emit(batches):
        held, owner, size = [], [], 0
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                docs = opened([blob], 0)
                held += [t for _, t in docs]
                owner += [(chunk, d) for d, _ in docs]
                size += sum(len(t or b"") for _, t in docs)
                if size > 16_000_000:
                    yield from entries(held, owner)
                    held, owner, size = [], [], 0
        if held:
            yield from entries(held, owner)

    return store.select("chunk", "blob").mapInArrow(emit, "bucket int, f binary, at binary, fresh boolean")


def merge_run(compact: bool):
    """For one bucket: the new run, and numbers of fingerprints for the chunks whose windows are proposed ("flag" of the batch, "past" of earlier ones)."""

    def merge(table: pa.Table) -> pa.Table:
        bucket, fresh = table.column("bucket")[0].as_py(), table.column("fresh")
        new, old = table.filter(fresh), table.filter(pc.invert(fresh))
        f, at = joined(new.column("f"), np.uint32), joined(new.column("at"), np.int64)
        g, was = joined(old.column("f"), np.uint32), joined(old.column("at"), np.int64)
        order = np.lexsort((at, f))
        f, at = f[order], at[order]
        known, starts, count = np.unique(f, return_index=True, return_counts=True)
        shared = (count > 1) | np.isin(known, g)
        shared |= np.maximum.reduceat(at & 1, starts).astype(bool) if len(starts) else False
        rows = []
        flagged = np.repeat(shared, count)
        for kind, chunks, numbers in (("flag", at[flagged] >> 1, f[flagged]), ("past", *past(g, was, known))):
            own, numbers = chunks, (numbers.astype(U64) | U64(bucket << 32))
            rows += [(kind, c, np.unique(np.frombuffer(n, U64)).tobytes(), b"") for c, (n,) in packed(own, numbers)]
        run_f, run_at = known, (at[starts] >> 1) * 2 + shared
        if compact:
            run_f, run_at = np.r_[g, run_f], np.r_[was, run_at]
            order = np.lexsort((run_at >> 1, run_f))
            run_f, run_at = run_f[order], run_at[order]
            first = np.flatnonzero(np.r_[True, run_f[1:] != run_f[:-1]]) if len(run_f) else run_f
            settled = np.maximum.reduceat(run_at & 1, first) if len(first) else run_at
            run_f, run_at = run_f[first], (run_at[first] >> 1) * 2 + settled
        rows.append(("run", bucket, run_f.tobytes(), run_at.tobytes()))
        kind, own, a, b = zip(*rows, strict=True)
        return pa.table({"kind": list(kind), "own": pa.array(own, pa.int64()), "f": pa.array(a, pa.binary()), "at": pa.array(b, pa.binary())})

    def past(g: np.ndarray, was: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of earlier batches that hold a fingerprint of this one which is not settled."""
        settled = np.unique(g[(was & 1) == 1])
        due = np.isin(g, known) & ~np.isin(g, settled)
        return was[due] >> 1, g[due]

    return merge


def propose(width: int, buckets: int):
    """For one chunk: windows that have a flagged fingerprint, with row and place of those in the batch; those that a smaller
    document of the chunk has too are settled here and pass through."""

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        kinds, numbers = right.column("kind").to_pylist(), right.column("f").to_pylist()
        chunk = right.column("own")[0].as_py() if right.num_rows else 0
        for kind, part in (("flag", True), ("past", False)):
            flagged = np.unique(np.frombuffer(b"".join(n for k, n in zip(kinds, numbers, strict=True) if k == kind), U64))
            if not len(flagged):
                continue
            blobs = [b for b, x in zip(left.column("blob").to_pylist(), left.column("fresh").to_pylist(), strict=True) if x == part]
            found = [np.zeros((4, 0), U64)]
            docs = opened(blobs, 0)
            pairs, starts = word_pairs(pa.array([text for _, text in docs], pa.binary()))
            for row, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                words = pairs[:, i:j]
                f, n = fingerprints_of(words[0], width)
                number = number_of(f, buckets)
                hit = flagged[np.minimum(np.searchsorted(flagged, number), len(flagged) - 1)] == number
                if hit.any():
                    place = np.flatnonzero(np.repeat(hit, n))
                    a, b = window_hashes(words[0], width)[place], window_hashes(words[1], width)[place] >> U64(32)
                    found.append(np.stack([a, b, np.full(len(place), row, U64), place.astype(U64)]))
            a, b, row, place = np.concatenate(found, axis=1)
            if not len(a):
                continue
            order = np.lexsort((row, b, a))
            a, b, row, place = a[order], b[order], row[order], place[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            if not part:  # of history only the windows count
                rows += [(k, chunk, 2, *x, b"", b"") for k, x in packed(bucket_of(a[new], buckets), a[new], b[new].astype(np.uint32))]
                continue
            ids = np.array([d[0] for d in docs], np.int64)[row.astype(np.int64)]
            late = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            if late.any():
                rows.append((int(bucket_of(np.array([chunk], np.int64).view(U64), buckets)[0]), chunk, 1, b"", b"", row[late].astype(np.uint32).tobytes(), place[late].astype(np.uint32).tobytes()))
            kept = np.flatnonzero(~late)[np.lexsort((place[~late], row[~late]))]  # in the order of the texts, places compress better
            a, b, row, place = a[kept], b[kept].astype(np.uint32), row[kept].astype(np.uint32), place[kept].astype(np.uint32)
            rows += [(k, chunk, 0, *x) for k, x in packed(bucket_of(a, buckets), a, b, row, place)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "at", "part", "a", "b", "rows", "places"])

    return emit


def settle(compact: bool):
    """For one bucket: the places of windows that also start in a smaller document (part 0), and the new run of windows (part 3).

    Parts of the input: 0 windows of the batch by chunk, 1 places that pass through, 2 windows of chunks read again, 3 runs."""

    def go(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts, at, a, b, rows, places = (table.column(c).to_pylist() for c in ("part", "at", "a", "b", "rows", "places"))
        hashed = sorted((i for i, p in enumerate(parts) if p != 1), key=lambda i: parts[i])
        hash_a, hash_b = (np.frombuffer(b"".join(x[i] for i in hashed), kind) for x, kind in ((a, U64), (b, np.uint32)))
        n = [len(a[i]) // 8 for i in hashed]
        part, chunk = (np.repeat(np.array([x[i] for i in hashed], np.int64), n) for x in (parts, at))
        row, place = np.zeros(len(part), np.uint32), np.zeros(len(part), np.uint32)
        for x, given in ((row, rows), (place, places)):  # those of the batch come first
            own = np.frombuffer(b"".join(given[i] for i in hashed if parts[i] == 0), np.uint32)
            x[: len(own)] = own
        order = np.lexsort((chunk, -part, hash_b, hash_a))
        hash_a, hash_b, part, chunk, row, place = (x[order] for x in (hash_a, hash_b, part, chunk, row, place))
        new = np.r_[True, (hash_a[1:] != hash_a[:-1]) | (hash_b[1:] != hash_b[:-1])] if len(part) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        mine = first[np.cumsum(new) - 1]
        late = (part == 0) & ((part[mine] > 0) | (chunk > chunk[mine]))
        order = np.lexsort((place[late], row[late]))
        out = [(c, 0, b"", b"", *x) for c, x in packed(chunk[late][order], row[late][order], place[late][order])]
        out += [(at[i], 0, b"", b"", rows[i], places[i]) for i, p in enumerate(parts) if p == 1]
        kept = first if compact else first[part[first] != 3]
        out.append((bucket, 3, hash_a[kept].tobytes(), hash_b[kept].tobytes(), b"", b""))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["at", "part", "a", "b", "rows", "places"])

    return go


def strip(width: int, carry: list[pa.Field], text: bool):
    """For one chunk: each document with what is left of its text, given the places of its late windows, and the columns that it carries."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        row, place = joined(right.column("rows"), np.uint32), joined(right.column("places"), np.uint32)
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order].astype(np.int64)
        docs = opened(left.column("blob").to_pylist(), len(carry))
        ends = np.searchsorted(row, np.arange(len(docs) + 1))
        out = []
        for k, (doc, whole, *own) in enumerate(docs):
            found, late = (whole or b"").split(), place[ends[k] : ends[k + 1]]
            kept, gone = found, 0
            if len(late):
                change = np.bincount(late, minlength=len(found) + 1) - np.bincount(late + width, minlength=len(found) + 1)
                drop = np.cumsum(change)[:-1] > 0
                kept, gone = [w for w, x in zip(found, drop.tolist(), strict=True) if not x], int(drop.sum())
            kept = b" ".join(kept)
            out.append((doc, len(found), gone, hashlib.sha256(kept).hexdigest(), (kept if gone else whole) if text else None, *own))
        doc, n, m, digest, kept, *own = zip(*out, strict=True) if out else ((),) * (5 + len(carry))
        columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if text:
            columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
        return pa.table([*columns, *[pa.array(x, f.type) for x, f in zip(own, carry, strict=True)]], names=[*names, *[f.name for f in carry]])

    return cut


class FingerprintIndex:
    """Runs of fingerprints and of windows, and the texts of all batches, below a shared folder.

    Buckets are fixed by the first batch and by ``growth``, how many times its size the index is expected to reach;
    a larger index has larger buckets and the same results."""

    def __init__(self, spark: SparkSession, scratch: Scratch, width: int = 13, buckets: int = 0, growth: float = 16):
        if width < SHORT:
            raise ValueError(f"windows have {SHORT} words or more")
        self.spark, self.scratch, self.width, self.buckets, self.growth = spark, scratch, width, buckets, growth
        self.fingerprints, self.windows, self.texts, self.batches, self.compactions = [], [], [], 0, 0

    def add(self, docs: DataFrame, carry: tuple[str, ...] = (), text: bool = True) -> DataFrame:
        """Take in a batch, whose ids exceed those of all before; rows as ``substring_dedup`` returns them."""
        scratch, width, k, kinds = self.scratch, self.width, self.batches, [docs.schema[c] for c in carry]
        self.batches += 1
        store = scratch.save(stored(docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(f"own_{c}") for c in carry]), carry), f"texts{k}", "uncompressed")
        if not self.buckets:
            self.buckets = power_of_two((store.agg(F.sum("size")).first()[0] or 0) / 6 * self.growth / BUCKET_WORDS, 64)
        compact = len(self.fingerprints) >= RUNS

        entries = fingerprints(store, width, self.buckets)
        for run in self.fingerprints:
            entries = entries.union(run.select(F.col("own").cast("int"), "f", "at", F.lit(False)))
        merged = scratch.save(entries.groupBy("bucket").applyInArrow(merge_run(compact), "kind string, own long, f binary, at binary"), f"fingerprints{k}")
        flags, past = merged.filter("kind <> 'run'").select("kind", F.col("own").alias("own"), "f"), merged.filter("kind = 'past'").select(F.col("own").alias("chunk")).distinct()

        texts = store.select("chunk", "blob", F.lit(True).alias("fresh"))
        for before in self.texts:  # only the chunks of a fingerprint's first holder are read again
            texts = texts.union(before.join(past, "chunk", "left_semi").select("chunk", "blob", F.lit(False)))
        proposed = texts.groupBy("chunk").cogroup(flags.groupBy("own")).applyInArrow(propose(width, self.buckets), f"bucket int, {PLACES}")
        for run in self.windows:
            proposed = proposed.union(run.select(F.col("at").cast("int"), "at", "part", "a", "b", "rows", "places"))
        settled = scratch.save(proposed.groupBy("bucket").applyInArrow(settle(compact), PLACES), f"windows{k}", "lz4")

        own_runs = merged.filter("kind = 'run'"), settled.filter("part = 3")
        for runs, run in zip((self.fingerprints, self.windows), own_runs, strict=True):
            if compact:
                runs.clear()
            runs.append(run)
        self.compactions += compact
        self.texts.append(store.select("chunk", "blob"))
        late = settled.filter("part = 0").select(F.col("at").alias("own"), "rows", "places")
        fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds]
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kinds)
        return store.select("chunk", "blob").groupBy("chunk").cogroup(late.groupBy("own")).applyInArrow(strip(width, fields, text), schema)


def batches_of(docs: DataFrame) -> list[DataFrame]:
    """Batches of ascending ids up to ``SHARES`` of all documents, about; they end where chunks end."""
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in SHARES]), 1000)).first()[0] or []
    ends = sorted({c | CHUNK - 1 for c in cuts})
    low = [None, *ends]
    return [docs.filter((F.lit(True) if a is None else F.col("doc_id") > a) & (F.lit(True) if b is None else F.col("doc_id") <= b)) for a, b in zip(low, [*ends, None], strict=True)]


def substring_dedup(spark: SparkSession, docs: DataFrame, width: int = 13, index: FingerprintIndex | None = None, carry: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """Remove words covered by windows of ``width`` words that also start in a document with a smaller id.

    Rows (doc_id, n_words, n_removed, kept_sha256, kept) for each of docs with a doc_id. kept_sha256 is of the
    kept words joined by one space; kept is that, or the text itself if it loses nothing (left out if not
    ``text``). A null or empty text counts as no words. With an index, docs are one more batch of it, whose ids exceed
    those that it has taken in; without one, they are taken into a new one in five batches. Windows are judged on
    the input. Rows that repeat a doc_id do not count against each other. Texts are read whole; those of a chunk
    of 64 ids, and equal ids, are worked on by one task. Columns named in carry are returned too; others are not
    looked at. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    if index is not None:
        return index.add(docs, carry, text)
    index = FingerprintIndex(spark, Scratch(spark, "substring-dedup"), width)
    parts = [index.add(batch, carry, text) for batch in batches_of(docs)]
    return functools.reduce(DataFrame.union, parts)
