"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = logistic(threshold_k - score)`` with ordered thresholds and one score, a sum of shared
weights of hashed text features. It gives the expected grade and the probability of each tail of grades.
Features say which words and which beginnings of words a text holds (folded, without punctuation at
their ends) and which shapes its words have (case, punctuation); a text of any length is read whole and each feature counts once.

The weights are fitted on the driver on at most about ``LABELLED`` rated documents, of which only
feature numbers travel. FTRL-proximal steps leave most weights at zero, so rare words add no noise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, in_parts, read, word_codes

#: Rated documents that the fit uses at most (on average), drawn by a hash of doc_id, evenly over grades.
LABELLED = 9_000
#: Bits of a feature's number, and bytes of a word that count as its stem.
BITS, STEM = 18, 5
PASSES, L1, L2, RATE = 6, 8.0, 1.0, 0.5
#: Numbers of the three features for repetition.
REPEATS = np.array([0, 1, 2], np.int32)


_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Features(dict):
    """Three feature numbers of a word in one integer: the word itself, its first bytes and its shape. Forgets them at
    ``LIMIT`` words and keeps none of over ``LONG`` bytes, so memory is bounded."""

    LIMIT, LONG = 300_000, 200

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_MARKS)
        tail = word[len(word.rstrip(_MARKS)) :][:3]
        case = b"U" if len(bare) > 1 and bare.isupper() else b"l" if bare.islower() else b"T" if bare[:1].isupper() else b"o" if bare else b"-"
        own = xxhash.xxh3_64_intdigest(b"w" + bare.lower()) >> (64 - BITS)
        shape = xxhash.xxh3_64_intdigest(b"s" + case + tail) >> (64 - BITS)
        stem = xxhash.xxh3_64_intdigest(b"p" + bare.lower()[:STEM]) >> (64 - BITS)
        value = own | (stem << BITS) | (shape << 2 * BITS)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct feature numbers of each text; how much it repeats the word before is told by up to three of them."""
        codes, starts, words = word_codes(texts)
        each = np.fromiter(map(self.__getitem__, pc.cast(words, pa.binary()).to_pylist()), dtype=U64, count=len(words))
        part = U64((1 << BITS) - 1)
        three = np.stack([each & part, (each >> U64(BITS)) & part, each >> U64(2 * BITS)]).astype(np.int32)
        same, out = np.r_[codes[1:] == codes[:-1], False], []
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            again = same[i : max(j - 1, i)].sum() / max(j - i, 1)
            found = np.unique(codes[i:j]) if j - i > 64 else codes[i:j]
            out.append(np.unique(np.concatenate([three[:, found].ravel(), REPEATS[: sum(again >= x for x in (0.05, 0.15, 0.3))]])))
        return out


@dataclass
class OrdinalModel:
    """Weights by feature number and the ordered thresholds between grades; fitted is false if there were no ratings to fit."""

    weights: np.ndarray
    thresholds: np.ndarray
    fitted: bool = True

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features])


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, levels: int) -> OrdinalModel:
    """FTRL-proximal on the negative log-likelihood, rows in a fixed shuffled order; grades count evenly for the
    feature weights, and by ``weight`` for the thresholds, which are fitted again at the end."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    weights_of = lambda z, n: -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((1 + np.sqrt(n)) / RATE + L2)

    def slopes(theta: np.ndarray, s, y):
        """Derivatives of log P(y): by the score, by the threshold above and by the one below."""
        up = np.where(y < levels - 1, logistic(theta[np.minimum(y, levels - 2)] - s), 1.0)
        down = np.where(y > 0, logistic(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(up - down, 1e-9)
        return -(up * (1 - up) - down * (1 - down)) / p, up * (1 - up) / p, -down * (1 - down) / p

    theta = np.linspace(-1, 1, levels - 1) if levels > 2 else np.zeros(levels - 1)
    rng = np.random.default_rng(20)
    for step in range(PASSES):
        for i in rng.permutation(len(features)):
            f, y = features[i], grades[i]
            w = weights_of(z[f], n[f])
            by_score, above, below = slopes(theta, w.sum(), y)
            g = -float(by_score)
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / RATE * w
            n[f] += g * g
            if y < levels - 1:
                theta[y] += 0.02 / (1 + step) * above
            if y > 0:
                theta[y - 1] += 0.02 / (1 + step) * below
            theta = np.maximum.accumulate(theta)
    model = OrdinalModel(weights_of(z, n).astype(np.float32), theta, len(features) > 0)
    if len(features):
        scores, rows = model.score(features), weight / weight.sum()
        for _ in range(400):
            _, above, below = slopes(theta, scores, grades)
            push = np.array([(rows * above)[grades == k].sum() + (rows * below)[grades == k + 1].sum() for k in range(levels - 1)])
            theta = np.maximum.accumulate(theta + 2.0 * push)
        model.thresholds = theta
    return model


def rated_features(docs: DataFrame, grades: DataFrame, limit: int):
    """Feature numbers, grade and weight of a bounded sample of rated documents; weights restore the grades' shares."""
    grades = grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    count = dict(sorted((r["grade"], r["n"]) for r in grades.groupBy("grade").agg(F.count("*").alias("n")).toLocalIterator()))
    if not count:
        return [], np.zeros(0, np.int64), np.zeros(0)
    each = limit / len(count)
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 24)  # 40 bits, so that a share of few rows of very many is met
    keep = F.lit(False)
    for g, n in count.items():
        keep = keep | ((F.col("grade") == g) & (part < int(2**40 * min(1, each / n))))
    sample = F.broadcast(grades.filter(keep))  # about limit rows at most

    def emit(batches):
        features = Features()
        for batch in in_parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([f.tobytes() for f in features.of(batch.column("text"))], pa.binary())], ["doc_id", "grade", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(sample, "doc_id").mapInArrow(emit, "doc_id long, grade int, features binary").toPandas()
    rows = rows.sort_values(["doc_id", "features"])
    y = rows["grade"].to_numpy(np.int64)
    got = {g: int((y == g).sum()) for g in count}
    weight = np.array([count[g] / sum(count.values()) / (got[g] / len(y)) for g in y.tolist()])
    return [np.frombuffer(x, np.int32) for x in rows["features"]], y, weight


def fit_quality(docs: DataFrame, grades: DataFrame, levels: int, limit: int = LABELLED) -> OrdinalModel:
    """Fit on docs(doc_id, text) and grades(doc_id, grade int from 0 to levels - 1); without ratings of these docs all weights
    are zero and the model is not fitted: ``rate_documents`` then keeps every document with words."""
    return fit_ordinal(*rated_features(docs, grades, limit), levels)


def rate_documents(docs: DataFrame, model: OrdinalModel, enough: int, least: float, only_kept: bool = False) -> DataFrame:
    """Rate the whole text of every row.

    Adds expected_grade, tail_probability (of grades >= enough) and kept (that probability is at least
    ``least``) to the columns of docs; with only_kept, returns the kept rows with docs' own columns. Repeated rows are rated
    each, a probability of exactly ``least`` is kept, and a text of any length is read whole, one task for each. A
    null text and one without words are rated 0 and not kept. A model that is not fitted can reject nothing
    else, whatever ``least`` is. Columns of docs with these names are replaced.
    """
    own = [f for f in docs.schema.fields if only_kept or f.name not in ("expected_grade", "tail_probability", "kept")]
    names = [f.name for f in own]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        features = Features()
        for batch in in_parts(batches):
            found = features.of(batch.column(batch.schema.get_field_index("text")))
            tails = held.value.tails(held.value.score(found)) if found else np.zeros((0, 1))
            tails[[not len(f) for f in found]] = 0
            kept = ((tails[:, enough - 1] >= least) | (not held.value.fitted)) & np.array([len(f) > 0 for f in found], bool)
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names], names)
            if only_kept:
                yield out.filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, enough - 1]), pa.array(kept)], [*names, "expected_grade", "tail_probability", "kept"])

    schema = docs.select(*names).schema
    if not only_kept:
        schema = schema.add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")
    return docs.mapInArrow(rate, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 for toxic, 1 for low quality, 2 for good. Toxic is the end of the scale, as more
    toxic words in a text are no less toxic; a grade between two others has a score that must not pass either."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).cast("int").alias("grade"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    return fit_quality(docs, grades_of(read(spark, sf_dir, "labels")), 3)
