"""Language identification by hierarchical discrimination.

A linear classifier predicts the language family; within it, linear support vector machines, one for
each pair of languages, vote. All work on relative frequencies of hashed letter sequences of one to
three bytes, with A-Z and the Latin-1 capitals folded and everything that is not a letter as a space.
A prediction is linear in the frequencies, so a text's score is the mean weight of its sequences; texts
are read whole. The machines are fitted on the driver on a hash sample of at most ``sample`` documents, on average.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts_in_parts

#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "uralic": ["et", "fi", "hu"],
    "semitic": ["am", "ar", "he", "mt"],
    "celtic": ["br", "cy", "ga", "gd"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "baltic": ["lt", "lv"],
}
#: Training documents in all at most (on average), and for each language: defaults of ``language_model``.
SAMPLE, EACH = 3_000, 600
#: Different languages whose counts are broadcast at most; beyond that they are joined by a shuffle of ids.
COUNTS = 100_000
#: Bytes of text whose sequences are held at once, at some 30 bytes each. Longer texts are cut at spaces and their sums added up.
HELD = 2_000_000
#: Hashed features.
BITS = 12
#: Weight of the squared norm in the objective, and gradient steps.
REGULAR, STEPS = 1e-3, 80
UNKNOWN = "und"

_FOLD = bytes(b if b >= 128 else (b | 32 if 65 <= (b & ~32) <= 90 else 32) for b in range(256))


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def sequences(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers at each place of all texts, by length of the sequence, and where each text starts."""
    joined = (b" " + b"  ".join(texts) + b"  ").translate(_FOLD)
    x = np.frombuffer(joined, np.uint8).copy()
    capital = np.flatnonzero((x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[:-1] == 0xC3)) + 1
    x[capital] += 0x20
    starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
    x = x.astype(np.uint32)
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, 4):
        h[: len(x) - n + 1] = h[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
        out.append((h * np.uint32(2654435761) + np.uint32(n * 0x3504F333)) >> np.uint32(32 - BITS))
    blank = np.flatnonzero((x == 32) & (np.r_[x[1:], 32] == 32))  # runs of spaces say nothing
    for f in out:
        f[blank] = 1 << BITS
    return out, starts


def held_pieces(texts: list[bytes]):
    """Groups of pieces of at most about ``HELD`` bytes, with the number of the text that each piece is of. A longer text is cut after a
    space; only sequences across such a cut are not counted."""
    own, parts, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            end = len(text) if len(text) - start <= HELD else text.rfind(b" ", start, start + HELD) + 1 or start + HELD
            own.append(i)
            parts.append(text[start:end])
            size += end - start
            start = end
            if size >= HELD:
                yield np.array(own), parts
                own, parts, size = [], [], 0
            if start >= len(text):
                break
    if parts:
        yield np.array(own), parts


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of the features, one row for each text."""
    rows = np.zeros((len(texts), (1 << BITS) + 1), np.float32)
    for own, parts in held_pieces(texts):
        found, starts = sequences(parts)
        ends = np.r_[starts[1:], len(found[0])]
        for f in found:
            for i, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True):
                rows[i] += np.bincount(f[a:b], minlength=(1 << BITS) + 1)
    rows = rows[:, :-1]
    return rows / np.maximum(rows.sum(axis=1, keepdims=True), 1)


def fit_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge) for y in {-1, 1}; classes count evenly."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 0, 1 / (spread + 1e-4), 0)
    z = ((x - mean) * scale / np.sqrt(max((spread > 0).sum(), 1))).astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b, u, c = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0
    rate = 0.25
    for k in range(STEPS):
        miss = (np.maximum(0, 1 - y * (z @ u + c)) * y * share).astype(np.float32)
        nw, nb = u + np.float32(rate) * (2 * (miss @ z) - np.float32(REGULAR) * u), c + rate * 2 * miss.sum()
        u, c = nw + np.float32(k / (k + 3)) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    w = w * scale / np.sqrt(max((spread > 0).sum(), 1))
    return w, float(b - mean @ w)


@dataclass
class LanguageModel:
    """Columns of weights: one for each family, then one for each pair of languages in a family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out, used = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        for own, parts in held_pieces(texts):
            found, starts = sequences(parts)
            np.add.at(used, own, np.add.reduceat(sum((f < (1 << BITS)).astype(np.int64) for f in found), starts))
            for k in range(len(self.bias)):
                w = np.r_[self.weights[k], 0].astype(np.float32)
                np.add.at(out[:, k], own, np.add.reduceat(sum(w[f] for f in found), starts, dtype=np.float64))
        return out / np.maximum(used, 1)[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and a score from 0 to 1."""
        m = 1 / (1 + np.exp(np.clip(-3 * self.margins(texts), -40, 40)))
        names = sorted(set(self.families))
        in_family = m[:, : len(names)] / np.maximum(m[:, : len(names)].sum(axis=1, keepdims=True), 1e-12)
        own = np.array([names.index(f) for f in self.families])
        votes, sums = np.zeros((len(texts), len(self.languages))), np.zeros((len(texts), len(self.languages)))
        for k, (a, b) in enumerate(self.pairs):
            p = m[:, len(names) + k]
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            sums[:, a] += p
            sums[:, b] += 1 - p
        size = np.array([self.families.count(f) for f in self.families])
        inside = np.where(size > 1, sums / np.maximum(size - 1, 1), 1.0)
        best_family = in_family.argmax(axis=1)
        rank = np.where(own[None, :] == best_family[:, None], votes + sums / (1 + len(self.pairs)) + 1e-9, -1)
        best = rank.argmax(axis=1)
        rows = np.arange(len(texts))
        return best, np.clip(in_family[rows, best_family] * inside[rows, best], 0, 1)


def fit_languages(x: np.ndarray, langs: list[str]) -> LanguageModel:
    languages = sorted(set(langs))
    families = [family_of(x) for x in languages]
    names = sorted(set(families))
    of = np.array([languages.index(x) for x in langs])
    own = np.array([names.index(f) for f in families])
    pairs = [(a, b) for a, b in itertools.combinations(range(len(languages)), 2) if families[a] == families[b]]
    columns = []
    for f in range(len(names)):
        columns.append(fit_svm(x, np.where(own[of] == f, 1.0, -1.0)) if len(names) > 1 else (np.zeros(x.shape[1]), 1.0))
    for a, b in pairs:
        at = (of == a) | (of == b)
        columns.append(fit_svm(x[at], np.where(of[at] == a, 1.0, -1.0)))
    return LanguageModel(languages, families, pairs, np.stack([w for w, _ in columns]), np.array([b for _, b in columns]))


def held_out() -> Column:
    """Whether crc32 of doc_id as text is a multiple of 5; true without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_model(docs: DataFrame, sample: int = SAMPLE, each: int = EACH) -> LanguageModel | None:
    """Fit on a hash sample of the documents that are not held out and have a language: on average at most ``each`` of a
    language and ``sample`` in all. None if there are none. Languages are counted in a table, so any number of them may occur."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 24)  # 40 bits
    share = F.least(F.lit(1.0), F.lit(min(each, sample / languages)) / F.col("n"))
    # ids are chosen without their texts, by a small table of counts; the chosen ones, about ``sample``, meet the texts where these are
    few = F.broadcast(counts) if languages <= COUNTS else counts
    chosen = known.select("doc_id", "lang").join(few, "lang").filter(part < share * float(2**40)).select("doc_id", "lang").distinct()
    known = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def emit(batches):
        for batch, texts in texts_in_parts(batches, 2_000_000):
            rows = frequencies([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in rows * 1024], pa.binary())], ["doc_id", "lang", "x"])

    rows = known.mapInArrow(emit, "doc_id long, lang string, x binary").toPandas().sort_values(["doc_id", "lang", "x"])
    x = np.stack([np.frombuffer(r, np.float16) for r in rows["x"]]).astype(np.float32) / 1024
    return fit_languages(x, rows["lang"].tolist())


def identify_languages(spark: SparkSession, docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Predict the language of every whole text: rows (doc_id, held_out, lang_pred, score).

    Without a model, one is fitted on the rows of docs that are not held out. lang_pred is a learned
    value, or ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Only the
    text enters a prediction. Repeated rows are returned each; of languages that score alike the first by name is taken. A
    text of any length is read whole, in pieces of bounded size. Other columns, whatever their names, are not looked at; an
    empty table gives no rows.
    """
    model = model or language_model(docs)
    held = spark.sparkContext.broadcast(model)

    def predict(batches):
        for batch, texts in texts_in_parts(batches, 2_000_000):
            model = held.value
            has = [model is not None and t is not None and (any(c.isalpha() for c in t.decode("utf-8", "replace")[:64]) or any(map(str.isalpha, t.decode("utf-8", "replace")))) for t in texts]
            best, score = model.predict([t if h else b"" for t, h in zip(texts, has, strict=True)]) if any(has) else (np.zeros(len(texts), int), np.zeros(len(texts)))
            langs = [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, docs.select("doc_id").schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double"))
