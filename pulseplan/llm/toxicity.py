"""Toxicity of whole texts: subword bags, averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a passage is the
mean of two words side by side (a word alone if the text has no other), and a linear
softmax tells toxic from clean. A text is as toxic as the worst of all its passages, so
that length does not thin a slur out, and words put before it do not change how it is cut.
Vectors and softmax are trained together, in numpy, through the worst passage of each text.
Misspellings that no training text holds share n-grams, and so vectors, with words that do.
Training and scoring split and lower-case texts with the same function, `split_words`.

Training sees at most ``TRAIN_ROWS`` labelled texts of each class, chosen by a hash of
their id, in one task; only the model comes to the driver. Class weights restore the share
of toxic texts among all labelled rows. Texts are scored where they lie: as all is linear,
a word's part in the score is one number, kept for the words that a worker has met.

Nulls: a null text is empty. A text without words scores by the bias alone. Labels that
are null, repeated or without a document train nothing or each on their own. Without
labelled rows of both classes, all texts score the share of toxic ones (0 if none).
Repeated documents score alike; an empty table gives no rows. Columns that a document brings
keep their names, unless one is called `toxicity`, which `score` refuses; `toxicity_of`
gives the score as a column without a name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import steps

TRAIN_ROWS = 800
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIMENSION = 4
MIN_TEXTS = 3
EPOCHS = 25
RATE = 0.03
SEED = 11
THRESHOLD = 0.3
CACHED_WORDS = 100_000


@dataclass(frozen=True)
class Model:
    """``weights``: what each bucket adds to the log-odds of a word that is only it."""

    weights: np.ndarray
    bias: float


def subwords(word: str) -> list[int]:
    """Buckets of the word between its marks, and of its n-grams."""
    marked = f"<{word}>"
    parts = [marked] + [
        marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1) if n < len(marked)
    ]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def _buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words in a row, and how many each word has."""
    parts = [np.array(subwords(w), dtype=np.int32) for w in words]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.concatenate([*parts, np.zeros(0, dtype=np.int32)]), sizes


class _Mean:
    """Weighted sums of rows of one matrix into rows of another, and their gradient."""

    def __init__(self, source: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.source = source.astype(np.int32)
        self.weights = weights[:, None].astype(np.float32)
        self.starts = np.cumsum(sizes) - sizes
        target = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(self.source, kind="stable").astype(np.int32)
        self.back, self.back_weights = target[order], self.weights[order]
        self.touched, self.back_starts = np.unique(self.source[order], return_index=True)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(rows[self.source] * self.weights, self.starts, axis=0)

    def backward(self, gradient: np.ndarray) -> np.ndarray:
        """For the rows in ``touched`` only."""
        return np.add.reduceat(gradient[self.back] * self.back_weights, self.back_starts, axis=0)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different lower-cased words of all texts, each word's number, and words per text."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = split.flatten()
    filled = pc.not_equal(flat, "")  # white space at either end leaves an empty word
    offsets = split.offsets.to_numpy().astype(np.int64)
    counts = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False).astype(np.int64))))
    coded = flat.filter(filled).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, dtype=np.int32)
    return coded.dictionary.to_pylist(), codes, np.diff(counts[offsets - offsets[0]])


def _texts_of_buckets(grams, gram_sizes, words, sizes, y) -> np.ndarray:
    """How many clean and how many toxic texts hold each bucket."""
    starts, ends = np.cumsum(gram_sizes) - gram_sizes, np.cumsum(sizes)
    found = np.zeros((2, BUCKETS))
    for own, label in zip(np.split(words, ends[:-1]), y, strict=True):
        n = gram_sizes[own]
        place = np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
        found[label, np.unique(grams[place])] += 1
    return found


def _without_rare(grams, sizes, common) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common buckets of each word, how many, and weights; one of no weight if it has none."""
    starts = np.cumsum(sizes) - sizes
    keep = common[grams]
    none = np.add.reduceat(keep.astype(np.int32), starts) == 0
    keep[starts[none]] = True
    weights = (common[grams] / np.repeat(sizes, sizes)).astype(np.float32)
    return grams[keep], np.add.reduceat(keep.astype(np.int64), starts), weights[keep]


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the two words of each passage among all words, and passages per text."""
    many = np.where(sizes > 0, np.maximum(sizes - 1, 1), 0)
    first = np.cumsum(sizes) - sizes
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    left = (np.repeat(first, many) + number).astype(np.int32)
    right = np.minimum(left + 1, np.repeat(first + sizes - 1, many)).astype(np.int32)
    return left, right, many


def train(texts: list[str], labels: list[int], toxic_share: float) -> Model:
    """Fits vectors and softmax over all given texts; each has a word."""
    y = np.array(labels, dtype=np.int64)
    vocabulary, flat, sizes = split_words(pa.array(texts, pa.large_string()))
    grams, gram_sizes = _buckets(vocabulary)
    found = _texts_of_buckets(grams, gram_sizes, flat, sizes, y)
    # Rare buckets would tell texts apart, not classes.
    common = found.sum(axis=0) >= MIN_TEXTS
    of_word = _Mean(*_without_rare(grams, gram_sizes, common))
    left, right, many = passages(sizes)
    first = np.cumsum(many) - many

    # Vectors begin with how much likelier a bucket is in toxic texts, and small noise.
    rates = (found + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    seen = found.sum(axis=0)
    rng = np.random.default_rng(SEED)
    vectors = (rng.standard_normal((BUCKETS, DIMENSION)) * 0.01).astype(np.float32)
    vectors[:, 0] = np.log(rates[1] / rates[0]) * seen / (seen + 5)
    softmax = (rng.standard_normal((DIMENSION, 2)) * 0.1).astype(np.float32)
    softmax[0] = (-2, 2)
    bias = np.log(np.array([1 - toxic_share, toxic_share], dtype=np.float32))
    weight = np.where(y == 1, toxic_share / (y == 1).mean(), (1 - toxic_share) / (y == 0).mean())
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    goal = np.eye(2, dtype=np.float32)[y]
    touched = of_word.touched
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (vectors[touched], softmax, bias)]
    for step in range(1, EPOCHS + 1):
        own, softmax, bias = (s[0] for s in state)
        vectors[touched] = own
        words = of_word.forward(vectors)
        odds = (words @ (softmax[:, 1] - softmax[:, 0]))[flat]  # all is linear up to here
        margin = odds[left] + odds[right]
        worst = _worst(margin, first, many)
        pair = flat[left[worst]], flat[right[worst]]
        means = (words[pair[0]] + words[pair[1]]) / 2
        logits = means @ softmax + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - goal) * weight
        up = np.zeros_like(words)
        for side in pair:
            np.add.at(up, side, error @ softmax.T / 2)
        gradients = (of_word.backward(up), means.T @ error, error.sum(axis=0))
        for (value, mean, square), g in zip(state, gradients, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            scale = math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            value -= RATE * scale * mean / (np.sqrt(square) + 1e-9)
    own, softmax, bias = (s[0] for s in state)
    weights = np.zeros(BUCKETS, dtype=np.float32)  # buckets that are rare or never met add nothing
    weights[touched] = own @ (softmax[:, 1] - softmax[:, 0])
    return Model(np.where(common, weights, np.float32(0)), float(bias[1] - bias[0]))


def _worst(margin: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The first passage of the highest margin of each text."""
    of_text = np.repeat(np.arange(len(many)), many)
    tops = np.flatnonzero(margin == np.maximum.reduceat(margin, first)[of_text])
    return tops[np.unique(of_text[tops], return_index=True)[1]]


class Scorer:
    """Scores texts of one model, and remembers what its words add."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, float] = {}

    def _words(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > CACHED_WORDS:
            self.seen, new = {}, words
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            flat, sizes = _buckets(some)
            sums = np.add.reduceat(self.model.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes)
            self.seen.update(zip(some, (sums / sizes).tolist(), strict=True))
        return np.array([self.seen[w] for w in words])

    def score(self, texts: pa.Array) -> np.ndarray:
        vocabulary, codes, sizes = split_words(texts)
        odds = np.full(len(sizes), self.model.bias)
        left, right, many = passages(sizes)
        if len(left):
            flat = self._words(vocabulary)[codes]
            mean = (flat[left] + flat[right]) / 2
            has = many > 0
            odds[has] += np.maximum.reduceat(mean, (np.cumsum(many) - many)[has])
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, is_training: Column) -> DataFrame:
    """(text, toxic, share): at most `TRAIN_ROWS` of each class, and how many are toxic."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & is_training)
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = None
    for label in (0, 1):
        rows = known.filter(F.col("toxic") == label)
        rows = rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TRAIN_ROWS)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    # At most 2 * TRAIN_ROWS rows of two numbers.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    return joined.select("doc_id", "text", "toxic", F.lit(share).alias("share"))


def _fitted(texts: list[str], labels: list[int], share: float) -> Model:
    """A model of the texts that have words, or of the share alone if they are of one class."""
    has_words = split_words(pa.array(texts, pa.large_string()))[2] > 0
    kept = [(t, y) for t, y, has in zip(texts, labels, has_words, strict=True) if has]
    if len({y for _, y in kept}) < 2:
        odds = math.log(share / (1 - share)) if 0 < share < 1 else (60.0 if share else -60.0)
        return Model(np.zeros(BUCKETS, dtype=np.float32), odds)
    return train([t for t, _ in kept], [y for _, y in kept], share)


def fit(docs: DataFrame, labels: DataFrame, is_training: Column) -> Model:
    """A model of the labelled rows that ``is_training`` (a condition on doc_id) selects.

    One task trains on all chosen rows; their texts do not pass through the driver.
    """

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = _fitted([r[1] for r in rows], [r[2] for r in rows], rows[0][3] if rows else 0.0)
        yield pa.record_batch({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    rows = training_rows(docs, labels, is_training).repartition(1)
    model = rows.mapInArrow(trained, "weights binary, bias double").first()
    if model is None:  # no rows, and so no task
        return _fitted([], [], 0.0)
    return Model(np.frombuffer(model.weights, dtype=np.float32), model.bias)


def toxicity_of(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The toxicity of a text column, between 0 and 1; only the texts go to Python."""
    sent = spark.sparkContext.broadcast(model)  # one number a bucket

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for batch in batches:
            rows = pa.record_batch({"text": batch})
            parts = [
                scorer.score(part.column("text").take(pa.array(np.arange(part.num_rows))))
                for part in steps(rows, "text")
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    udf = F.arrow_udf(scores, "double")
    return udf(F.col(text).cast("string"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` between 0 and 1, from ``text`` alone."""
    if "toxicity" in docs.columns:
        raise ValueError("docs have a column called toxicity already")
    return docs.withColumn("toxicity", toxicity_of(docs.sparkSession, model))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    text = F.col(doc_id).cast("string")
    return F.coalesce(F.crc32(text) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    model = fit(docs, labels, ~held_out())
    scored = score(docs.select("doc_id", F.col("text").cast("string")), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )
