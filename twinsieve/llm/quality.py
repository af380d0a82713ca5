"""Quality classifier by supervised subword embeddings (operator 1).

Features of a text are its words (runs of word characters, runs of symbols), the character 3- to 5-grams of
every word, a word pair feature for a word followed by itself, and one that every text has.  Features are hashed
into buckets with learned vectors; a document is the mean of its features' vectors, a softmax layer gives the
class, and numpy gradient descent trains both.  As the output is linear in the mean, scoring needs one number
per bucket: the vectors are folded with the output layer before they are broadcast (a fixed 1 MB).

Training takes at most ``per_class`` labelled rows of each class, the first by hash of doc_id, and only those
whose crc32(doc_id as text) mod 5 isn't 0; of these, the shortest whose whole texts have ``TRAIN_BYTES`` bytes in all,
so the driver's memory is bounded in bytes too.  Scoring goes over every whole text.

Edge cases: null texts count as empty ones and are scored by the feature that all texts have.  Very long texts are scored
whole.  Empty tables give empty tables.  Without labels of both
classes the score is the smoothed share of class 1 for all.  Of conflicting labels of one doc_id the lowest
counts.  Rows that repeat are scored each; rows with a null doc_id are scored and count as not held out.
Other columns are not looked at.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, cut, once, table, text_or_empty, whole_row

THRESHOLD = 0.3
PER_CLASS, TRAIN_BYTES = 2_000, 128 << 20
BUCKETS = 1 << 18
#: Buckets 0 and 1: the feature of every text, and of a word that follows itself.
EVERY, REPEATED, OWN = 0, 1, 2
WORDS = re.compile(r"\w+|[^\w\s]+")
#: Word types that a worker remembers, and their characters in all.
CACHE, CACHE_CHARS = 400_000, 32 << 20


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def _hashed(grams: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (grams ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (OWN + (h >> np.uint64(32)) % np.uint64(BUCKETS - OWN)).astype(np.int32)


def word_features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features one after another, and the place of each word's first."""
    buckets, owners = [], []
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_width.setdefault(min(16, len(w)) if len(w) <= 16 else 1 << (len(w) - 1).bit_length(), []).append(i)
    with np.errstate(over="ignore"):
        for width, places in by_width.items():
            own = np.array(places)
            lengths = np.array([len(words[i]) for i in places]) + 2
            code = np.zeros((len(places), width + 2), np.uint64)
            code[:, 1:-1] = np.array([words[i] for i in places], f"<U{width}").view(np.uint32).reshape(len(places), width)
            code[:, 0] = 1
            code[np.arange(len(places)), lengths - 1] = 2
            whole = np.zeros(len(places), np.uint64)
            for j in range(width + 2):
                whole = np.where(j < lengths, whole * np.uint64(1_000_003) + code[:, j], whole)
            buckets.append(_hashed(whole, 1))
            owners.append(own)
            for n in (3, 4, 5):
                if width + 2 < n:
                    continue
                gram = np.zeros((len(places), width + 3 - n), np.uint64)
                for j in range(n):
                    gram = gram * np.uint64(1_000_003) + code[:, j : width + 3 - n + j]
                row, at = np.nonzero(np.arange(width + 3 - n)[None, :] + n <= lengths[:, None])
                buckets.append(_hashed(gram[row, at], n))
                owners.append(own[row])
    if not buckets:
        return np.empty(0, np.int32), np.zeros(0, np.int64)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    return bucket[order], starts


@dataclass
class Model:
    """vectors: buckets x dim; output: classes x dim. ``constant`` is the score where there was nothing to learn."""

    vectors: np.ndarray | None = None
    output: np.ndarray | None = None
    constant: float = 0.5

    def folded(self) -> np.ndarray | None:
        """What a feature adds to the difference of the classes' logits, times the number of features."""
        return None if self.vectors is None else (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def document_features(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs; known: words' features, filled as needed."""
    words = WORDS.findall(text)
    if new := [w for w in dict.fromkeys(words) if w not in known]:
        bucket, starts = word_features(new)
        for w, x in zip(new, np.split(bucket, starts[1:])):
            known[w] = x
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    every = np.concatenate([np.array([EVERY] + [REPEATED] * repeats, np.int32), *(known[w] for w in words)])
    ids, counts = np.unique(every, return_counts=True)
    return ids, (counts / len(every)).astype(np.float32)


def train(texts: Sequence[str], labels: Sequence[int], dim: int = 12, epochs: int = 6, rate: float = 0.6, seed: int = 5) -> Model:
    ones = sum(labels)
    if ones in (0, len(labels)):
        return Model(constant=(ones + 1) / (len(labels) + 2))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = np.zeros((2, dim), np.float32)
    known: dict[str, np.ndarray] = {}
    rows = [document_features(t, known) for t in texts]
    known.clear()
    weight = [len(labels) / (2 * (len(labels) - ones)), len(labels) / (2 * ones)]
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            (ids, share), label = rows[i], labels[i]
            now = rate * (1 - step / steps) * weight[label]
            mean = share @ vectors[ids]
            logits = output @ mean
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= now * np.outer(p, mean).astype(np.float32)
            # Every feature moves by the whole gradient of the mean, as often as it occurs, as is usual for this model.
            vectors[ids] -= (now * np.minimum(share * len(ids), 4.0)[:, None] * back[None, :] / 4).astype(np.float32)
            step += 1
    return Model(vectors, output)


class Scorer:
    """Scores texts with folded weights; remembers what word types add."""

    def __init__(self, folded: np.ndarray, most: int = CACHE):
        self.folded, self.most = folded, most
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.sums, self.counts = np.zeros(1 << 12), np.zeros(1 << 12)

    def _learn(self, new: list[str]) -> None:
        bucket, starts = word_features(new)
        n, m = len(self.place), len(self.place) + len(new)
        while m > len(self.sums):
            self.sums, self.counts = (np.concatenate([x, np.zeros(len(x))]) for x in (self.sums, self.counts))
        self.sums[n:m] = np.add.reduceat(self.folded[bucket].astype(np.float64), starts)
        self.counts[n:m] = np.diff(np.append(starts, len(bucket)))
        self.place.update(zip(new, range(n, m)))
        self.chars += sum(map(len, new))

    def scores(self, texts: Sequence[str]) -> list[float]:
        if len(self.place) > self.most or self.chars > CACHE_CHARS:
            self._reset()
        found = [WORDS.findall(t) for t in texts]
        get = self.place.get
        if new := list(dict.fromkeys(w for words in found for w in words if w not in self.place)):
            self._learn(new)
        out = []
        for words in found:
            ids = np.fromiter(map(get, words), np.int64, len(words))
            repeats = int((ids[1:] == ids[:-1]).sum())
            total = self.sums[ids].sum() + self.folded[EVERY] + repeats * self.folded[REPEATED]
            out.append(float(1 / (1 + np.exp(-np.clip(total / (self.counts[ids].sum() + 1 + repeats), -50, 50)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = TRAIN_BYTES) -> Model:
    """The model of at most ``per_class`` labelled rows of each class and ``most_bytes`` of texts; no row held out, and no column but text, is learned from."""
    ok = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    first = lambda k: ok.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = first(0).unionByName(first(1)).withColumnRenamed("doc_id", "labelled")
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).join(F.broadcast(sample), F.col("id") == F.col("labelled"))
    texts = cut(texts.groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
    total = F.sum("bytes").over(Window.orderBy("bytes", "short"))  # over at most 2 * per_class numbers
    short = texts.select(F.col("id").alias("short"), F.octet_length("text").cast("long").alias("bytes")).withColumn("total", total)
    texts = texts.join(F.broadcast(short.where(F.col("total") <= most_bytes).select("short")), F.col("id") == F.col("short"))
    rows = sorted(((r.id, r.label, r.text) for r in texts.collect()), key=lambda r: r[0])
    return train([r[2] for r in rows], [r[1] for r in rows])


def _scores(model: tuple[np.ndarray | None, float]) -> Callable[[Sequence[str]], list[float]]:
    """What scores texts on an executor."""
    folded, constant = model
    gc.freeze()
    return (lambda texts: [constant] * len(texts)) if folded is None else Scorer(folded).scores


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast((model.folded(), model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = once(shared, _scores)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                found = scores(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged."""
    rows, model = docs.select(whole_row(docs)), fit(docs, labels)
    shared = rows.sparkSession.sparkContext.broadcast((model.folded(), model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = once(shared, _scores)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                texts = part.column(ROW).field("text").to_pylist()
                yield part.filter(pa.array([x >= threshold for x in scores([t or "" for t in texts])], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select(f"{ROW}.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
