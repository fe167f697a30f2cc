"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word-boundary marks) and itself, each hashed
to a row of one embedding table; a document is the average of its words. A linear layer with a
softmax tells toxic from clean, and table and layer are trained jointly, in numpy, by full-batch
Adam (falling rate) on a bounded sample of labelled rows, in one task. An unseen misspelling shares most n-grams with the
word that it stands for, and so its vector.

Only the training sample is bounded (`TRAIN_ROWS`, chosen by a seeded hash of doc_id). Scoring
reads every text whole, in the tasks that read the table, with no shuffle: the model is linear
in the words, so each word has one number, worked out once per worker.

Rows: a null or empty text has no words and gets the score of the prior alone. Repeated rows
are scored each. Labels that are null teach nothing; of a doc_id labelled twice the larger label
counts. Without labels of both kinds the score is the smoothed share of label 1, for every text.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import column, seeded

TRAIN_ROWS = 8_000
BUCKETS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 6)
MIN_DOCUMENTS = 3
STEPS = 160
RATE = 0.1
#: Pull of the table and the layer towards 0; it holds back words seen in few documents.
PENALTY = 3e-6
#: Neutral words added to each document, so that a few words of no known kind decide nothing.
PAD = 5
EVEN = 0.5
SEED = 7
KEPT_WORDS = 500_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def subwords(word: str) -> list[int]:
    """Table rows of a word: its n-grams and itself."""
    marked = f"<{word}>"
    size, (low, high) = len(marked), GRAMS
    whole = marked.encode("utf-8", "surrogatepass")
    if len(whole) == size:              # one byte a character
        grams = dict.fromkeys([whole[i:i + n] for n in range(low, high + 1)
                               for i in range(size - n + 1)])
    else:
        grams = dict.fromkeys([marked[i:i + n].encode("utf-8", "surrogatepass")
                               for n in range(low, high + 1) for i in range(size - n + 1)])
    grams[whole] = None
    return [zlib.crc32(g) % BUCKETS for g in grams]


@dataclass
class Model:
    prior: float
    #: Per table row, what it adds to the logit of toxic; None: prior alone.
    weights: np.ndarray | None

    def word(self, word: str) -> float:
        rows = subwords(word)
        return sum([self.plain[r] for r in rows]) / len(rows)

    @cached_property
    def plain(self) -> list[float]:
        return self.weights.tolist()

    def __getstate__(self) -> dict:
        return {"prior": self.prior, "weights": self.weights}


def train(texts: list[str], labels: np.ndarray) -> Model:
    ones = int(labels.sum())
    share = np.log((ones + 0.5) / (len(labels) - ones + 1.5))
    if not ones or ones == len(labels):
        return Model(float(share), None)
    # Words by document, as hashes; a document's words weigh 1 / its length each.
    hashes, weights_, sizes = [], [], []
    for text in texts:
        words = words_of(text)
        bag = Counter(words)
        hashes.append(np.fromiter(map(_hash, bag), np.uint64, len(bag)))
        weights_.append(np.array(list(bag.values()), np.float32) / (len(words) + PAD))
        sizes.append(len(bag))
    every, what, documents = np.unique(np.concatenate(hashes), return_inverse=True,
                                       return_counts=True)
    who, weight = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.concatenate(weights_)
    kept = documents >= MIN_DOCUMENTS
    there = kept[what]
    if not there.any():
        return Model(float(share), None)
    who, weight = who[there], weight[there]
    what = (np.cumsum(kept) - 1)[what[there]].astype(np.int32)
    # Only the words that are kept are held as text.
    wanted = dict.fromkeys(every[kept].tolist())
    del hashes, weights_, every, documents, there
    for text in texts:
        for word in set(words_of(text)):
            h = _hash(word)
            if h in wanted:
                wanted[h] = word
    # Table rows by word.
    rows = [np.array(subwords(w), np.int32) for w in wanted.values()]
    del wanted
    counts = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    used, flat = np.unique(flat, return_inverse=True)
    flat = flat.astype(np.int32)
    by_row = np.argsort(flat, kind="stable")
    word_by_row = np.repeat(np.arange(len(rows), dtype=np.int32), counts)[by_row]
    del rows, by_row
    inverse = (1.0 / counts).astype(np.float32)
    # Where each run of equal numbers starts: rows of a word, words of a row, and so on.
    starts = np.cumsum(counts) - counts
    row_starts = np.unique(np.repeat(np.arange(len(used)), np.bincount(flat)), return_index=True)[1]
    by_word = np.argsort(what, kind="stable")
    who_by_word, weight_by_word = who[by_word], weight[by_word]
    seen_words, word_starts = np.unique(what[by_word], return_index=True)
    seen_texts, text_starts = np.unique(who, return_index=True)
    del by_word

    random = np.random.default_rng(SEED)
    # One array per dimension: sums run over contiguous numbers, and little is held at a time.
    table = random.normal(0, 0.1, (DIMENSIONS, len(used))).astype(np.float32)
    layer = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0.0, share], np.float32)
    # Both labels weigh alike in a part of the loss, by their numbers in the rest.
    each = np.where(labels == 1, 1 - EVEN + EVEN * len(labels) / (2 * ones),
                    1 - EVEN + EVEN * len(labels) / (2 * (len(labels) - ones))).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, layer, bias)]
    slope_table = np.empty_like(table)
    mean = np.zeros((len(texts), DIMENSIONS), np.float32)
    for step in range(1, STEPS + 1):
        for d in range(DIMENSIONS):
            vectors = np.add.reduceat(table[d][flat], starts) * inverse
            mean[seen_texts, d] = np.add.reduceat(vectors[what] * weight, text_starts)
        logits = mean @ layer + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        odds[np.arange(len(texts)), labels] -= 1
        slope = odds * (each / each.sum())[:, None]
        to_mean = slope @ layer.T
        to_words = np.zeros(len(counts), np.float32)
        for d in range(DIMENSIONS):
            to_words[seen_words] = np.add.reduceat(
                to_mean[:, d][who_by_word] * weight_by_word, word_starts)
            slope_table[d] = np.add.reduceat((to_words * inverse)[word_by_row], row_starts)
        slope_table += PENALTY * table
        slopes = (slope_table, mean.T @ slope + PENALTY * layer, slope.sum(0))
        for p, g, (m, v) in zip((table, layer, bias), slopes, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (1 - (step - 1) / STEPS) * (m / (1 - 0.9 ** step)) / (
                np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = (layer[:, 1] - layer[:, 0]) @ table
    return Model(float(bias[1] - bias[0]), weights)


class _Known(dict):
    """What each word adds to the logit, worked out when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = self.model.word(word)
        return value


def score_texts(texts: list[str | None], model: Model, known: dict | None = None) -> np.ndarray:
    known = _Known(model) if known is None else known
    out = np.full(len(texts), model.prior)
    if model.weights is not None:
        for i, text in enumerate(texts):
            words = words_of(text or "")
            if words:
                out[i] += sum(map(known.__getitem__, words)) / (len(words) + PAD)
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: one in five, by a checksum of the id."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    return F.coalesce(crc % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Train on at most `limit` labelled rows, in the order of a seeded hash of doc_id."""
    sample = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(
        seeded(SEED, F.col("doc_id")), "doc_id").limit(limit)
    # At most `limit` ids: small by construction.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(
        F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # One row per id, so one task holds them all; the driver gets the model alone.
    fitted = rows.repartition(1).mapInArrow(_fit, "prior double, weights binary").collect()
    if not fitted:
        return train([], np.array([], np.int64))
    prior, weights = fitted[0]
    return Model(prior, None if weights is None else np.frombuffer(weights, np.float32))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (`doc_id`, `text`, `toxic`), in the order of their ids."""
    rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    model = train([text for _, text, _ in rows],
                  np.array([toxic > 0 for *_, toxic in rows], np.int64))
    weights = None if model.weights is None else model.weights.tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.prior], pa.float64()), pa.array([weights], pa.binary())],
        names=["prior", "weights"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `score` of every row."""
    cell = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(cell.value)
        for batch in batches:
            scores = score_texts(batch.column(1).to_pylist(), cell.value, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)],
                                             names=["doc_id", "score"])

    return docs.select(column(doc_id).cast("long").alias("doc_id"),
                       column(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs`, whole, with a score below 0.5."""
    cell = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(cell.value)
        for batch in batches:
            scores = score_texts(batch.column(place).to_pylist(), cell.value, known)
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
