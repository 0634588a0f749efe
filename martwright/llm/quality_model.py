"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, as_bytes

BITS = 18
# Labelled rows that train, at most: those with the smallest hash of their doc_id.
TRAIN_ROWS = 20_000
TRAINERS = 4
EPOCHS = 3
_CACHE_WORDS = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0x1B873593, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)
_UPPER, _LOWER, _DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")


class _Words(dict):
    """Word → its hash and the hash of its shape (letter case, digits and marks)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))
        found = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape)
        if len(word) <= 64:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _grams(stream: np.ndarray, salt: int) -> np.ndarray:
    """Bucket of each one- and two-word gram of a stream of hashes."""
    one = (stream ^ _SALTS[salt]) * _MIX
    two = (stream[:-1] * np.uint64(31) + stream[1:] ^ _SALTS[salt]) * _MIX
    return (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: n-grams of its words, of their shapes, and of old and new.

    The third stream says for each word and each pair whether the text had it before. Each stream's
    counts have length one, so long and short texts weigh the same; bucket 0 is the constant.
    """
    words = text.split()
    buckets, values = [np.zeros(1, np.int64)], [np.ones(1)]
    if words:
        pairs = np.array(list(map(_words().__getitem__, words)), np.uint64)
        streams = [pairs[:, 0], pairs[:, 1]]
        two = pairs[:-1, 0] * np.uint64(31) + pairs[1:, 0]
        for salt, stream in enumerate([*streams, pairs[:, 0], two]):
            if not len(stream):
                continue
            if salt >= 2:
                _, first = np.unique(stream, return_index=True)
                old = np.ones(len(stream), np.uint64)
                old[first] = 2
                stream = old
            found, counts = np.unique(_grams(stream, salt), return_counts=True)
            buckets.append(found)
            values.append(counts / np.sqrt(np.dot(counts, counts)))
    return np.concatenate(buckets), np.concatenate(values)


class Ftrl:
    """Logistic regression by follow-the-regularised-leader, one coordinate's rate each."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        weight = self.weights(at)
        slope = (sigmoid(np.dot(weight, value)) - label) * value
        n = self.n[at]
        rate = (np.sqrt(n + slope * slope) - np.sqrt(n)) / self.alpha
        np.add.at(self.z, at, slope - rate * weight)
        np.add.at(self.n, at, slope * slope)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Learn row by row; memory holds the model and one batch, whatever the texts' length."""
    model, n = Ftrl(), 0
    for part in batches:
        for text, label in zip(part.column("text"), part.column("label").to_pylist()):
            model.learn(*features(text.as_py()), float(label))
            n += 1
    if n:
        weights = model.weights(slice(None)).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([weights], pa.binary())], names=["n", "weights"]
        )


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the hashed n-grams, learnt from at most ``rows`` labelled rows.

    The rows are chosen by a hash of doc_id, evenly over the table, and their ids are few
    enough to broadcast. ``TRAINERS`` tasks learn on a share each, and the weights are averaged by
    their rows; those are all that reaches the driver. Without labelled rows all weights are zero.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("label"))
        .dropna()
        .filter(~held_out())
        .orderBy(order, "doc_id", "label")
        .limit(rows)
    )
    # At most `rows` rows of two numbers.
    known = docs.select(F.col("doc_id").cast("long"), as_bytes()).join(F.broadcast(chosen), "doc_id")
    # A doc_id that occurs often counts once.
    known = known.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(TRAINERS)).cast("int")
    shares = known.repartitionById(TRAINERS, share)
    # Each epoch passes the share again, in the same order; the rows are shuffled once.
    shares = shares.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    shares = shares.sortWithinPartitions("epoch", F.xxhash64("doc_id", F.lit(2)), "doc_id", "label", "text")
    models = arrow_map(shares.select("text", "label"), _train, "n long, weights binary").collect()
    total = sum(m["n"] for m in models)
    out = np.zeros(1 << BITS, np.float32)
    for m in sorted(models, key=lambda m: (m["n"], bytes(m["weights"]))):
        out += np.frombuffer(m["weights"], "<f4") * np.float32(m["n"] / total)
    return out


def score_text(text: bytes, weights: np.ndarray) -> float:
    at, value = features(text)
    return sigmoid(np.dot(weights[at], value))


def _score(model: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = model.value
    for rows in batches:
        scores = [score_text(text.as_py(), weights) for text in rows.column("text")]
        arrays = [rows.column(c) for c in rows.schema.names if c != "text"]
        names = [c for c in rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64())], names=[*names, "score"])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` of every row from its text alone; the weights are 2^18 floats, broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes())
    return arrow_map(rows, partial(_score, model), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    NULL and empty texts get the score of the constant alone. Repeated rows get equal scores; a
    NULL doc_id is scored, not learnt from, and held_out is then false. Without labels every score is
    0.5 and predicted 1. An empty table gives no rows. Other columns are not read.
    """
    return score(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _score_docs(model: Broadcast, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        docs = rows.column("doc")
        texts = docs.field(at).cast(pa.binary())
        kept = [score_text(text.as_py() or b"", model.value) >= 0.5 for text in texts]
        yield pa.RecordBatch.from_arrays([docs.filter(pa.array(kept, pa.bool_()))], names=["doc"])
    # Later stages run in the same workers.
    _words.cache_clear()


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts; columns unchanged, whole rows sent to Python once."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    at = [c.lower() for c in docs.columns].index("text")
    return arrow_map(rows, partial(_score_docs, model, at), rows.schema).select("doc.*")
