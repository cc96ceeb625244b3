"""Quality classifier by supervised subword embeddings.

A document's vector is the mean of the vectors of its features: words, pairs of neighbouring words (a word next to itself is one
feature for all words), and the 3- and 5-byte runs of words (with one white space on either side), each hashed to a row of an
embedding table. A softmax layer turns the vector into class
probabilities. Table and layer are learned together by stochastic gradient descent in NumPy, on a bounded sample.

With two classes the layer needs only one number per row, its vector times the difference of the class weights; scoring
adds these numbers over whole texts in the tasks that read them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import learning
from trajspark.llm import text as tx
from trajspark.llm.storage import query

BITS = 17
RUNS = (3, 5)
REPEAT = np.int32(0)  # the row of a word that is said again at once
PLAIN = tx.EXACT.copy()
PLAIN[tx.WHITE] = tx.EXACT[0x20]
STEP = 0x100000001B3  # odd multiplier of the byte runs


def features(w: tx.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte position, table row) of the features: the words, their pairs, then the runs of each length."""
    shift = np.uint64(64 - BITS)
    h = w.word_hashes(tx.LOWER)
    yield w.start, (w.word_hashes() >> shift).astype(np.int32)
    if len(h) > 1:
        at = np.flatnonzero(w.owner[1:] == w.owner[:-1])
        pair = tx.mixed(h[at] * np.uint64(3) + h[at + 1])
        yield w.start[at], np.where(h[at] == h[at + 1], REPEAT, (pair >> shift).astype(np.int32))
    size = len(w.bytes)
    value = PLAIN[w.bytes]
    last = np.repeat(w.offsets[1:], np.diff(w.offsets))
    white = np.concatenate(([0], np.cumsum(tx.WHITE[w.bytes], dtype=np.int32)))
    for n in RUNS:
        m = size - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(STEP) + value[k : k + m]
        at = np.flatnonzero((white[n - 1 : n - 1 + m] == white[1 : 1 + m]) & (np.arange(n, size + 1) <= last[:m]))
        h = h[at]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        yield at, (h >> shift).astype(np.int32)


def train(texts: pa.Array, y: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.6, seed: int = 7) -> dict[str, np.ndarray]:
    """Learns the embedding table and the softmax layer; the same sample gives the same model."""
    bags = []
    for k in range(len(texts)):
        rows = np.concatenate([r for _, r in features(tx.Words(texts.slice(k, 1)))] or [np.zeros(0, np.int32)])
        ids, n = np.unique(rows, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    total, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k]
            step = rate * (1 - done / total)
            done += 1
            hidden = share @ table[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y[k]] -= 1
            back = layer.T @ error
            layer -= step * np.outer(error, hidden)
            bias -= step * error
            # Each row's part of the mean is small; scaled up so that frequent and rare features both move.
            table[ids] -= step * np.sqrt(share)[:, None] * back
    return {"weight": table @ (layer[1] - layer[0]), "bias": np.array([bias[1] - bias[0]])}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", size: int = 3000) -> dict[str, np.ndarray]:
    """A model from at most ``size`` labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    rows = learning.sample(docs, labels, label, learning.fold(F.col("doc_id"), 5) != 0, size)
    return learning.fit(rows, train) or {"weight": np.zeros(1 << BITS, np.float32), "bias": np.zeros(1, np.float32)}


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted``; columns of these names are replaced.

    Null and empty texts have no features and get the score of the bias alone. Without any labelled row all scores are 0.5.
    """
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value["weight"], float(shared.value["bias"][0])
        for part in tx.slices(batches, "text"):
            w = tx.Words(part["text"])
            total, count = np.zeros(w.n), np.zeros(w.n, np.int64)
            for at, rows in features(w):
                edge = np.searchsorted(at, w.offsets)
                sums = np.concatenate(([0.0], np.cumsum(weight[rows], dtype=np.float64)))
                total += sums[edge[1:]] - sums[edge[:-1]]
                count += np.diff(edge)
            p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*columns, "score double, predicted int"]))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (learning.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
