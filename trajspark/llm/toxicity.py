"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence scores the logistic of the summed weights of its words and of their beginnings and endings; a document is toxic unless none of its sentences is (noisy-or). The
weights are learned from document labels alone, on a bounded sample, by mini-batch gradient ascent in NumPy; they stay at 0
or above, so that the harmless words beside an offending one don't excuse it. Scoring runs
in the tasks that read the texts and names the sentences that made a document toxic.
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

BITS = 18
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
EDGES = np.zeros(256, bool)
EDGES[list(b".,;:!?\"'()[]*-")] = True
LEAST = 0.003  # share of the sample's documents that a feature must be in to get a weight
START = -6.0  # log-odds of a sentence without known words, before training


PARTS = 4  # features of a word: itself, its first 4 and 5 bytes, its last 5


def sentences(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """(sentence of each word, table rows of each word and of its parts). A sentence ends after ``.``, ``!`` or ``?`` at the end of a word, at a line break, or with the text."""
    n = len(w.start)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros((0, PARTS), np.int64)
    breaks = np.concatenate(([0], np.cumsum(w.bytes == 10)))
    new = np.ones(n, bool)
    new[1:] = STOPS[w.bytes[w.end[:-1] - 1]] | (breaks[w.start[1:]] > breaks[w.end[:-1]]) | (w.owner[1:] != w.owner[:-1])
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        end -= EDGES[w.bytes[end - 1]] & (end - start > 1)
        start += EDGES[w.bytes[start]] & (end - start > 1)
    ranges = [(start, end), (start, np.minimum(start + 4, end)), (start, np.minimum(start + 5, end)), (np.maximum(end - 5, start), end)]
    total, inverse = w.prefix(tx.LOWER), tx.powers(tx.INVERSE, len(w.bytes) + 1)
    rows = [(tx.mixed((total[b] - total[a]) * inverse[a] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) for k, (a, b) in enumerate(ranges)]
    return np.cumsum(new) - 1, np.stack(rows, axis=1)


def train(texts: pa.Array, y: np.ndarray, passes: int = 96_000, batch: int = 64, rate: float = 0.5, decay: float = 1e-4, seed: int = 11) -> dict[str, np.ndarray]:
    """Word weights and bias by maximum likelihood of the document labels (adaptive steps); the same sample gives the same model.

    passes: documents seen in all, so that a small sample is gone through more often.
    """
    w = tx.Words(texts)
    sentence, row = sentences(w)
    pairs = np.unique(np.repeat(w.owner, PARTS) << BITS | row.ravel())
    usual = np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= max(3, LEAST * len(y))
    row = np.where(usual[row], row, 1 << BITS)  # one more row, always of weight 0
    weight, bias = np.zeros((1 << BITS) + 1), START
    seen, seen_bias = np.full((1 << BITS) + 1, 1e-3), 1.0
    rng = np.random.default_rng(seed)
    for _ in range(max(15, passes // max(1, len(y)))):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            docs = order[a : a + batch]
            at = np.concatenate([np.arange(w.begin[d], w.begin[d + 1]) for d in docs])
            if not len(at):
                continue
            ids, place = np.unique(sentence[at], return_inverse=True)
            holder = np.zeros(len(ids), np.int64)
            holder[place] = np.repeat(np.arange(len(docs)), w.counts[docs])
            z = bias + np.bincount(place, weight[row[at]].sum(axis=1), len(ids))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.bincount(holder, np.log1p(-np.minimum(p, 1 - 1e-9)), len(docs)))
            toxic = np.maximum(1 - clean, 1e-6)
            pull = np.where(y[docs] == 1, clean / toxic, -1.0)[holder] * p
            g = np.bincount(row[at].ravel(), np.repeat(pull[place], PARTS), (1 << BITS) + 1) - decay * weight
            g[-1] = 0
            seen += g * g
            weight = np.maximum(weight + rate * g / np.sqrt(seen), 0.0)
            seen_bias += pull.sum() ** 2
            bias += rate * pull.sum() / np.sqrt(seen_bias)
    return {"weight": weight[:-1], "bias": np.array([bias])}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", size: int = 6000) -> dict[str, np.ndarray]:
    """A model from at most ``size`` labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    rows = learning.sample(docs, labels, label, learning.fold(F.col("doc_id"), 4) != 2, size)
    return learning.fit(rows, train) or {"weight": np.zeros(1 << BITS, np.float32), "bias": np.full(1, START, np.float32)}


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3, offends: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` and ``offending``; columns of these names are replaced.

    offending: the sentences that score ``offends`` or more, as code point ranges with their score, in order. Null and empty
    texts have no sentences: score 0, nothing offending.
    """
    kept = docs.drop("score", "predicted", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value["weight"].astype(np.float64), float(shared.value["bias"][0])
        for part in tx.slices(batches, "text"):
            w = tx.Words(part["text"])
            sentence, row = sentences(w)
            n = int(sentence[-1]) + 1 if len(sentence) else 0
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, weight[row].sum(axis=1), n), -30, 30)))
            first = np.searchsorted(sentence, np.arange(n))
            final = np.append(first[1:], len(sentence)) - 1
            owner = w.owner[first]
            doc = 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), w.n))
            bad = np.flatnonzero(p >= offends)
            begins = np.concatenate(([0], np.cumsum((w.bytes & 0xC0) != 0x80)))
            base = begins[w.offsets[owner[bad]]]
            spans = pa.StructArray.from_arrays(
                [pa.array(begins[w.start[first[bad]]] - base), pa.array(begins[w.end[final[bad]]] - base), pa.array(p[bad])], fields=list(kind.value_type)
            )
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[bad], np.arange(w.n + 1)).astype(np.int32)), spans, kind)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(doc), pa.array((doc >= threshold).astype(np.int32)), found], [*part.schema.names, "score", "predicted", "offending"]
            )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    added = "score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>"
    return kept.mapInArrow(run, ", ".join([*columns, added]))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (learning.fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted", "offending")
