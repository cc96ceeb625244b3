"""Bounded labelled samples, and models trained on them in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, size: int) -> DataFrame:
    """(doc_id, text, y) of at most ``size`` labelled documents, the first by a hash of their id.

    Rows with a null id or label are left out; of several labels or texts of one id the largest label and the smallest text count.
    ``size`` bounds what any later step holds; which rows come is the same in every run.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(rows: DataFrame, train: Callable[[pa.Array, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Runs ``train(texts, labels)`` in one task on a bounded sample and returns its float32 arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        texts = table["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        model = train(texts, table["y"].to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(model)), pa.array([np.asarray(v, np.float32).tobytes() for v in model.values()], pa.binary())], ["name", "data"]
        )

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "name string, data binary").collect()
    return {r["name"]: np.frombuffer(r["data"], np.float32) for r in found}
