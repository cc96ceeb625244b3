"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared word by word (A-Z lower-cased). Runs of a few words that both have are the
seeds; only pairs with enough seeds to reach the wanted coverage are tiled. Tiling marks the longest common run of unmarked
words again and again, down to the shortest run that counts, finding runs by running Karp-Rabin hashes. The marked part of
the item is its coverage: passages in another order are found as well as whole ones.

The benchmark is worked through in blocks of bounded size, each broadcast to a scan of the documents and given up before the
next, so its size changes the number of scans and not the memory. With one block documents are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import text as tx
from trajspark.llm.storage import query, written
from trajspark.llm.text import ragged

LEAST = 4  # words of a seed and of the shortest tile
COVERAGE = 0.5  # part of an item's words that makes a document contaminated
BLOCK_BYTES = 8 << 20  # text of the benchmark that is broadcast at once
BITMAP = 22
PAIRS = 1 << 20  # pairs of places looked at at a time


@dataclass
class Block:
    """Some benchmark items with an index of their seeds."""

    item_ids: list
    begin: np.ndarray  # first word of each item, and one past the last
    words: np.ndarray  # word hashes of all items
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # seed length: sorted hashes, places of their words, bitmap

    @classmethod
    def of(cls, item_ids: list, texts: pa.Array) -> Block:
        w = tx.Words(texts)
        h = w.word_keys(tx.LOWER)
        seeds = {}
        for k in range(1, LEAST + 1):
            at, value = w.windows(k, h)
            fits = w.counts[w.owner[at]] == k if k < LEAST else np.ones(len(at), bool)
            at, value = at[fits], value[fits]
            if len(at):
                order = np.argsort(value, kind="stable")
                bitmap = np.zeros(1 << BITMAP, bool)
                bitmap[value >> np.uint64(64 - BITMAP)] = True
                seeds[k] = value[order], at[order], bitmap
        return cls(item_ids, w.begin, h, seeds)

    def candidates(self, w: tx.Words, h: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(text, item) pairs whose common seeds could cover enough of the item."""
        for k, (value, place, bitmap) in self.seeds.items():
            at, got = w.windows(k, h)
            near = bitmap[got >> np.uint64(64 - BITMAP)]
            at, got = at[near], got[near]
            lo, hi = np.searchsorted(value, got, "left"), np.searchsorted(value, got, "right")
            hit = hi > lo
            if not hit.any():
                continue
            key = np.unique(np.stack([w.owner[at[hit]], lo[hit], hi[hit]]), axis=1)
            n = key[2] - key[1]
            text = np.repeat(key[0], n)
            where = place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(key[1], n)]
            item = np.searchsorted(self.begin, where, "right") - 1
            pairs, count = np.unique(np.stack([text, item]), axis=1, return_counts=True)
            size = self.begin[pairs[1] + 1] - self.begin[pairs[1]]
            enough = np.minimum(count * k, size) >= coverage * size
            yield from zip(pairs[0][enough].tolist(), pairs[1][enough].tolist(), strict=True)


def running(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, from one running sum."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * tx.powers(tx.BASE, len(words)), out=total[1:])
    n = len(words) - size + 1
    return (total[size:] - total[:n]) * tx.powers(tx.INVERSE, len(words) + 1)[:n]


def run_starts(a: np.ndarray, b: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) at which common runs of at least ``least`` words begin, about ``PAIRS`` at a time.

    Only pairs whose words before differ are formed: equal windows of b are sorted by the word before, and a window of a takes
    those on either side of its own. A repetitive text so gives one pair for each run, not one for each window of it.
    """
    if min(len(a), len(b)) < least:
        return
    ha, hb = running(a, least), running(b, least)
    _, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    before_a = np.concatenate(([0], code[: len(ha) - 1] + 2))  # 0 and 1: no word before, and never equal
    before_b = np.concatenate(([1], code[len(a) : len(a) + len(hb) - 1] + 2))
    _, window = np.unique(np.concatenate((ha, hb)), return_inverse=True)
    many = np.int64(code.max() + 3)
    key_a, key_b = window[: len(ha)] * many + before_a, window[len(ha) :] * many + before_b
    order = np.argsort(key_b, kind="stable")
    key_b = key_b[order]
    first, last = window[: len(ha)] * many, (window[: len(ha)] + 1) * many
    cut = [np.searchsorted(key_b, x, side) for x, side in ((first, "left"), (key_a, "left"), (key_a, "right"), (last, "left"))]
    low, high = cut[1] - cut[0], cut[3] - cut[2]
    total = np.cumsum(low + high)
    done = 0
    while done < len(total) and total[-1]:
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        at = np.arange(done, upto)
        left = np.concatenate((np.repeat(at, low[at]), np.repeat(at, high[at])))
        yield left, order[np.concatenate((ragged(cut[0][at], low[at]), ragged(cut[2][at], high[at])))]
        done = upto


def run_lengths(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x in a and y in b are equal; words are compared themselves, the fewer pairs are left the more at a time."""
    length, most = np.zeros(len(x), np.int64), np.minimum(len(a) - x, len(b) - y)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        step = np.arange(max(1, min(4096, 65536 // len(open_))))
        at = length[open_, None] + step
        inside = at < most[open_, None]
        i, j = np.where(inside, x[open_, None] + at, 0), np.where(inside, y[open_, None] + at, 0)
        differ = ~inside | (a[i] != b[j])
        stop = differ.any(axis=1)
        length[open_] += np.where(stop, differ.argmax(axis=1), len(step))
        open_ = open_[~stop]
    return length


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles, longest first; of equal lengths the first in a, then in b, is marked first.

    All maximal common runs wait in a queue by length. One that tiles have cut into goes back to the queue as the parts that are
    left of it, so a shorter run is never marked before a longer rest. Memory follows the number of maximal runs.
    """
    waiting = []
    for x, y in run_starts(a, b, least):
        length = run_lengths(a, b, x, y)
        enough = length >= least  # equal hashes of different windows fall out here
        waiting += zip((-length[enough]).tolist(), x[enough].tolist(), y[enough].tolist(), strict=True)
    heapq.heapify(waiting)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    left = min(len(a), len(b))
    found = []
    while waiting and left >= least:
        length, x, y = heapq.heappop(waiting)
        free = free_a[x : x - length] & free_b[y : y - length]
        if free.all():
            free_a[x : x - length] = free_b[y : y - length] = False
            left += length
            found.append((x, y, -length))
        elif free.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
            for k, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if end - k >= least:
                    heapq.heappush(waiting, (k - end, x + k, y + k))
    return found


def matches(block: Block, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words of the item, words covered, tiles) of the contaminated texts."""
    w = tx.Words(texts)
    h = w.word_keys(tx.LOWER)
    for text, item in block.candidates(w, h, coverage):
        words = block.words[block.begin[item] : block.begin[item + 1]]
        found = tiles(words, h[w.begin[text] : w.begin[text + 1]], min(LEAST, len(words)))
        covered = sum(t[2] for t in found)
        if covered >= coverage * len(words):
            yield text, item, len(words), covered, len(found)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[Block, bool]]:
    """(block, whether there are several) of about ``limit`` bytes of text, one at a time; items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = part.orderBy("item_id", "text").collect()
        yield Block.of([r["item_id"] for r in got], pa.array([r["text"] for r in got], pa.string())), n > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) of every pair at or above the coverage.

    Null and empty texts or items match nothing. An item of fewer than ``LEAST`` words must be there as a whole. Repeated
    documents or items give repeated rows; without any match, and for empty tables, there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, item_words int, covered_words int, tiles int, coverage double"
    out = spark.createDataFrame([], schema)
    for block, more in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in tx.slices(batches, "text"):
                got = list(matches(shared.value, part["text"], coverage))
                if got:
                    text, item, n, covered, count = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"].take(pa.array(text)), pa.array([shared.value.item_ids[i] for i in item], pa.int64()), pa.array(n, pa.int32()),
                         pa.array(covered, pa.int32()), pa.array(count, pa.int32()), pa.array([c / m for c, m in zip(covered, n, strict=True)], pa.float64())],
                        ["doc_id", "item_id", "item_words", "covered_words", "tiles", "coverage"],
                    )

        found = rows.mapInArrow(run, schema)
        if more:  # the block's rows are written, and executors and driver can forget it
            found = written(found, "tiles")
            shared.destroy()
        out = out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents, with all their columns, that no item covers enough. Null and empty texts stay, repeated rows stay or go together.

    One scan for each block of the benchmark. With several blocks, the digests of the texts that a block rejects are written, and
    the documents are joined with these at the end, so no block outlives its scan.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rejected = None
    for block, more in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, clean_ones=not more) -> Iterator[pa.RecordBatch]:
            for part in tx.slices(batches, "text"):
                clean = np.ones(part.num_rows, bool)
                for text, *_ in matches(shared.value, part["text"], coverage):
                    clean[text] = False
                yield part.filter(pa.array(clean == clean_ones))

        if not more:
            return docs.mapInArrow(run, schema)
        found = docs.select("text").mapInArrow(run, "text string").select(_digest().alias("_rejected"))
        found = written(found.distinct(), "rejected")
        shared.destroy()
        rejected = found if rejected is None else rejected.unionByName(found)
    return docs if rejected is None else docs.join(rejected, _digest() == F.col("_rejected"), "left_anti")


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


@query("op6_string_tiling")
def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document: the items it holds and how much of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("covered_words").alias("covered_words"),
        F.max("tiles").alias("tiles"), F.lit(True).alias("contaminated"),
    )
