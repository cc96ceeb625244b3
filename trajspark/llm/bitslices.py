"""Ranked search by terms over bit-sliced Bloom signatures.

Index: documents are dealt into blocks of similar size. A document's signature has a few bits for each of its terms, and again for each
power of two that the term's count reaches. A block stores the signatures by slices: slice b is a bitmap of the documents that have
bit b. Beside them lie the terms and counts of each document, as hashes of 64 bits that depend on every byte and its place.

Search: the bitmaps of a term's slices, combined by AND, tell which documents may hold it and at most how often. Summing the weights of the
terms over the slices bounds every document's score from above. A task goes through its blocks with the best exact scores so far;
documents whose bound lies below the worst of these can't be among the best, all others are scored exactly from their terms.

The items are worked through in blocks of bounded size, each broadcast to a scan of the index, so their number changes the number of
scans only. Null texts and texts without terms are in no result; items without terms have no rows. Rows that repeat an id are
documents, or items, of their own. Documents without an id come last among equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm import text as tx
from trajspark.llm.storage import query, written

BEST = 20
HASHES, BITS_A_TERM = 3, 12
LEAST_SLICES, MOST_SLICES = 64, 1 << 21
BLOCK_DOCS, BLOCK_TERMS = 512, 1 << 17  # documents, and their different terms, in a block
HELD = 1 << 19  # terms of documents that a task deals into blocks at once
ITEM_BYTES, ITEMS = 1 << 18, 2048  # of the items that are broadcast at once
FIRST = 2 * BEST  # documents of an item that are scored before the others of a block, to raise the bar

PART = np.zeros(256, bool)
PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


class Terms(tx.Texts):
    """Hashes of the terms of a column of texts (``value``) and whose they are (``owner``)."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        first, dark = self.first(), PART[self.bytes]
        before = np.concatenate(([False], dark[:-1])) if len(dark) else dark
        start = np.flatnonzero(dark & (~before | first[:-1]))
        self.owner = np.searchsorted(self.offsets, start, side="right") - 1
        at = np.flatnonzero(dark)
        begin = np.searchsorted(at, start)
        size = np.diff(np.append(begin, len(at)))
        place = (np.arange(len(at)) - np.repeat(begin, size)).astype(np.uint64)
        letter = tx.mixed(tx.LOWER[self.bytes[at]] ^ (place * STEP))
        self.value = tx.mixed(np.add.reduceat(letter, begin) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, term, count) of the different terms of every text, in this order."""
        order = np.lexsort((self.value, self.owner))
        owner, value = self.owner[order], self.value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        return owner[at], value[at], np.diff(np.append(at, len(value)))


def slices_of(term: np.ndarray, level: np.ndarray | int, m: int) -> np.ndarray:
    """The slices of terms that occur 2**level times or more, among m."""
    h = tx.mixed(term + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * STEP)
    return np.stack([(h >> np.uint64(21 * k)).astype(np.int64) & (m - 1) for k in range(HASHES)], axis=1)


def _signatures(owner: np.ndarray, term: np.ndarray, count: np.ndarray, docs: int) -> tuple[int, np.ndarray]:
    """(number of slices, packed slices) of the documents of a block."""
    levels = np.frexp(count)[1]  # powers of two up to the count
    pair = np.repeat(np.arange(len(term)), levels)
    level = np.arange(len(pair)) - np.repeat(np.cumsum(levels) - levels, levels)
    most = int(np.bincount(owner, weights=levels, minlength=docs).max())
    m = 1 << int(np.clip(BITS_A_TERM * most, LEAST_SLICES, MOST_SLICES) - 1).bit_length()
    bits = np.zeros((m, docs), bool)
    for at in slices_of(term[pair], level, m).T:
        bits[at, owner[pair]] = True
    return m, np.packbits(bits, axis=1)


SCHEMA = "docs int, total long, ids array<long>, sizes binary, m int, slices binary, begin binary, terms binary, counts binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def index(docs: DataFrame) -> DataFrame:
    """The blocks of a table with (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            ids = [i for h in held for i in h[0]]
            sizes = np.concatenate([h[1] for h in held])
            different = np.concatenate([h[2] for h in held])
            term, count = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            begin = np.concatenate(([0], np.cumsum(different)))
            order = np.argsort(different, kind="stable")
            order = order[different[order] > 0]
            total = np.cumsum(different[order])
            a = 0
            while a < len(order):
                full = int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_TERMS, side="right"))
                b = min(max(full, a + 1), a + BLOCK_DOCS)
                own = order[a:b]
                n = different[own]
                at = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                m, packed = _signatures(np.repeat(np.arange(len(own)), n), term[at], count[at], len(own))
                cells = [len(own), int(sizes[own].sum()), [ids[i] for i in own], sizes[own].astype("<i8").tobytes(), m, packed.tobytes()]
                cells += [np.concatenate(([0], np.cumsum(n))).astype("<i8").tobytes(), term[at].astype("<u8").tobytes(), count[at].astype("<u4").tobytes()]
                kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], NAMES)
                a = b

        for part in tx.slices(batches, "text"):
            t = Terms(part["text"])
            owner, term, count = t.counted()
            held.append((part["doc_id"].to_pylist(), np.bincount(t.owner, minlength=t.n), np.bincount(owner, minlength=t.n), term, count))
            size += len(term)
            if size >= HELD:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA), "signatures")


@dataclass
class Items:
    """Some items: their different terms, and which item weighs which term how much."""

    keys: list  # id of each item
    terms: np.ndarray  # sorted
    item: np.ndarray  # (item, term, weight), by item
    term: np.ndarray
    weight: np.ndarray
    documents: int
    words: int

    def __post_init__(self):
        self.by_term = np.argsort(self.term, kind="stable")
        self.term_begin = np.searchsorted(self.term[self.by_term], np.arange(len(self.terms) + 1))
        self.item_begin = np.searchsorted(self.item, np.arange(len(self.keys) + 1))

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return 75 + (25 * sizes * self.documents) // self.words

    def scores(self, term: np.ndarray, doc: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """(item, document) sums of weight times part over (term, document, part) rows."""
        n = self.term_begin[term + 1] - self.term_begin[term]
        at = self.by_term[np.repeat(self.term_begin[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        out = np.zeros(len(self.keys) * docs, np.int64)
        np.add.at(out, self.item[at] * docs + np.repeat(doc, n), self.weight[at] * np.repeat(part, n))
        return out.reshape(len(self.keys), docs)


def share(count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term gives for its count in a document of this length; grows with the count."""
    return (1_000_000_000 * count) // (1000 * count + 12 * length)


def bounds(items: Items, m: int, packed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(item, document) upper bounds of the scores, from the slices alone."""
    docs, length = len(sizes), items.lengths(sizes)
    open_ = np.arange(len(items.terms))
    there = np.full((len(open_), packed.shape[1]), 255, np.uint8)
    level, term, doc, part = 0, [], [], []
    while len(open_):
        at = slices_of(items.terms[open_], level, m)
        there = there & np.bitwise_and.reduce(packed[at], axis=1)
        some = there.any(1)
        open_, there = open_[some], there[some]
        which, d = np.nonzero(np.unpackbits(there, axis=1, count=docs))
        most = share(np.minimum((2 << level) - 1, sizes[d]), length[d])
        if level:  # of the same terms and documents, the bound of the level below gives way
            most = most - share(np.minimum((1 << level) - 1, sizes[d]), length[d])
        term.append(open_[which])
        doc.append(d)
        part.append(most)
        level += 1
    return items.scores(np.concatenate(term), np.concatenate(doc), np.concatenate(part), docs) if term else np.zeros((len(items.keys), docs), np.int64)


def exact(items: Items, docs: np.ndarray, sizes: np.ndarray, begin: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(item, document) scores of the documents with these numbers in the block."""
    n = begin[docs + 1] - begin[docs]
    at = np.repeat(begin[docs] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    doc = np.repeat(np.arange(len(docs)), n)
    found = np.minimum(np.searchsorted(items.terms, terms[at]), len(items.terms) - 1)
    hit = items.terms[found] == terms[at]
    doc, found, count = doc[hit], found[hit], counts[at][hit].astype(np.int64)
    return items.scores(found, doc, share(count, items.lengths(sizes[docs])[doc]), len(docs))


def _best(batches: Iterator[pa.RecordBatch], items: Items, best: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each item among the blocks of a task."""
    top: list[list[tuple]] = [[] for _ in items.keys]  # (-score, no id, id), ascending
    bar = np.ones(len(items.keys), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch["ids"][row].as_py()
            sizes, begin = (np.frombuffer(batch[c][row].as_py(), "<i8") for c in ("sizes", "begin"))
            terms, counts = np.frombuffer(batch["terms"][row].as_py(), "<u8"), np.frombuffer(batch["counts"][row].as_py(), "<u4")
            packed = np.frombuffer(batch["slices"][row].as_py(), np.uint8).reshape(batch["m"][row].as_py(), -1)
            bound = bounds(items, len(packed), packed, sizes)
            done = np.zeros(len(ids), bool)
            for first in (True, False):
                wanted = bound >= bar[:, None]
                if first and len(ids) > FIRST:
                    near = np.argpartition(bound, len(ids) - FIRST, axis=1)[:, -FIRST:]
                    chosen = np.zeros(bound.shape, bool)
                    np.put_along_axis(chosen, near, True, axis=1)
                    wanted &= chosen
                docs = np.flatnonzero(wanted.any(0) & ~done)
                if not len(docs):
                    continue
                done[docs] = True
                score = exact(items, docs, sizes, begin, terms, counts)
                item, at = np.nonzero(score >= bar[:, None])
                for i, d, s in zip(item.tolist(), docs[at].tolist(), score[item, at].tolist(), strict=True):
                    top[i].append((-s, ids[d] is None, ids[d] or 0))
                for i in set(item.tolist()):
                    top[i] = sorted(top[i])[:best]
                    if len(top[i]) == best:
                        bar[i] = -top[i][-1][0]
    rows = [(i, None if no else d, -s) for i, t in enumerate(top) for s, no, d in t]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])
    tx.release()


def _counts(blocks: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of the terms."""
    shared = blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for cell in batch["terms"]:
                got = np.frombuffer(cell.as_py(), "<u8")
                found = np.minimum(np.searchsorted(shared.value, got), len(n) - 1)
                n += np.bincount(found[shared.value[found] == got], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in blocks.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        out[r["term"]] = r["n"]
    return out


def search(blocks: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of an index for each row of a table with (item_id, text)."""
    spark = blocks.sparkSession
    kind = dict(items.select("item_id").dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    total = blocks.agg(F.sum("docs"), F.sum("total")).first()
    rows = items.select("item_id", "text").where(F.octet_length("text") > 0)
    size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(-(-size[0] // ITEMS), -(-(size[1] or 0) // ITEM_BYTES)) if total[0] else 0
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        t = Terms(pa.array([r["text"] for r in got], pa.string()))
        owner, term, count = t.counted()
        if not len(term):
            continue
        terms = np.unique(term)
        weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1))) for df in _counts(blocks, terms).tolist()], np.int64)
        number = np.searchsorted(terms, term)
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in got], terms, owner, number, weights[number] * count, total[0], total[1]))
        found = blocks.mapInArrow(lambda batches, shared=shared: _best(batches, shared.value, best), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best), "ranked")
        keys = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(got)], f"item long, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(keys), "item").select("item_id", "rank", "doc_id", "score"))  # ITEMS rows, more by chance only
        shared.unpersist()
    return out


ORACLE = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
  terms AS (SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM words),
  tf AS (SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY ALL),
  docs AS (SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE kind = 'd' GROUP BY id),
  total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
  weights AS (SELECT q.id AS item_id, q.term, q.tf AS times, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * coalesce(df, 0) + 1)))::BIGINT AS w
    FROM tf q LEFT JOIN (SELECT term, count(*) AS df FROM tf WHERE kind = 'd' GROUP BY term) USING (term), total WHERE q.kind = 'q'),
  scored AS (SELECT item_id, d.id AS doc_id, sum(times * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
    FROM weights JOIN tf d USING (term) JOIN docs ON docs.id = d.id, total WHERE d.kind = 'd' GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


@query("op13_bit_slices", ORACLE)
def op13_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item, over all documents."""
    blocks = index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return search(blocks, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
