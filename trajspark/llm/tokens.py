"""Token ids of all texts as one array in blocks, with Elias-Fano coded document boundaries.

File format: a Parquet table in the shared folder, one row per block. A block holds the ids of consecutive documents
(ascending doc_id) end to end as little-endian unsigned integers, 2 bytes wide where the vocabulary allows it, else 4.
The end of each document within the block is kept in Elias-Fano form: low bits packed, high bits in unary. ``select``
returns any boundary from these bits and one small count per 64 bytes; no table of 64-bit offsets is stored.
Parquet carries the blocks because only Spark's writers reach every kind of shared storage and commit lost tasks safely.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm import text as tx
from trajspark.llm.storage import partitions, query, scratch
from trajspark.llm.text import ragged

BLOCK = 1 << 20  # ids after which a block is closed; a document is never split
END_ID = 2
DARK = ~tx.WHITE  # bytes that are no ASCII white space
DARK[[0, *range(0x1C, 0x20)]] = False
MAYBE_WHITE = np.zeros(256, bool)  # first bytes of the longer white space characters, among others
MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / count) bits each."""

    STRIDE = 64

    def __init__(self, count: int, universe: int, low: bytes, high: bytes):
        self.count, self.universe = count, universe
        self.width = EliasFano.low_width(count, universe)
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        ones = np.bitwise_count(self.high).astype(np.int64)
        pad = -len(ones) % self.STRIDE
        self.before = np.concatenate(([0], np.cumsum(np.pad(ones, (0, pad)).reshape(-1, self.STRIDE).sum(axis=1)))).astype(np.uint32)

    @staticmethod
    def low_width(count: int, universe: int) -> int:
        return max(0, (max(universe, 1) // max(count, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, width = len(values), cls.low_width(len(values), universe)
        bits = (values[:, None] >> np.arange(width)) & 1
        high = np.zeros((universe >> width) + n + 1, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return cls(n, universe, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def _lows(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(index), np.int64)
        for k in range(self.width):
            at = index * self.width + k
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << k
        return out

    def select(self, i):
        """The i-th value, or the values of an array of indexes: the stride of each from the counts, then its place in the stride."""
        index = np.atleast_1d(np.asarray(i, np.int64))
        if len(index) and not (0 <= index.min() and index.max() < self.count):
            raise IndexError(i)
        stride = np.searchsorted(self.before, index, "right") - 1
        near, row = np.unique(stride, return_inverse=True)
        high = np.pad(self.high, (0, -len(self.high) % self.STRIDE)).reshape(-1, self.STRIDE)[near]
        line, column = np.nonzero(np.unpackbits(high, axis=1, bitorder="little"))
        nth = np.searchsorted(line, np.arange(len(near)))[row] + index - self.before[stride]
        value = ((stride * self.STRIDE * 8 + column[nth] - index) << self.width) | self._lows(index)
        return value if np.ndim(i) else int(value[0])

    def values(self) -> np.ndarray:
        """All values in order."""
        index = np.arange(self.count)
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        return ((place - index) << self.width) | self._lows(index)


class Encoder:
    """The tokenizer's ids of whole texts, for many texts at once.

    A byte-level vocabulary never joins anything across the start of a single space or a line break between two other characters,
    nor between an ASCII letter and punctuation after it. Texts are cut there, equal pieces are found by hash and compared byte by
    byte, and only pieces that are not in the worker's table go to the tokenizer, in one call. The table has a fixed number of
    places; a new piece takes the place of an older one. A text that holds an added token of the vocabulary is not cut.
    """

    PLACES, IDS, BYTES, LONGEST = 21, 1 << 23, 1 << 24, 64  # bits of a place; what the table holds; longest piece in it

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind = Tokenizer.from_file(path), f"<u{width}"
        if not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or self.tokenizer.normalizer is not None:
            raise ValueError("not a byte-level vocabulary")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        places = 1 << self.PLACES
        self.key = np.zeros(places, np.uint64)
        self.id_at, self.id_n, self.byte_at, self.byte_n = (np.zeros(places, np.int32) for _ in range(4))
        self.ids, self.bytes = np.zeros(self.IDS, self.kind), np.zeros(self.BYTES, np.uint8)
        self.n_ids = self.n_bytes = 0

    def cuts(self, t: tx.Texts) -> np.ndarray:
        """Where pieces begin: at every text and at every place where nothing is ever joined."""
        b, n = t.bytes, len(t.bytes)
        back = lambda k: np.concatenate((np.zeros(min(k, n), np.uint8), b[: max(0, n - k)]))
        far, last, nxt = back(3), back(2), np.append(b[1:], np.uint8(0))
        before = DARK[back(1)] & ~((back(1) >= 0x80) & ((last == 0xC2) | MAYBE_WHITE[far]))
        inner = ~t.first()
        alone = before & DARK[nxt] & ~MAYBE_WHITE[nxt] & inner[:-1] & inner[1:]
        line = alone & (b == 0x0A)
        cut = line | (alone & (b == 0x20)) | (LETTER[back(1)] & MARK[b])
        cut[1:] |= line[:-1]
        raw = b.tobytes() if self.added else b""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(t.offsets, at, "right"))
                cut[t.offsets[k - 1] : t.offsets[k]] = False
                at = raw.find(token, int(t.offsets[k]))
        cut[t.offsets[:-1][t.offsets[1:] > t.offsets[:-1]]] = True
        return np.flatnonzero(cut)

    def fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.kind, int(n.sum())), n

    def keep(self, b: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        short = size <= self.LONGEST
        ids = ids[np.repeat(short, n)]
        key, start, size, n = key[short], start[short], size[short], n[short]
        if self.n_ids + len(ids) > self.IDS or self.n_bytes + size.sum() > self.BYTES:
            self.key[:] = 0
            self.byte_n[:] = 0
            self.n_ids = self.n_bytes = 0
            if len(ids) > self.IDS or size.sum() > self.BYTES:
                return
        # Of several pieces for one place the last stays; all its figures must be of one piece.
        place = (key >> np.uint64(64 - self.PLACES)).astype(np.int64)
        _, last = np.unique(place[::-1], return_index=True)
        last = len(place) - 1 - last
        at = place[last]
        self.key[at], self.id_n[at], self.byte_n[at] = key[last], n[last], size[last]
        self.id_at[at] = (self.n_ids + np.cumsum(n) - n)[last]
        self.byte_at[at] = (self.n_bytes + np.cumsum(size) - size)[last]
        text = b[ragged(start, size)]
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.bytes[self.n_bytes : self.n_bytes + len(text)] = text
        self.n_ids += len(ids)
        self.n_bytes += len(text)

    @staticmethod
    def equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of the byte ranges of at least one byte are equal."""
        if not len(size):
            return np.zeros(0, bool)
        differ = a[ragged(a_at, size)] != b[ragged(b_at, size)]
        return ~np.logical_or.reduceat(differ, np.cumsum(size) - size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has. Null and empty texts have none."""
        t = tx.Texts(texts)
        b = t.bytes
        if not len(b):
            return np.zeros(0, self.kind), np.zeros(t.n, np.int64)
        start = self.cuts(t)
        size = np.diff(np.append(start, len(b)))
        key = t.keys(start, start + size)
        _, one, group = np.unique(key, return_index=True, return_inverse=True)
        odd = size != size[one[group]]
        fits = np.flatnonzero(~odd)
        odd[fits] = ~self.equal(b, start[fits], b, start[one[group[fits]]], size[fits])
        if odd.any():  # equal hashes of different pieces: each of these is a group of its own
            own = np.flatnonzero(odd)
            group[own] = len(one) + np.arange(len(own))
            one = np.concatenate((one, own))
        place = (key[one] >> np.uint64(64 - self.PLACES)).astype(np.int64)
        hit = (self.key[place] == key[one]) & (self.byte_n[place] == size[one])
        at = np.flatnonzero(hit)
        hit[at] = self.equal(b, start[one[at]], self.bytes, self.byte_at[place[at]].astype(np.int64), size[one[at]])
        at, miss = np.flatnonzero(hit), np.flatnonzero(~hit)
        n = np.zeros(len(one), np.int64)
        n[at] = self.id_n[place[at]]
        known = self.ids[ragged(self.id_at[place[at]].astype(np.int64), n[at])]
        new = one[miss]
        raw = b.tobytes()
        ids, n[miss] = self.fresh([raw[x : x + k].decode() for x, k in zip(start[new].tolist(), size[new].tolist(), strict=True)])
        self.keep(b, key[new], start[new], size[new], ids, n[miss])
        pool_at = np.zeros(len(one), np.int64)
        pool_at[at] = np.cumsum(n[at]) - n[at]
        pool_at[miss] = len(known) + np.cumsum(n[miss]) - n[miss]
        out = np.concatenate((known, ids))[ragged(pool_at[group], n[group])]
        total = np.concatenate(([0], np.cumsum(n[group])))[np.searchsorted(start, t.offsets)]
        return out, np.diff(total)


def _encoder(tokenizer: str, width: int) -> Encoder:
    """The worker's encoder. It stays with its table for the tasks that follow, so a piece is encoded once by a worker, not by a task.

    Task functions travel by value, so it is held by a module that the worker imports itself.
    """
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held = vars(tokenizers).setdefault("_trajspark_encoders", {})
    if (tokenizer, width) not in held:
        held.clear()
        held[tokenizer, width] = Encoder(tokenizer, width)
    return held[tokenizer, width]


def write_blocks(docs: DataFrame, tokenizer: str, path: str, width: int = 2, end_id: int = END_ID) -> None:
    """Encodes ``doc_id`` and ``text`` and writes the blocks, in ascending doc_id order over all shards.

    Null and empty texts give the end id alone. Rows with one doc_id follow each other, ordered by text; a null doc_id comes
    first. tokenizer: a file at the same place on every machine. Only the two columns are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    names = ["shard", "block", "doc_ids", "n_ids", "ids", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, width)
        shard, block = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []  # ids of the open block, and of its documents the sizes
        sizes: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes))
            ef = EliasFano.encode(ends, int(ends[-1]))
            row = [shard, block, doc_ids, int(ends[-1]), np.concatenate(held).tobytes(), ef.low.tobytes(), ef.high.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for part in tx.slices(batches, "text"):
            ids, n = encoder.encode(part["text"])
            ids = np.insert(ids, np.cumsum(n), end_id)
            names_of, ends, done = part["doc_id"].to_pylist(), np.cumsum(n + 1), 0
            while done < len(n):
                base = int(ends[done - 1]) if done else 0
                upto = min(int(np.searchsorted(ends, base + BLOCK - total)) + 1, len(n))  # up to the document that fills the block
                doc_ids += names_of[done:upto]
                held.append(ids[base : ends[upto - 1]])
                sizes.append((n + 1)[done:upto])
                total, done = total + int(ends[upto - 1]) - base, upto
                if total >= BLOCK:
                    yield close()
                    doc_ids, held, sizes, total, block = [], [], [], 0, block + 1
        if doc_ids:
            yield close()
        tx.release()

    schema = "shard int, block int, doc_ids array<long>, n_ids long, ids binary, low binary, high binary"
    parts.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers. start: ids of all documents before it; it is the sum over
    earlier shards and blocks, which are few, plus the boundary that the block's Elias-Fano code gives.
    """
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["ids"], f"<u{width}").astype("<u4")
                bounds = EliasFano(len(row["doc_ids"]), row["n_ids"], row["low"], row["high"])
                index = np.arange(bounds.count)
                ends, starts = bounds.select(index), np.concatenate(([0], bounds.select(index[:-1])))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("block")
    bases = blocks.select("shard", "block", "n_ids", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("block_start"))
    bases = bases.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    found = blocks.select("shard", "block", "doc_ids", "n_ids", "ids", "low", "high").mapInArrow(
        run, "shard int, block int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    return found.join(bases, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_ids: list[int], width: int = 2) -> DataFrame:
    """(doc_id, ids array<int>) of the chosen documents: blocks that hold one of them, and in these only the ranges that select gives.

    A document that is stored several times comes as often; ids that are not stored, and null, give no row.
    """
    wanted = np.unique(np.array([d for d in doc_ids if d is not None], np.int64))
    blocks = spark.read.parquet(path).select("doc_ids", "n_ids", "ids", "low", "high")
    blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(d)) for d in wanted]).cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k] for c in batch.schema.names}
                names = row["doc_ids"].values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(np.isin(names, wanted))
                bounds = EliasFano(len(names), row["n_ids"].as_py(), row["low"].as_py(), row["high"].as_py())
                ends, start = bounds.select(at), np.where(at > 0, bounds.select(np.maximum(at - 1, 0)), 0)
                ids = np.frombuffer(row["ids"].as_buffer(), f"<u{width}")
                found = pa.array([ids[a:b].astype(np.int32) for a, b in zip(start, ends, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(names[at].astype(np.int64)), found], ["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<int>")


def token_output(docs: DataFrame, tokenizer: str, width: int = 2, end_id: int = END_ID) -> DataFrame:
    """Writes the blocks to a new shared folder and reads every document back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_blocks(docs, tokenizer, path, width, end_id)
    return read_documents(spark, path, width)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_ids")
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
