"""Removal of long byte strings that a corpus holds more than once, found with run-length compressed indexes.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else, in the same text or another one.

1. The anchor of such a string is the smallest hash of its ``GRAM``-byte substrings, so equal strings have equal anchors. Consecutive
   starts with one anchor form a piece: the bytes from its first start to the end of its last string. Every start is in one piece.
2. Anchors are counted in packed form. Pieces whose anchor no other piece can have are not sent on: a bitmap of bounded size tells
   them, and a bit shared by two anchors only sends more. A piece may also hold a string twice by itself, as in a short run of one
   character; its anchor then lies at two places close together, which is told beside the count.
3. The other pieces meet by anchor. Each task takes whole groups of an anchor, keeps equal pieces once with their number, and builds a
   run-length index of about ``BATCH`` bytes: the runs of the Burrows-Wheeler transform with the suffixes at the ends of its runs and
   the common prefixes there. Within a run a common prefix loses one byte with each byte of the text, so the matching statistics
   of all positions stream from these samples in text order.
4. An anchor with more than ``HOT`` pieces is a group that no single task should hold. Its strings are compared one by one instead,
   by their 128-bit digests, in an ordinary aggregate and a join whose hot keys Spark can split.

Null texts are empty, and texts shorter than ``LENGTH`` lose nothing. A row that repeats another one is a document of its own, so both
lose everything they share. Rows are told apart by their id and text; a null id is an id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import text as tx
from trajspark.llm.storage import partitions, query, written

LENGTH = 200
GRAM = 48
LONGEST = 256  # starts of a piece; a longer stretch of one anchor is cut, which separates no equal strings
HOT = 4096  # pieces of one anchor that may meet in a task
BATCH = 1 << 20  # bytes of different pieces in one index
FLUSH = 1 << 20  # anchors that a task holds before it packs them
MOST_BITS = 28  # log2 of the largest bitmap of anchors that more than one piece has: 32 MB
HOT_BITS = 24
TWICE = 1 << 15  # mark beside a count: a single piece may hold the anchor at two places
LARGE = 4 * tx.CHUNK  # bytes of a single text from which it is gone through in stretches


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tx.EXACT[data] * tx.powers(tx.BASE, len(data)), out=total[1:])
    return tx.mixed((total[gram:] - total[:-gram]) * tx.powers(tx.INVERSE, len(data) + 1)[: len(data) - gram + 1])


def _extreme(pick: np.ufunc, values: np.ndarray, want: int) -> np.ndarray:
    """The least or greatest of every ``want`` values in a row."""
    n, wide = len(values) - want + 1, 1
    while 2 * wide <= want:
        values = pick(values[:-wide], values[wide:])
        wide *= 2
    return pick(values[:n], values[want - wide : want - wide + n])


def twice(grams: np.ndarray, least: np.ndarray, want: int) -> np.ndarray:
    """Anchors that lie at two places no further apart than equal strings of one piece can be."""
    padded = np.concatenate((np.zeros(want - 1, np.uint64), least, np.zeros(want - 1, np.uint64)))
    at = np.flatnonzero(_extreme(np.maximum, padded, want) == grams)  # places that are the least of a string around them
    at = at[np.argsort(grams[at], kind="stable")]
    return grams[at[1:][(grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) < LONGEST)]]


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, counting: bool = False) -> tuple[np.ndarray, ...]:
    """(first start, end of the starts, anchor) of all pieces of the texts that lie in ``data`` at ``offsets``.

    With ``counting``, the anchors that a single piece may hold at two places come fourth.
    """
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, *([none] if counting else [])
    grams, want = _grams(data, gram), length - gram + 1
    least = _extreme(np.minimum, grams, want)
    inside = np.zeros(starts + 1, np.int32)  # starts whose string ends within their text
    first, last = offsets[:-1], offsets[1:] - length + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1])) + 1
    a, b = np.concatenate(([0], edge)), np.concatenate((edge, [starts]))
    keep = inside[a]
    a, b = a[keep], b[keep]
    cut = (b - a + LONGEST - 1) // LONGEST
    nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
    a, b = np.repeat(a, cut) + nth * LONGEST, np.repeat(b, cut)
    return a, np.minimum(a + LONGEST, b), least[a], *([twice(grams, least, want)] if counting else [])


def stretches(column: pa.Array, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, number of the first text, bytes of it that came before); a very long text comes in overlapping stretches."""
    t = tx.Texts(column)
    if len(t.bytes) <= LARGE:
        yield t.bytes, t.offsets, 0, 0
        return
    for k in range(t.n):
        whole = t.bytes[t.offsets[k] : t.offsets[k + 1]]
        for at in range(0, max(1, len(whole) - length + 1), LARGE):
            part = whole[at : at + LARGE + length - 1]
            yield part, np.array([0, len(part)]), k, at


def _in_order(group: np.ndarray, second: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by group, ``second`` (of so many bits) and place, and what tells (group, second) pairs apart, in this order."""
    low = int(at.max()).bit_length()
    if int(group[-1]).bit_length() + bits + low <= 63:  # one sort of packed integers is several times faster than a sort of places
        packed = np.sort((((group << bits) | second) << low) | at)
        return packed >> low, packed & ((1 << low) - 1)
    by = np.lexsort((at, second, group))
    group, second = group[by], second[by]
    pair = np.zeros(len(by), np.int64)
    pair[1:] = np.cumsum((group[1:] != group[:-1]) | (second[1:] != second[:-1]))
    return pair, at[by]


class RunIndex:
    """Run-length index of different byte strings: repeats between and within them, never across their ends."""

    def __init__(self, bodies: list[bytes]):
        size = np.array([len(b) for b in bodies], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        ends = self.begin + size
        end_of = np.repeat(ends, size + 1)
        used = np.zeros(256, bool)
        used[raw] = True
        bits = 8 if used.sum() < 255 else 9
        code = np.zeros(256, np.uint64)
        code[used] = np.arange(1, used.sum() + 1)
        symbol = code[raw]
        symbol[ends] = 0
        n, step = len(symbol), 64 // bits
        there = np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(step):  # the first symbols of each suffix, up to its end
            key <<= np.uint64(bits)
            m = max(0, n - k)
            key[:m] |= np.where(there[:m] + k <= end_of[:m], symbol[k:], np.uint64(0))
        order = self._sorted(key, end_of, step, bits)
        before = np.where(order > 0, symbol[order - 1], np.uint64(0))
        run = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1  # ends are symbols of their own
        p, q = order[run - 1], order[run]
        common = np.minimum(self._common(key, p, q, step, bits), np.minimum(end_of[p] - p, end_of[q] - q))
        self.runs = len(run) + 1
        self.statistics = np.maximum(self._streamed(n, q, common, order[0]), self._streamed(n, p, common, order[-1]))

    @staticmethod
    def _sorted(key: np.ndarray, end_of: np.ndarray, step: int, bits: int) -> np.ndarray:
        """Suffixes in order: by their first symbols, then by doubling within groups of equal ones. Ends sort by place."""
        n = len(key)
        h = max(1, min(step, (63 - n.bit_length()) // bits))
        group, order = _in_order(np.zeros(n, np.int64), (key >> np.uint64(bits * (step - h))).astype(np.int64), np.arange(n), bits * h)
        new = np.ones(n, bool)
        new[1:] = (group[1:] != group[:-1]) | (end_of[order[1:]] - order[1:] < h)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        left = np.flatnonzero(~(new & np.append(new[1:], True)))
        new = new[left]
        while len(left):
            at = order[left]
            group = np.cumsum(new) - 1
            pair, at = _in_order(group, rank[np.minimum(at + h, n - 1)].astype(np.int64), at, n.bit_length())
            order[left] = at
            new = np.ones(len(left), bool)
            new[1:] = pair[1:] != pair[:-1]
            rank[at] = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
            several = ~(new & np.append(new[1:], True))
            left, new = left[several], new[several]
            h *= 2
        return order

    @staticmethod
    def _common(key: np.ndarray, p: np.ndarray, q: np.ndarray, step: int, bits: int) -> np.ndarray:
        """Symbols that the suffixes at p and q have in common; may run past their ends."""
        n = len(key)
        out = np.zeros(len(p), np.int64)
        going = np.arange(len(p))
        while len(going):
            a, b = p[going] + out[going], q[going] + out[going]
            inside = np.maximum(a, b) < n
            going, a, b = going[inside], a[inside], b[inside]
            differ = key[a] ^ key[b]
            ended = (differ != 0) | ((key[a] & np.uint64((1 << bits) - 1)) == 0)
            extra = np.zeros(len(going), np.int64)
            for k in range(1, step + 1):
                extra += (differ >> np.uint64(bits * (step - k))) == 0
            out[going] += extra
            going = going[~ended]
        return out

    @staticmethod
    def _streamed(n: int, at: np.ndarray, common: np.ndarray, outer: int) -> np.ndarray:
        """Match lengths of all positions from those at run ends: each step to the right takes one byte away."""
        reach = np.full(n, -1, np.int64)
        reach[at] = at + common
        reach[outer] = outer
        last = np.maximum.accumulate(np.where(reach >= 0, np.arange(n), 0))
        return np.maximum(reach[last] - np.arange(n), 0)


def anchor_bitmaps(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray, np.ndarray]:
    """(log2 of the bits, bitmap of anchors that several pieces have, bitmap of those with over ``HOT``), from all texts."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wide = int(np.clip(size // 4, 1 << 12, 1 << MOST_BITS)).bit_length() - 1  # about 16 bits for each anchor
    bits = int(np.clip(size // (LENGTH // 2) >> 20, 1, 1 << 12)).bit_length() - 1  # buckets of about 2**20 anchors
    narrow = min(wide, HOT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, doubled, n = [], [], 0

        def pack() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            times = np.minimum(times, TWICE - 1)
            times[np.searchsorted(key, np.concatenate(doubled) >> np.uint64(32 - bits))] |= TWICE
            edge = np.searchsorted((key >> np.uint64(32)).astype(np.int64), np.arange((1 << bits) + 1))
            low, times = (key & np.uint64(0xFFFFFFFF)).astype("<u4"), times.astype("<u2")
            full = np.flatnonzero(np.diff(edge)).tolist()
            packed = [[x[edge[b] : edge[b + 1]].tobytes() for b in full] for x in (low, times)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *map(pa.array, packed)], ["bucket", "low", "times"])

        for part in tx.slices(batches, text):
            for data, offsets, _, _ in stretches(part[text]):
                _, _, anchor, two = pieces(data, offsets, counting=True)
                held.append(anchor)
                doubled.append(two[np.isin(two, anchor)])
                n += len(anchor)
            if n >= FLUSH:
                yield pack()
                held, doubled, n = [], [], 0
        if n:
            yield pack()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flags() -> pa.RecordBatch:
            low = np.concatenate([np.frombuffer(a, "<u4") for a, _ in held])
            times = np.concatenate([np.frombuffer(b, "<u2") for _, b in held]).astype(np.int64)
            order = np.argsort(low)
            low, times = low[order], times[order]
            first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            low, two = low[first], np.bitwise_or.reduceat(times, first) >= TWICE
            times = np.add.reduceat(times & (TWICE - 1), first)
            out = []
            for some, width in ((two | (times > 1), wide), (times > HOT, narrow)):
                bit = np.zeros(1 << (width - bits), bool)
                bit[(low[some] >> np.uint32(32 - (width - bits))).astype(np.int64)] = True
                out.append(pa.array([np.packbits(bit).tobytes()]))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *out], ["bucket", "shared", "hot"])

        for batch in batches:
            for bucket, low, times in zip(*[batch[c].to_pylist() for c in ("bucket", "low", "times")], strict=True):
                if bucket != now and held:
                    yield flags()
                    held = []
                now = bucket
                held.append((low, times))
        if held:
            yield flags()
        tx.release()

    packed = docs.select(text).mapInArrow(count, "bucket int, low binary, times binary")
    dealt = packed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    shared, hot = np.zeros(1 << (wide - 3), np.uint8), np.zeros(1 << (narrow - 3), np.uint8)
    for r in dealt.mapInArrow(total, "bucket int, shared binary, hot binary").toLocalIterator():  # 2**wide bits in all
        for bitmap, piece in ((shared, r["shared"]), (hot, r["hot"])):
            bitmap[r["bucket"] * len(piece) : (r["bucket"] + 1) * len(piece)] = np.frombuffer(piece, np.uint8)
    return wide, shared, hot


def _bit(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = anchor >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


PIECE = "anchor long, body binary, who binary"
MEMBER = np.dtype([("d", "<i8"), ("fp", "<i8"), ("at", "<i8")])


def shared_pieces(rows: DataFrame, bitmaps: Broadcast, single: bool) -> DataFrame:
    """(anchor, body, who): pieces that may have an equal; or, with ``single``, digests of the single strings of hot anchors.

    ``rows`` has (d, fp, text); ``who`` packs the id, the fingerprint and the place of all pieces with this body in a part of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, hot = bitmaps.value
        for part in tx.slices(batches, "text"):
            d, fp = part["d"].to_numpy(), part["fp"].to_numpy()
            for data, offsets, number, gone in stretches(part["text"]):
                a, b, anchor = pieces(data, offsets)
                keep = _bit(several, anchor) & (_bit(hot, anchor) == single)
                a, b, anchor = a[keep], b[keep], anchor[keep]
                if not len(a):
                    continue
                own = np.searchsorted(offsets, a, side="right") - 1
                who = np.zeros(len(a), MEMBER)
                who["d"], who["fp"], who["at"] = d[own + number], fp[own + number], a - offsets[own] + gone
                raw, found = data.tobytes(), {}
                for i, (x, y, key) in enumerate(zip(a.tolist(), b.tolist(), anchor.view(np.int64).tolist(), strict=True)):
                    if not single:
                        found.setdefault((key, raw[x : y + LENGTH - 1]), []).append(who[i].tobytes())
                        continue
                    for k in range(x, y):
                        one = who[i].copy()
                        one["at"] += k - x
                        found.setdefault((None, hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest()), []).append(one.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary()), pa.array([b"".join(v) for v in found.values()], pa.binary())],
                    ["anchor", "body", "who"],
                )

    return rows.mapInArrow(run, PIECE)


MARK = "d long, fp long, lo long, hi long"


def _marks(body: np.ndarray, lo: np.ndarray, hi: np.ndarray, members: list[bytes]) -> pa.RecordBatch:
    """Marks of all members of each body: strings that start from ``lo`` to before ``hi`` in it, given in the order of ``body``."""
    held = np.array([len(m) // MEMBER.itemsize for m in members], np.int64)
    first = np.concatenate(([0], np.cumsum(held)))[:-1]
    who = np.frombuffer(b"".join(members), MEMBER)
    n = held[body]
    run = np.repeat(np.arange(len(body)), n)
    at = who[np.repeat(first[body] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (at["d"].copy(), at["fp"].copy(), at["at"] + lo[run], at["at"] + hi[run] - 1 + LENGTH)], ["d", "fp", "lo", "hi"]
    )


def _whole(pieces_: dict[bytes, list[bytes]]) -> pa.RecordBatch:
    """Marks of pieces that are there more than once, from end to end."""
    end = np.array([len(b) - LENGTH + 1 for b in pieces_], np.int64)
    return _marks(np.arange(len(end)), np.zeros(len(end), np.int64), end, [b"".join(w) for w in pieces_.values()])


def _indexed(pieces_: dict[bytes, list[bytes]]) -> pa.RecordBatch:
    """Marks of different pieces, by an index of them."""
    members = [b"".join(w) for w in pieces_.values()]
    index = RunIndex(list(pieces_))
    flags = index.statistics >= LENGTH  # never at the last bytes of a piece, so runs stay within their piece
    for k, (body, who) in enumerate(zip(pieces_, members, strict=True)):
        if len(who) > MEMBER.itemsize:
            flags[index.begin[k] : index.begin[k] + len(body) - LENGTH + 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    body = np.searchsorted(index.begin, a, side="right") - 1
    return _marks(body, a - index.begin[body], b - index.begin[body], members)


def _index_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the groups of anchors of a sorted partition, some whole groups to an index.

    A group that is one piece, several times, is marked as it is: there is nothing to compare it with.
    """
    group: dict[bytes, list[bytes]] = {}
    alike: dict[bytes, list[bytes]] = {}
    held: dict[bytes, list[bytes]] = {}
    size, now = 0, None
    for batch in batches:
        for anchor, body, who in zip(*[batch[c].to_pylist() for c in ("anchor", "body", "who")], strict=True):
            if anchor != now:
                if len(group) == 1 and (len(group[last]) > 1 or len(group[last][0]) > MEMBER.itemsize):
                    alike.update(group)
                else:
                    held.update(group)
                    size += sum(map(len, group))
                if size >= BATCH:
                    yield _indexed(held)
                    held, size = {}, 0
                group, now = {}, anchor
            last = body
            group.setdefault(body, []).append(who)
        yield _whole(alike)
        alike = {}
    held.update(group)
    if held:
        yield _indexed(held)
    tx.release()


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        yield _marks(np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64), batch["who"].to_pylist())


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(d, fp, spans): for each (d, fp, text) with repeated strings, their byte ranges, which may overlap and come in any order."""
    spark = rows.sparkSession
    _, several, hot = anchor_bitmaps(rows)
    shared = spark.sparkContext.broadcast((several, hot))
    grouped = shared_pieces(rows, shared, False).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    found = grouped.mapInArrow(_index_groups, MARK)
    if hot.any():
        single = written(shared_pieces(rows, shared, True).select("body", "who"), "strings")
        often = single.groupBy("body").agg(F.sum(F.octet_length("who")).alias("n")).where(F.col("n") > MEMBER.itemsize).select("body")
        found = found.unionByName(single.join(often, "body").select("who").mapInArrow(_single, MARK))
    marks = written(found, "marks")
    return marks.groupBy("d", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the text, and the maximal removed runs."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    edge = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)), [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, removed): the bytes that stay of every row's text, and the removed runs (lo, hi) in order."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), F.xxhash64("text").alias("fp"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows.select("d", "fp", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            kept, size, removed = [], [], []
            for text, own in zip(part["text"].to_pylist(), part["spans"].to_pylist(), strict=True):
                raw = text.encode()
                left, runs = cut(raw, [(s["lo"], s["hi"]) for s in own or []])
                kept.append(left)
                size.append(len(raw))
                removed.append([{"lo": a, "hi": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["doc_id", "kept", "n_bytes", "removed"],
            )

    joined = rows.join(spans, ["d", "fp"], "left").select("doc_id", "text", "spans")
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, removed array<struct<lo: long, hi: long>>")


@query("op11_run_index")
def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: bytes, removed bytes and runs, digest of what is left."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
