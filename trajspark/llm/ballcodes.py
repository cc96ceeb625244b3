"""Vector codes: equal parts of integer vectors replaced by the nearest entry of a codebook for each part, trained by ball k-means.

Vectors are packed in blocks of rows, and every round is one scan of the blocks. The parts that an entry holds are its ball:

* Neighbours: entry j can take a part from entry i only if the distance of the two is at most twice the radius of i's ball.
* Stable core: a part nearer to its entry than half the way to the nearest other entry keeps it, without a comparison.
* Rings: neighbours lie in order of distance. A part is compared with those at most twice as far from its entry as itself.
* A ball that did not move, with neighbours that did not move, keeps all its parts.

All of this is in squares of integers, so bounds are exact and ties go to the lower entry. What a round brings to the driver is the sum and
count for each entry: a table of fixed size. The codes of a round stay in the blocks, as the balls of the next one.

Rows whose vector is null, empty or has a null or non-finite component are dropped, and so are vectors of another length than that
of the smallest remaining id, or all of them if this length can't be cut into equal parts. Scaled components are held within
2**27 on either side, which keeps every sum of squares exact. Rows that repeat an id count each; among equal ids the vector decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.storage import query, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 4096  # vectors worked on at a time
FURTHEST = 1 << 27


@dataclass
class Ball:
    """The codebook of one part position: entries in order of their number, and the others by distance from each."""

    entries: np.ndarray  # (entries, components)
    still: np.ndarray  # entries that are where they were in the round before

    def __post_init__(self):
        gap = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(gap, -1)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(gap, self.order, 1)
        widest = np.argmax(np.ptp(self.entries, axis=0))
        self.axis, self.by_axis = widest, np.argsort(self.entries[:, widest], kind="stable")

    def first(self, x: np.ndarray) -> np.ndarray:
        """A ball to begin with: the entry next to each part on the axis on which entries lie widest apart."""
        at = np.searchsorted(self.entries[self.by_axis, self.axis], x[:, self.axis])
        return self.by_axis[np.minimum(at, len(self.entries) - 1)]

    def assign(self, x: np.ndarray, ball: np.ndarray, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part and its squared distance, from the balls that the parts are in.

        ``known``: these were nearest in the round before, so balls can keep what can't have changed.
        """
        own = ((x - self.entries[ball]) ** 2).sum(1)
        best, least = ball.copy(), own.copy()
        if len(self.entries) == 1 or not len(x):
            return best, least
        radius = np.zeros(len(self.entries), np.int64)
        np.maximum.at(radius, ball, own)
        neighbours = (self.gap <= 4 * radius[:, None]).sum(1)  # of each ball; gaps ascend
        if known:
            moved = ~self.still
            near = np.arange(self.order.shape[1])[None, :] < neighbours[:, None]
            neighbours[self.still & ~(moved[self.order] & near).any(1)] = 0
        open_ = np.flatnonzero((4 * own >= self.gap[ball, 0]) & (neighbours[ball] > 0))
        for ring in range(int(neighbours.max())):
            own_ball = ball[open_]
            open_ = open_[(ring < neighbours[own_ball]) & (self.gap[own_ball, ring] <= 4 * own[open_])]
            if not len(open_):
                break
            other = self.order[ball[open_], ring]
            d = ((x[open_] - self.entries[other]) ** 2).sum(1)
            nearer = (d < least[open_]) | ((d == least[open_]) & (other < best[open_]))
            to = open_[nearer]
            best[to], least[to] = other[nearer], d[nearer]
        return best, least


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): scaled integer vectors of the rows that are kept."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(FURTHEST)), F.lit(-FURTHEST)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & whole & (F.size("embedding") > 0)).select("vec_id", "label", scaled.alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def _scan(blocks: DataFrame, books: list[Ball], size: int, known: bool, parts: int) -> DataFrame:
    """The blocks with the codes and errors against these codebooks, and sums of the parts of each entry."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    width = size // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, len(shared.value[0].entries), width + 1), np.int64)
        for batch in batches:
            codes = []
            errors = []
            for vectors, old in zip(batch["v"].to_pylist(), batch["codes"].to_pylist(), strict=True):
                v = np.frombuffer(vectors, "<i4").reshape(-1, parts, width).astype(np.int64)
                before = np.frombuffer(old, np.uint8).reshape(-1, parts).astype(np.int64) if known else None
                code, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
                for p, book in enumerate(shared.value):
                    best, least = book.assign(v[:, p], before[:, p] if known else book.first(v[:, p]), known)
                    code[:, p] = best
                    error += least
                    np.add.at(sums[p, :, :width], best, v[:, p])
                    sums[p, :, width] += np.bincount(best, minlength=len(book.entries))
                codes.append(code.tobytes())
                errors.append(error.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch["ids"], batch["v"], pa.array(codes, pa.binary()), pa.array(errors, pa.binary()), pa.nulls(len(codes), pa.binary())], NAMES)
        none = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([sums.tobytes()], pa.binary())], NAMES)

    return blocks.mapInArrow(run, SCHEMA)


NAMES = ["ids", "v", "codes", "errors", "sums"]
SCHEMA = "ids binary, v binary, codes binary, errors binary, sums binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows: numbers of the rows, and their components as integers of four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                v = part["v"].flatten().to_numpy().astype("<i4").tobytes()
                sink = pa.BufferOutputStream()
                keys = pa.record_batch([part["vec_id"], part["label"]], names=["vec_id", "label"])
                with pa.ipc.new_stream(sink, keys.schema) as out:
                    out.write_batch(keys)
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([v], pa.binary()), none, none, none], NAMES)

    return rows.mapInArrow(run, SCHEMA)


def _totals(scanned: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums and counts of all entries: one row of fixed size from each task, added up by Spark."""
    width = shape[2]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sums in batch["sums"].to_pylist():
                values = np.frombuffer(sums, "<i8")
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], ["at", "n"])

    rows = scanned.where("sums IS NOT NULL").select("sums").mapInArrow(spread, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows.collect():  # parts * entries * (components + 1) rows at most
        total[r["at"]] = r["n"]
    return total.reshape(shape[0], shape[1], width)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code binary, error) of every kept row, the codebooks), from a table with (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kinds = dict(vectors.select("vec_id", "label").dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"
    rows = integers(vectors)
    by_id = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.orderBy(*by_id).limit(1).collect()
    size = len(first[0]["v"]) if first else 0
    if size == 0 or size % parts:
        return spark.createDataFrame([], schema), []
    rows = rows.where(F.size("v") == size)
    start = np.array([r["v"] for r in rows.orderBy(*by_id).limit(entries).collect()], np.int64)
    width = size // parts
    books = [Ball(start[:, p * width : (p + 1) * width], np.zeros(len(start), bool)) for p in range(parts)]
    blocks = written(_packed(rows, size), "vectors")
    for k in range(rounds):
        scanned = written(_scan(blocks, books, size, k > 0, parts), "codes")
        total = _totals(scanned, (parts, len(start), width + 1))
        for p, book in enumerate(books):
            n = total[p, :, width]
            moved = np.where((n > 0)[:, None], total[p, :, :width] // np.maximum(n, 1)[:, None], book.entries)
            books[p] = Ball(moved, (moved == book.entries).all(1))
        blocks = scanned.where("sums IS NULL")
    final = _scan(blocks, books, size, rounds > 0, parts)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, codes, errors in zip(batch["ids"].to_pylist(), batch["codes"].to_pylist(), batch["errors"].to_pylist(), strict=True):
                keys = pa.ipc.open_stream(ids).read_next_batch()
                code = pa.array([codes[i : i + parts] for i in range(0, len(codes), parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys["vec_id"], keys["label"], code, pa.array(np.frombuffer(errors, "<i8"))], ["vec_id", "label", "code", "error"])

    return final.where("sums IS NULL").select("ids", "codes", "errors").mapInArrow(unpack, schema), [b.entries for b in books]


def _distances() -> str:
    return "list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _oracle() -> str:
    nearest = "assigned{k} AS (SELECT p.row, p.part, p.x, arg_min(e.entry, ({d}) * 64 + e.entry) AS entry, min({d}) AS d FROM parts p JOIN book{k} e USING (part) GROUP BY 1, 2, 3)"
    moved = """sums{k} AS (SELECT part, entry, i, floor(sum(x[i])::DECIMAL(38, 6) / count(*))::BIGINT AS v
        FROM assigned{j}, (SELECT unnest(range(1, {w})) AS i) GROUP BY ALL),
      book{k} AS (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM book{j} b
        LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM sums{k} GROUP BY ALL) s USING (part, entry))"""
    width = 64 // PARTS
    ctes = [
        """kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS (SELECT row, part, v[part * {width} + 1 : part * {width} + {width}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part))",
        f"book0 AS (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= {ENTRIES})",
        nearest.format(k=0, d=_distances()),
    ]
    for k in range(1, ROUNDS + 1):
        ctes += [moved.format(k=k, j=k - 1, w=width + 1), nearest.format(k=k, d=_distances())]
    return f"""WITH {", ".join(ctes)},
      coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY row),
      digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS s FROM book{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
    FROM kept JOIN coded USING (row), digest"""


@query("op12_ball_codes", _oracle())
def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every kept row of embeddings."""
    rows, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    coded = written(rows, "coded")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").cast("long").alias("label_error"))
    flat = ",".join(str(x) for b in books for x in b.ravel().tolist())
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(flat.encode()).hexdigest()).alias("codebooks_sha256")
    )
