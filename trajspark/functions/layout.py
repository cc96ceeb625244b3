"""Ordered work over episodes of any length.

Every row has a key (its episode) and a dense position ``seq`` = 0, 1, 2, ... in acquisition order.
A :class:`Layout` says how such rows are spread over tasks:

* *whole*: the longest episode was counted and fits one task, so a window per episode is safe and the
  whole pipeline needs one shuffle;
* *chunked*: some episode is too long. Rows are keyed by (episode, seq div ``chunk_rows``). Windows with
  a short reach get copies of the neighbouring rows (a halo); running sums and nearest-value searches
  work per chunk and take a carry from a summary with one row per chunk; medians are found by counting
  value ranges.

Both give the same rows, so operators are written once against this class.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trajspark.functions.columns import finite
from trajspark.functions.lineage import materialise
from trajspark.functions.quantile import grouped_quantiles

DEFAULT_CHUNK_ROWS = 1 << 19
ROWS_PER_TASK = 1 << 16  # the repair holds about 9 KB for a row at its peak
_CHUNK = "_chunk"
_UNB = Window.unboundedPreceding


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    largest, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return largest or 0, total or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(df, keys)[0]


@dataclass(frozen=True)
class Layout:
    chunk_rows: int | None = None
    keys: tuple[str, ...] = ("episode_id",)
    order: str = "seq"
    bucket: str | None = None   # column that chunks the rows when the order is not a dense position

    @classmethod
    def probe(
        cls,
        df: DataFrame,
        keys: Sequence[str] = ("episode_id",),
        order: str = "seq",
        limit: int = DEFAULT_CHUNK_ROWS,
    ) -> Layout:
        """Count the rows of the longest episode (one map-side combined aggregate) and choose the layout."""
        return cls(None if largest_group(df, keys) <= limit else limit, tuple(keys), order)

    @classmethod
    def split(
        cls, df: DataFrame, keys: Sequence[str] = ("episode_id",), order: str = "seq", limit: int = DEFAULT_CHUNK_ROWS
    ) -> list[tuple[DataFrame, Layout]]:
        """The rows by the length of their episodes: those that fit a task as wholes, the others in chunks.

        Long episodes are rows / limit at most, which bounds the broadcast.
        """
        counted = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
        long = materialise(counted)
        if long.isEmpty():
            return [(df, cls(None, tuple(keys), order))]
        pick = lambda how: df.join(F.broadcast(long), list(keys), how)
        return [(pick("left_anti"), cls(None, tuple(keys), order)), (pick("left_semi"), cls(limit, tuple(keys), order))]

    @property
    def whole(self) -> bool:
        return self.chunk_rows is None

    def spread(self, df: DataFrame, by: str, copies: int = 1, rows: int | None = None) -> DataFrame:
        """Rows of whole episodes dealt by ``by``, a bounded number to a task; ``copies`` rows will come from each.

        Windows keyed by ``by``, or by it and more, run where the rows then are. Adaptive execution would join such partitions by
        their size before the rows become wide, or many. ``rows`` is the number of rows if it is known.
        """
        if not self.whole:
            return df
        spark = df.sparkSession
        usual = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        tasks = max(min(spark.sparkContext.defaultParallelism, usual), -(-(df.count() if rows is None else rows) * copies // ROWS_PER_TASK))
        return df.repartition(tasks + (tasks == usual), by)  # of the usual number it would pass for a shuffle that may be coalesced

    def _chunk_of(self, position: Column) -> Column:
        return F.floor(position / F.lit(self.chunk_rows)).cast("long")

    def _with_chunk(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_CHUNK, F.col(self.bucket) if self.bucket else self._chunk_of(F.col(self.order)))

    def _ordered(self, descending: bool = False) -> WindowSpec:
        spec = Window.partitionBy(*self.keys) if self.whole else Window.partitionBy(*self.keys, _CHUNK)
        return spec.orderBy(F.col(self.order).desc() if descending else F.col(self.order))

    def _chunks_ordered(self, descending: bool = False) -> WindowSpec:
        order = F.col(_CHUNK).desc() if descending else F.col(_CHUNK)
        return Window.partitionBy(*self.keys).orderBy(order).rowsBetween(_UNB, -1)

    # ---- windows with a short reach -------------------------------------------------------------

    def local(
        self,
        df: DataFrame,
        columns: Callable[[WindowSpec], Mapping[str, Column]],
        before: int = 0,
        after: int = 0,
    ) -> DataFrame:
        """Add window columns that look at most ``before`` rows back and ``after`` rows ahead."""
        if self.whole:
            return df.withColumns(dict(columns(self._ordered())))
        seq = F.col(self.order)
        homes = F.sequence(
            F.greatest(F.lit(0), self._chunk_of(seq - after)), self._chunk_of(seq + before)
        )
        copies = df.withColumn(_CHUNK, F.explode(homes))
        return (
            copies.withColumns(dict(columns(self._ordered())))
            .filter(F.col(_CHUNK) == self._chunk_of(seq))
            .drop(_CHUNK)
        )

    # ---- running sums ---------------------------------------------------------------------------

    def running(self, df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
        """Add inclusive running sums in acquisition order; nulls count as zero."""
        terms = {name: F.coalesce(expr, F.lit(0)) for name, expr in sums.items()}
        if self.whole:
            w = self._ordered().rowsBetween(_UNB, 0)
            return df.withColumns({name: F.sum(t).over(w) for name, t in terms.items()})
        df = materialise(self._with_chunk(df))
        w = self._ordered().rowsBetween(_UNB, 0)
        totals = df.groupBy(*self.keys, _CHUNK).agg(*[F.sum(t).alias(f"_t_{n}") for n, t in terms.items()])
        offsets = totals.select(
            *self.keys,
            _CHUNK,
            *[
                F.coalesce(F.sum(f"_t_{n}").over(self._chunks_ordered()), F.lit(0)).alias(f"_o_{n}")
                for n in terms
            ],
        )
        inside = df.withColumns({n: F.sum(t).over(w) for n, t in terms.items()})
        joined = inside.join(offsets, [*self.keys, _CHUNK])
        return joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in terms}).drop(
            _CHUNK, *[f"_o_{n}" for n in terms]
        )

    # ---- nearest known values on both sides -----------------------------------------------------

    def carry(
        self,
        df: DataFrame,
        back: Mapping[str, Column],
        ahead: Mapping[str, Column] | None = None,
        also: Callable[[WindowSpec], Mapping[str, Column]] | None = None,
        before: int = 0,
        after: int = 0,
    ) -> DataFrame:
        """Add the last non-null value at or before each row (``back``) and the first one at or after it
        (``ahead``). ``also`` adds short-reach window columns, as ``local`` does, in the same pass."""
        ahead = ahead or {}
        if self.whole:
            if ahead:
                w = self._ordered(descending=True).rowsBetween(_UNB, 0)
                df = df.withColumns({n: F.last(v, True).over(w) for n, v in ahead.items()})
            w = self._ordered()
            columns = {n: F.last(v, True).over(w.rowsBetween(_UNB, 0)) for n, v in back.items()}
            return df.withColumns(columns | dict(also(w) if also else {}))
        if also:
            df = self.local(df, also, before, after)
        df = self._with_chunk(df).withColumns({f"_v_{n}": v for n, v in (*back.items(), *ahead.items())})
        df = materialise(df)
        known = {n: F.when(F.col(f"_v_{n}").isNotNull(), F.col(self.order)) for n in (*back, *ahead)}
        edges = df.groupBy(*self.keys, _CHUNK).agg(
            *[F.max_by(f"_v_{n}", known[n]).alias(f"_e_{n}") for n in back],
            *[F.min_by(f"_v_{n}", known[n]).alias(f"_e_{n}") for n in ahead],
        )
        carried = edges.select(
            *self.keys,
            _CHUNK,
            *[F.last(f"_e_{n}", True).over(self._chunks_ordered()).alias(f"_c_{n}") for n in back],
            *[F.last(f"_e_{n}", True).over(self._chunks_ordered(True)).alias(f"_c_{n}") for n in ahead],
        )
        inside = df
        for names, descending in ((ahead, True), (back, False)):
            if names:
                w = self._ordered(descending).rowsBetween(_UNB, 0)
                inside = inside.withColumns({n: F.last(f"_v_{n}", True).over(w) for n in names})
        joined = inside.join(carried, [*self.keys, _CHUNK])
        names = [*back, *ahead]
        return joined.withColumns({n: F.coalesce(n, f"_c_{n}") for n in names}).drop(
            _CHUNK, *[f"{p}_{n}" for n in names for p in ("_v", "_c")]
        )

    def with_anchors(
        self,
        df: DataFrame,
        values: Mapping[str, str],
        time: str = "timestamp",
        also: Callable[[WindowSpec], Mapping[str, Column]] | None = None,
        before: int = 0,
        after: int = 0,
    ) -> DataFrame:
        """For each value (a SQL expression) add ``<name>__prev`` and ``<name>__next``: the nearest non-null
        point (seq, t, v) at or before, and at or after, each row."""
        points = {
            n: F.expr(f"if(({v}) IS NULL, NULL, named_struct('seq', `{self.order}`, 't', `{time}`, 'v', {v}))")
            for n, v in values.items()
        }
        return self.carry(
            df,
            {f"{n}__prev": p for n, p in points.items()},
            {f"{n}__next": p for n, p in points.items()},
            also,
            before,
            after,
        )

    # ---- per-episode figures on every row -------------------------------------------------------

    def attach(self, df: DataFrame, figures: DataFrame, how: str = "left") -> DataFrame:
        """Join one row of figures per episode back to the rows without gathering a long episode."""
        if self.whole:
            return df.join(figures, list(self.keys), how)
        df = self._with_chunk(df)
        homes = df.select(*self.keys, _CHUNK).distinct().join(figures, list(self.keys), how)
        return df.join(homes, [*self.keys, _CHUNK], how).drop(_CHUNK)

    def with_figures(self, df: DataFrame, figures: Mapping[str, Column]) -> DataFrame:
        """Add per-episode aggregates to every row."""
        if self.whole:
            w = Window.partitionBy(*self.keys)
            return df.withColumns({n: a.over(w) for n, a in figures.items()})
        df = materialise(df)
        return self.attach(df, df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in figures.items()]))

    def with_quantiles(self, df: DataFrame, quantiles: Mapping[str, tuple[Column, float]]) -> DataFrame:
        """Add exact per-episode quantiles (linear interpolation; nulls, NaN and infinity ignored) to every row."""
        if not quantiles:
            return df
        if self.whole:
            w = Window.partitionBy(*self.keys)
            return df.withColumns({n: F.percentile(finite(c), p).over(w) for n, (c, p) in quantiles.items()})
        df = materialise(df)
        return self.attach(df, self.quantiles(df, quantiles))

    def quantiles(self, df: DataFrame, quantiles: Mapping[str, tuple[Column, float]]) -> DataFrame:
        """Exact quantiles of the finite values, one row per episode."""
        if self.whole:
            return df.groupBy(*self.keys).agg(*[F.percentile(finite(c), p).alias(n) for n, (c, p) in quantiles.items()])
        return grouped_quantiles(df, self.keys, quantiles, self.chunk_rows)


def range_buckets(df: DataFrame, by: Sequence[str | Column], name: str = "_bucket") -> DataFrame:
    """The rows with the number of their range, which never decreases along the ordering ``by``.

    Ranges are cut from a sample of the rows, so each has about as many rows whatever the values are. The rows are stored,
    as the cuts of another run could differ.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return materialise(df.repartitionByRange(n, *by).withColumn(name, F.spark_partition_id().cast("long")))


def dense_positions(
    df: DataFrame, key: str, order: Sequence[str | Column], name: str = "seq", limit: int = DEFAULT_CHUNK_ROWS
) -> tuple[DataFrame, Layout]:
    """Number the rows of each key 0, 1, 2, ... in the given order.

    If a key is too long for one task, rows are numbered within sampled ranges of (key, order) and moved up by the number
    of rows in the key's earlier ranges.
    """
    largest, rows = group_sizes(df, (key,))
    layout = Layout(None if largest <= limit else limit, (key,), name)
    if layout.whole:
        df = layout.spread(df, key, rows=rows)
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long")), layout
    df = range_buckets(df, [key, *order])
    sizes = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(_UNB, -1)
    offsets = sizes.select(key, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(w)).join(offsets, [key, "_bucket"])
    return (
        numbered.withColumn(name, (F.col("_rank") - 1 + F.col("_offset")).cast("long")).drop(
            "_rank", "_offset", "_bucket"
        ),
        layout,
    )
