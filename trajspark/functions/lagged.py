"""Correlation of two signals over a range of lags, by blocks of rows.

An episode that fits a task is correlated in one piece, many short ones together. A longer one is cut into blocks of ``chunk_rows`` rows: every row of
the left signal goes to the blocks of right rows that its lags reach, which are one or two unless a lag is longer than a block, and
each pair of blocks gives the moments of its pairs of rows for every lag. Moments add up, so no task sees more than two blocks, and
what is shuffled besides the rows is one line for each block pair and lag. Many lags take one product of Fourier transforms, few a
scalar product each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.layout import Layout

TOGETHER = 1 << 15  # rows of whole episodes that are worked on at once
FEW_LAGS = 192  # up to here a scalar product for each lag costs less than transforms
SUMS = ["pairs", "sx", "sxx", "sy", "syy", "sxy"]
CONSTANT = 1e-10  # share of a sum of squares below which its spread is rounding


def _products(left: np.ndarray, right: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Sum of left[p] * right[p + lag] over all p, for consecutive lags."""
    if len(lags) <= FEW_LAGS:
        out = np.zeros(len(lags))
        for k, lag in enumerate(lags.tolist()):
            a, b = max(0, -lag), min(len(left), len(right) - lag)
            if b > a:
                out[k] = left[a:b] @ right[a + lag : b + lag]
        return out
    size = 1 << (len(left) + len(right) - 1).bit_length()
    whole = np.fft.irfft(np.conj(np.fft.rfft(left, size)) * np.fft.rfft(right, size), size)
    reached = (lags > -len(left)) & (lags < len(right))
    return np.where(reached, whole[np.where(reached, lags, 0) % size], 0.0)


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[end] - total[start]


def moments(left: np.ndarray, right: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """(lags, 6) counts and sums of the pairs (left[p], right[p + lag]); pairs with a value that is not finite are left out."""
    whole = np.isfinite(left).all() and np.isfinite(right).all()
    if whole:
        start = np.clip(-lags, 0, len(left))
        end = np.maximum(start, np.clip(len(right) - lags, 0, len(left)))
        first = np.clip(start + lags, 0, len(right))
        last = np.maximum(first, np.clip(end + lags, 0, len(right)))
        n = end - start
        sums = [n, _spans(left, start, end), _spans(left * left, start, end), _spans(right, first, last), _spans(right * right, first, last)]
        return np.stack([*sums, _products(left, right, lags)], axis=1)
    here, there = np.isfinite(left), np.isfinite(right)
    x, y = np.where(here, left, 0.0), np.where(there, right, 0.0)
    here, there = here.astype(float), there.astype(float)
    sums = [np.rint(_products(here, there, lags)), _products(x, there, lags), _products(x * x, there, lags), _products(here, y, lags), _products(here, y * y, lags)]
    return np.stack([*sums, _products(x, y, lags)], axis=1)


def _column(table: pa.Table, name: str, order: np.ndarray) -> np.ndarray:
    return table[name].to_numpy().astype(float)[order]


def _lines(keys: list, types: pa.Schema, names: list[str], lags: np.ndarray, sums: np.ndarray) -> pa.Table:
    some = sums[:, 0] > 0
    lags, sums = lags[some], sums[some]
    columns = [pa.array([k] * len(lags), types.field(n).type) for k, n in zip(keys, names, strict=True)]
    return pa.table([*columns, pa.array(lags.astype(np.int32)), *[pa.array(s) for s in sums.T]], [*names, "lag", *SUMS])


def _all_episodes(batches: Iterator[pa.RecordBatch], keys: list[str], fill: bool = False) -> Iterator[pa.RecordBatch]:
    """Lines of the episodes of a partition sorted by episode and row, many short ones at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        key = table["_key"].to_numpy()
        edge = np.flatnonzero(key[1:] != key[:-1])
        if len(edge):  # the last episode may go on in the next batch
            done = int(edge[-1]) + 1
            yield from _episodes(table.slice(0, done), keys, fill).to_batches()
            held, rows = table.slice(done).to_batches(), len(key) - done
    if rows:
        yield from _episodes(pa.Table.from_batches(held), keys, fill).to_batches()


def _filled(values: np.ndarray) -> np.ndarray:
    """Gaps filled linearly between the nearest known values by position, with the nearest value at the edges."""
    known = np.flatnonzero(~np.isnan(values))
    if len(known) in (0, len(values)):
        return values
    at = np.arange(len(values))
    a = known[np.maximum(np.searchsorted(known, at, "right") - 1, 0)]
    b = known[np.minimum(np.searchsorted(known, at, "left"), len(known) - 1)]
    return values[a] + (values[b] - values[a]) * ((at - a) / np.maximum(1, b - a))


def _episodes(table: pa.Table, keys: list[str], fill: bool = False) -> pa.Table:
    """Lines of whole episodes: for each lag one running sum of products over all of them, for long or incomplete ones by themselves."""
    key = table["_key"].to_numpy()
    n = len(key)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.append(begin[1:], n)
    size = end - begin
    low, high = (table[c].take(pa.array(begin)).to_numpy() for c in ("_low", "_high"))
    x, y = (table[c].to_numpy().astype(float) for c in ("_x", "_y"))
    for v in (x, y) if fill else ():
        for e in np.unique(np.searchsorted(end, np.flatnonzero(np.isnan(v)), "right")).tolist():
            v[begin[e] : end[e]] = _filled(v[begin[e] : end[e]])
    alone = (high - low >= FEW_LAGS) | (np.add.reduceat((~np.isfinite(x) | ~np.isfinite(y)).astype(np.int64), begin) > 0)
    owner, lag, lines = [], [], []
    for e in np.flatnonzero(alone).tolist():
        lags = np.arange(low[e], high[e] + 1)
        owner.append(np.full(len(lags), e))
        lag.append(lags)
        lines.append(moments(x[begin[e] : end[e]], y[begin[e] : end[e]], lags))
        x[begin[e] : end[e]] = y[begin[e] : end[e]] = 0.0
    scales = []
    for v in (x, y):  # to one scale, so that no episode drowns in the running sums of another
        v -= np.repeat(np.add.reduceat(v, begin) / size, size)
        spread = np.sqrt(np.add.reduceat(v * v, begin) / size)
        scales.append(np.where(spread > 0, spread, 1.0))
        v /= np.repeat(scales[-1], size)
    total = [np.concatenate(([0.0], np.cumsum(v))) for v in (x, x * x, y, y * y)]
    for k in range(int(low[~alone].min(initial=0)), int(high[~alone].max(initial=-1)) + 1):
        some = np.flatnonzero(~alone & (low <= k) & (k <= high) & (size > abs(k)))
        if not len(some):
            continue
        a, b = begin[some], end[some]
        ahead = np.concatenate(([0.0], np.cumsum(x[max(0, -k) : n - max(0, k)] * y[max(0, k) : n - max(0, -k)])))
        p, q, r, t = (a, b - k, a + k, b) if k >= 0 else (a - k, b, a, b + k)  # rows of the left and of the right signal
        sums = [size[some] - abs(k), total[0][q] - total[0][p], total[1][q] - total[1][p], total[2][t] - total[2][r], total[3][t] - total[3][r], ahead[b - abs(k)] - ahead[a]]
        u, w = scales[0][some], scales[1][some]
        owner.append(some)
        lag.append(np.full(len(some), k))
        lines.append(np.stack([s * f for s, f in zip(sums, (1.0, u, u * u, w, w * w, u * w), strict=True)], axis=1))
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    lines = np.concatenate(lines) if lines else np.zeros((0, len(SUMS)))
    lag = np.concatenate(lag) if lag else np.zeros(0, np.int64)
    kept = lines[:, 0] > 0
    owner, lag, lines = owner[kept], lag[kept], lines[kept]
    named = table.select(keys).take(pa.array(begin[owner]))
    return pa.table([*named.columns, pa.array(lag.astype(np.int32)), *[pa.array(s) for s in lines.T.copy()]], [*keys, "lag", *SUMS])


def lag_correlations(
    df: DataFrame, layout: Layout, left: str, right: str, low: Column, high: Column, centre: tuple[Column, Column], fill: bool = False
) -> DataFrame:
    """(keys, lag, r, pairs, left_std, right_std): Pearson correlation of ``left`` at a row with ``right`` ``lag`` rows later.

    ``low`` to ``high`` are the lags of the row's episode and ``centre`` a value near the middle of each signal, both equal on
    all rows of an episode. A signal that is constant over the pairs has no correlation. With ``fill``, for episodes that fit a task
    and whose rows lie together already, gaps are filled by position first.
    """
    keys = list(layout.keys)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lag int, " + ", ".join(f"{s} double" for s in SUMS)
    cells = [F.col(layout.order).cast("long").alias("_seq"), low.cast("long").alias("_low"), high.cast("long").alias("_high")]
    x, y = (F.col(left) - centre[0]).cast("double").alias("_x"), (F.col(right) - centre[1]).cast("double").alias("_y")
    rows = df.filter(low.isNotNull() & high.isNotNull() & (low <= high)).select(*keys, *cells, x, y)
    if layout.whole:
        # The window brings the rows of an episode together, if they aren't yet; the sort is left out where it holds already.
        together = rows.withColumn("_key", F.xxhash64(*keys))
        if not fill:
            together = together.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        together = together.sortWithinPartitions(*keys, "_seq")
        return _correlation(together.mapInArrow(lambda batches: _all_episodes(batches, keys, fill), schema), keys)
    size = layout.chunk_rows
    block = lambda position: F.floor(position / F.lit(size)).cast("long")
    seq = F.col("_seq")
    lefts = rows.select(
        *keys, block(seq).alias("_i"), F.explode(F.sequence(F.greatest(F.lit(0), block(seq + F.col("_low"))), F.greatest(F.lit(0), block(seq + F.col("_high"))))).alias("_j"), "_seq", "_low", "_high", "_x"
    )
    theirs = [f"_key{n}" for n in range(len(keys))]  # names of their own, as both sides come from one table
    rights = rows.select(
        *[F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)], F.explode(F.sequence(F.greatest(F.lit(0), block(seq - F.col("_high"))), F.greatest(F.lit(0), block(seq - F.col("_low"))))).alias("_to"), block(seq).alias("_from"), seq.alias("_at"), F.col("_y").alias("_right")
    )

    def two(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _lines([k.as_py() for k in key[: len(keys)]], a.schema, keys, np.zeros(0, np.int64), np.zeros((0, len(SUMS))))
        p, q = a["_seq"].to_numpy(), b["_at"].to_numpy()
        by_p, by_q = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
        apart = int(q.min() - p.min())  # lag of the two first rows
        lags = np.arange(max(a["_low"][0].as_py(), apart - len(p) + 1), min(a["_high"][0].as_py(), apart + len(q) - 1) + 1)
        return _lines([k.as_py() for k in key[: len(keys)]], a.schema, keys, lags, moments(_column(a, "_x", by_p), _column(b, "_right", by_q), lags - apart))

    paired = lefts.groupBy(*keys, "_i", "_j").cogroup(rights.groupBy(*theirs, "_to", "_from")).applyInArrow(two, schema)
    return _correlation(paired.groupBy(*keys, "lag").agg(*[F.sum(s).alias(s) for s in SUMS]), keys)


def _correlation(sums: DataFrame, keys: list[str]) -> DataFrame:
    spread = lambda s, ss: f"if({ss} - {s} * {s} / pairs > {CONSTANT} * {ss}, {ss} - {s} * {s} / pairs, 0D)"
    return sums.selectExpr(*[f"`{k}`" for k in keys], "lag", "pairs", f"{spread('sx', 'sxx')} AS vx", f"{spread('sy', 'syy')} AS vy", "sxy - sx * sy / pairs AS cxy").selectExpr(
        *[f"`{k}`" for k in keys], "lag", "if(vx > 0 AND vy > 0, cxy / sqrt(vx * vy), NULL) AS r", "cast(pairs AS BIGINT) AS pairs",
        "sqrt(vx / pairs) AS left_std", "sqrt(vy / pairs) AS right_std",
    )
