"""Exact quantiles per group when a group may be far too large for one task.

``percentile`` keeps every distinct value of a group in one buffer. Groups above a row limit take two passes over their rows for all
quantiles together. The first brackets each quantile: a mergeable sketch with a bounded rank error gives a value that is surely
at or below its rank and one that is surely at or above. The second counts the values below the bracket and the distinct values
within, stacked as (name, value) rows in one aggregate. Both are combined on the map side, so a group that holds a third of all rows
costs no single task more than others, and only the few values within brackets are ever ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import finite

ACCURACY = 10_000  # the sketch errs by at most one in so many ranks


def _brackets(rows: DataFrame, keys: list[str], quantiles: list[tuple[Column, float]]) -> DataFrame:
    """Per group and quantile number: ``n`` values, and ``lo``, ``hi`` around the target ranks."""
    sums = []
    for i, (_, p) in enumerate(quantiles):
        low, high = p - 2 / ACCURACY, p + 2 / ACCURACY
        at = F.percentile_approx(f"_v{i}", [max(low, 0.0), min(high, 1.0)], ACCURACY)
        sums += [F.count(f"_v{i}").alias(f"_n{i}"), F.min(f"_v{i}").alias(f"_min{i}"), F.max(f"_v{i}").alias(f"_max{i}"), at.alias(f"_at{i}")]
    found = rows.groupBy(*keys).agg(*sums)
    ends = []
    for i, (_, p) in enumerate(quantiles):
        few = F.col(f"_n{i}") < 4 * ACCURACY  # of few values all are counted: there two neighbouring ranks may lie further apart than the bracket
        ends += [
            F.col(f"_n{i}"),
            F.when(few | F.lit(p * ACCURACY <= 2), F.col(f"_min{i}")).otherwise(F.get(f"_at{i}", F.lit(0))).alias(f"_lo{i}"),
            F.when(few | F.lit((1 - p) * ACCURACY <= 2), F.col(f"_max{i}")).otherwise(F.get(f"_at{i}", F.lit(1))).alias(f"_hi{i}"),
        ]
    return found.select(*keys, *ends)


def _large_groups(rows: DataFrame, keys: list[str], quantiles: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """The quantiles of groups of any size; there must be few groups, as a row of each is broadcast."""
    wanted = list(quantiles.values())
    rows = rows.select(*keys, *[finite(c).alias(f"_v{i}") for i, (c, _) in enumerate(wanted)])
    brackets = _brackets(rows, keys, wanted)
    places = []
    for i in range(len(wanted)):
        v = F.col(f"_v{i}")
        place = F.struct(F.lit(i).alias("_q"), F.when(v >= F.col(f"_lo{i}"), v).alias("_value"))
        places.append(F.when(v <= F.col(f"_hi{i}"), place))
    counted = rows.join(F.broadcast(brackets), keys).select(*keys, F.inline(F.array_compact(F.array(*places)))).groupBy(*keys, "_q", "_value").count()
    upto = F.sum("count").over(Window.partitionBy(*keys, "_q").orderBy(F.col("_value").asc_nulls_first()))
    sizes = F.inline(F.array(*[F.struct(F.lit(i).alias("_q"), F.col(f"_n{i}").alias("_size"), ((F.col(f"_n{i}") - 1) * F.lit(float(p))).alias("_position")) for i, (_, p) in enumerate(wanted)]))
    ranked = counted.withColumn("_upto", upto).join(F.broadcast(brackets.select(*keys, sizes)), [*keys, "_q"])
    picked = ranked.groupBy(*keys, "_q", "_position").agg(
        F.min(F.when(F.col("_upto") > F.floor("_position"), F.struct("_upto", "_value")))["_value"].alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_position"), F.struct("_upto", "_value")))["_value"].alias("_b"),
    )
    share = F.col("_position") - F.floor("_position")
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b"))
    # A rank outside its bracket would contradict the error bound of the sketch: rather fail than give another value.
    sure = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(between)
    values = picked.select(*keys, "_q", sure.cast("double").alias("_value"))
    return values.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, F.col("_value"))).alias(n) for i, n in enumerate(quantiles)])


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], quantiles: Mapping[str, tuple[Column, float]], limit: int
) -> DataFrame:
    """Exact quantiles (linear interpolation; nulls, NaN and infinity ignored) with one row per group."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = sizes.filter(F.col("_rows") > limit).select(*keys)
    # At most rows / limit groups are large, which bounds what is broadcast.
    small = df.join(F.broadcast(large), keys, "left_anti")
    ordinary = small.groupBy(*keys).agg(*[F.percentile(finite(c), p).alias(n) for n, (c, p) in quantiles.items()])
    rows = df.join(F.broadcast(large), keys, "left_semi")
    found = large.join(_large_groups(rows, keys, quantiles), keys, "left")  # groups without any value stay, with nulls
    return ordinary.unionByName(found.select(*ordinary.columns))
