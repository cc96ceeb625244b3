"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as true.
TRUE_WORDS = ("1", "true", "yes", "success")
TRUE_WORDS_LOCAL = (*TRUE_WORDS, "成功")
MAD_TO_SIGMA = 1.4826


def numeric(column: str) -> Column:
    """The channel as a number; text that is not a number is null."""
    return F.expr(numeric_sql(column))


def numeric_sql(column: str) -> str:
    return f"try_cast(`{column}` AS DOUBLE)"


def finite_sql(column: str) -> str:
    """The channel as a number; text, NaN and infinity are null."""
    return f"if(abs({numeric_sql(column)}) < double('Infinity'), {numeric_sql(column)}, NULL)"


def finite(column: str | Column) -> Column:
    """The number, or null for text, NaN and infinity."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_float(column: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(column), F.lit(default))


def round_even(column: str | Column, digits: int) -> Column:
    """Rounded half to even as floating point gives it: the scaled value decides a tie, not the shortest decimal as in ``bround``.

    The SQL texts of the operators write it as ``rint(x * 100D) / 100D + 0D``; no result is a negative zero.
    """
    value = F.col(column) if isinstance(column, str) else column
    return F.rint(value * float(10**digits)) / float(10**digits) + F.lit(0.0)


def truthy(column: str | Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*words), F.lit(False))


def norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(total([p * p for p in parts]))


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def is_true(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def array_of(items: Sequence[Column]) -> Column:
    """The non-null items, in order."""
    return F.array_compact(F.array(*items))


def mad_threshold(median: Column, mad: Column, scale: float, floor: float) -> Column:
    """max(floor, median + scale * sigma), where sigma comes from the median absolute deviation."""
    spread = F.greatest(mad, F.lit(1e-9))
    return F.greatest(F.lit(float(floor)), F.coalesce(median + scale * MAD_TO_SIGMA * spread, F.lit(float(floor))))
