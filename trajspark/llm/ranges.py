"""Cutting an ordering into ranges of about equal size, the same way in every run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_RANGE, LEAST_RANGE = 32, 4  # rows looked at for each cut, usually and when there are very many cuts
USUAL = 1 << 16  # rows looked at before there are fewer for each cut


def cuts(rows: DataFrame, key: list[Column], n: int) -> list[tuple]:
    """At most n - 1 ascending keys that cut the rows into ranges.

    They come from about ``PER_RANGE`` * n rows, chosen by a hash of the key, so that the number brought to the driver follows the
    number of ranges and not that of the rows. The key should tell rows apart, or ranges get uneven.
    """
    names = [f"k{i}" for i in range(len(key))]
    keyed = rows.select(*[k.alias(c) for k, c in zip(key, names, strict=True)])
    wanted = min(PER_RANGE * n, max(LEAST_RANGE * n, USUAL))
    total = keyed.count()
    some = keyed.where(F.pmod(F.xxhash64(*names), F.lit(max(1, total))) < wanted).limit(2 * wanted)
    got = sorted((tuple(r) for r in some.collect()), key=lambda r: [(v is not None, v) for v in r])
    picked = [got[len(got) * i // n] for i in range(1, n)] if got else []
    return sorted(set(picked))


def range_of(key: Iterable[Column], at: list[tuple]) -> Column:
    """The number of cuts at or below the key: its range. Built as a balanced comparison, so log2(n) tests a row."""
    key = list(key)

    def below(cut: tuple) -> Column:
        test = F.lit(False)
        for c, v in reversed(list(zip(key, cut, strict=True))):
            test = (c < F.lit(v)) | ((c == F.lit(v)) & test)
        return test

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(at[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(at))
