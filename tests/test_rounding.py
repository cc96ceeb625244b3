"""Rounding of ties against DuckDB, which checks the scores."""

import math
import random

from pyspark.sql import functions as F

from trajspark.functions.columns import round_even
from trajspark.operators import score


def test_ties_like_sql(spark):
    import duckdb

    rng = random.Random(4)
    values = [29.549999999999997, 26.450000000000003, 15.149999999999999, -0.04, 0.25, 0.35, None]
    for _ in range(500):
        x = (rng.randrange(-2000, 2000) + 0.5) / 10
        values += [x, math.nextafter(x, 1e9), math.nextafter(x, -1e9)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r["i"]: r["y"] for r in rows.select("i", round_even("x", 1).alias("y")).collect()}
    sql = ", ".join(f"({i}, {'NULL' if x is None else repr(x) + 'e0'}::DOUBLE)" for i, x in enumerate(values))
    want = dict(duckdb.sql(f"SELECT i, round_even(x, 1) FROM (VALUES {sql}) t(i, x)").fetchall())
    assert got == want
    assert got[0] == 29.6 and got[1] == 26.4


def test_dimension_of_a_tie(spark):
    expr = score.DIMENSION_SQL["completeness"]
    got = spark.createDataFrame([(x,) for x in (0.05870833333333334, 0.0612916666666666)], "missing_rate double").selectExpr(f"{expr} AS y", "greatest(0D, 100D - least(100D, missing_rate * 1200)) AS x").collect()
    assert [r["y"] for r in got] == [round_like(r["x"]) for r in got]


def round_like(x):
    return round(x * 10.0) / 10.0
