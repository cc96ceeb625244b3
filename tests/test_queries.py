"""Some registered queries against DuckDB on the small tables, and the shape of the registry."""

import math

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "step_interval", "short_gap_interpolate", "contiguous_segments", "quality_score", "episode_metrics", "route_messages", "asof_merge_streams",
    "repair_actions", "predicate_grounding", "recovery_result", "readiness_scores", "violation_monitor_batch", "inject_stuck",
]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return f"{value + 0.0:.6g}".replace("-0", "0") if value == 0 else f"{value:.6g}"
    return str(value)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 160


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=str)
    index = [want.columns.index(c) for c in order]
    expected = sorted([tuple(plain(r[i]) for i in index) for r in want.fetchall()], key=str)
    assert rows == expected


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
