"""The repair of a dataset in one row: totals, actions and what became of the issues."""

from test_queries import test_query_matches_sql as matches_sql

from trajspark.operators import repair as rp


def test_the_batch_summary_has_actions_and_outcomes(spark, sf_dir):
    matches_sql(spark, sf_dir, "batch_repair_summary")


def test_actions_come_by_rows_then_code(spark):
    summary = spark.createDataFrame([(5, 3, 2, 3, 1), (4, 0, 0, 4, 0)], "source_rows long, modified_rows long, quarantined_rows long, retained_rows long, after_issue_count int")
    actions = spark.createDataFrame([("B", 2), ("A", 2), ("C", 5), ("C", 1)], "code string, row_count long")
    resolution = spark.createDataFrame([(["X", "Y"], ["Z"]), (["X"], [])], "resolved array<string>, unresolved array<string>")
    row = rp.batch_summary(summary, actions, resolution).first()
    assert (row.episode_count, row.source_rows, row.modified_rows, row.quarantined_rows, row.retained_rows, row.retained_rate, row.status) == (2, 9, 3, 2, 7, 77.78, "review_required")
    assert [tuple(x) for x in row.actions] == [("C", 2, 6), ("A", 1, 2), ("B", 1, 2)]
    assert [tuple(x) for x in row.resolved] == [("X", 2), ("Y", 1)] and [tuple(x) for x in row.unresolved] == [("Z", 1)]
    none = rp.batch_summary(summary.limit(0), actions.limit(0), resolution.limit(0)).first()
    assert (none.episode_count, none.source_rows, none.retained_rate, none.status, none.actions, none.resolved) == (0, 0, 0.0, "ready", [], [])
