"""The order of the mix against SQL, its total against the budget."""

import duckdb

from trajspark.llm import mixing


def test_order_is_cut_at_the_budget(spark, sf_dir):
    rows = sorted(mixing.op9_mixing_order(spark, sf_dir).collect(), key=lambda r: r["place"])
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = duck.sql(f"select doc_id, size, pass, place, words_before from ({mixing.ORDER_ORACLE}) order by place").fetchall()
    assert [(r["doc_id"], r["size"], r["pass"], r["place"], r["words_before"]) for r in rows] == [tuple(w) for w in want]
    words = 0
    for k, r in enumerate(rows, 1):
        assert (r["place"], r["words_before"]) == (k, words)
        words += r["size"]
    # The last copy brings the total nearer to the budget, and so would no further one.
    budget = 1.5 * duck.sql(f"select sum(size) from ({mixing.ORACLE})").fetchall()[0][0]
    assert abs(words - budget) <= max(r["size"] for r in rows) / 2


def test_order_of_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert mixing.sequence(docs, ["doc_id"]).count() == 0
