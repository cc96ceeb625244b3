"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through as often as its target asks (at most ``repeats``
times). A document's virtual finish time is the words its queue has sent up to its end, divided by the source's target, so
at any moment all sources have had the same part of their targets. The mix is the documents in order of virtual finish time,
cut off at the total budget; a document that straddles the end of its source's target is sent if that brings the source nearer
to its target.

Running sums over a source take two steps: sums of buckets of the shuffled order, then sums within a bucket. Buckets hold
about ``BUCKET_ROWS`` documents, so a source with a third of all rows is spread over as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm.ranges import cuts, range_of
from trajspark.llm.storage import partitions, query, written

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 20_000


def words_of(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, n_docs, target): the budget, ``share`` of all sizes, dealt by weight with a cap of ``most`` sizes each.

    Sources are ordered by code point, null last, and take the weights in turn. With all sources below level L at weight times L
    and the rest at their caps, the excess is reshared until none is above its cap: sources by cap / weight, the first k capped.
    One row per source, so the windows over all of them see few rows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    # Every comparison is of cap_a * weight_b with cap_b * weight_a at heart; the ratio orders them, the weight breaks ties.
    w = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.lit(share) * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # The level that the budget would reach if this source and all after it stayed below their caps.
    rows = rows.withColumn("level", left / open_weight)
    rows = rows.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # The first source that isn't full sets the level of all that follow.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("weight"), F.col("level")))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * first["level"])
    return rows.select("source", "source_size", "n_docs", F.least(target, F.col("cap")).alias("target"))


def schedule(
    docs: DataFrame, carry: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, key: str = "doc_id", seed: str = "mix"
) -> DataFrame:
    """(doc, size, source_size, target, copies, finish) of every row; ``doc`` holds the columns to ``carry``.

    copies: how often the mix takes the row. finish: its virtual finish time in the first pass (null without a target); a pass later
    it is greater by source_size / target. The shuffle is an order by md5 of seed and key, rows with equal keys by md5 of the text,
    so it is the same in every run and in every pass. Texts without words have size 0 and are never taken. A source without words
    has target 0; a null source is a source of its own. No rows: no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(f"`{key}`").cast("string").alias("key"), F.coalesce("source", F.lit("")).alias("s"),
        F.col("source").isNull().alias("none"), words_of(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"),
    ).withColumn("o", F.md5(F.concat(F.lit(seed + ":"), F.coalesce("key", F.lit(""))).cast("binary")))
    source = F.when(~F.col("none"), F.col("s")).alias("source")
    per_source = rows.groupBy("s", "none").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goals = targets(per_source.select(source, "source_size", "n_docs"), weights, share, most)
    goals = written(goals, "targets").select(
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target",
        ((F.col("n_docs") / BUCKET_ROWS).cast("long") + 1).alias("buckets"),
    )
    keyed = rows.join(goals, ["s", "none"])
    # The first 40 bits of the order, cut into equal parts.
    part = (F.conv(F.substring("o", 1, 10), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 40)).cast("long")
    keyed = keyed.withColumn("bucket", F.least(part, F.col("buckets") - 1))
    past = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s", "none").orderBy("bucket").rowsBetween(*past)
    sums = keyed.groupBy("s", "none", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.select("s", "none", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("s", "none", "bucket").orderBy("o", "key", "tie").rowsBetween(*past)
    keyed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["s", "none", "bucket"])
    sent = F.col("start") + F.col("inner")
    copies = F.lit(0)
    for k in range(most):
        # Twice the virtual time of the middle of the document's k-th copy, times the target.
        middle = (2 * k * F.col("source_size") + 2 * sent + F.col("size")).cast("double")
        copies = copies + F.when((F.col("size") > 0) & (middle <= 2 * F.col("target")), 1).otherwise(0)
    finish = F.when(F.col("target") > 0, (sent + F.col("size")) / F.col("target"))
    return keyed.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"), finish.alias("finish"))


def mix(docs: DataFrame, ordered: bool = True, **options) -> DataFrame:
    """The mix: the given columns, a row for every copy that is taken.

    ordered: sorted by virtual finish time over all partitions, which costs one more shuffle of the taken rows. Every queue is cut
    where it reaches virtual time 1, and there the queues together have sent the total budget, so the cut needs no second sum.
    """
    names = docs.columns
    taken = schedule(docs, names, **options).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    if ordered:
        at = F.col("finish") + F.col("pass") * F.col("source_size") / F.col("target")
        taken = taken.withColumn("at", at).repartitionByRange("at", F.xxhash64("doc")).sortWithinPartitions("at")
    return taken.select(*[F.col("doc").getField(c).alias(c) for c in names])


def sequence(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, **options) -> DataFrame:
    """(doc, size, pass, place, words_before): the copies in order of virtual finish time, cut off at the total budget.

    The queues hold every copy, none is cut at its own target. The copy that straddles the budget is kept if that brings the total
    nearer to it. Only ``carry`` and the sizes are dealt out by finish time, no texts. Running sums take two steps as in schedule():
    totals of ranges of finish times, then sums within a range. Equal times of two sources go by source; a queue has no equal times.
    """
    spark = docs.sparkSession
    with_source = docs.withColumn("_source", F.col("source"))
    rows = schedule(with_source, [*carry, "_source"], weights, share, most, **options).where("size > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    at = F.col("finish") + F.col("pass") * F.col("source_size") / F.col("target")
    source = F.col("doc").getField("_source").alias("source")
    rows = rows.select(F.struct(*[F.col("doc").getField(c).alias(c) for c in carry]).alias("doc"), source, "size", "pass", at.alias("at"))
    rows = written(rows, "copies")
    n = partitions(spark)
    dealt = rows.withColumn("range", range_of([F.col("at")], cuts(rows, [F.col("at")], n)))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("words"), F.count("*").alias("copies"), F.sum(F.when(F.col("pass") == 0, F.col("size"))).alias("once"))
    # One row per range, so the windows over all of them see few rows.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = sums.select("range", total("words").alias("words"), total("copies").alias("copies"), (share * F.sum("once").over(Window.partitionBy())).alias("budget"))
    order = Window.partitionBy("range").orderBy("at", F.col("source").asc_nulls_last())
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumns({"inner": inside, "row": F.row_number().over(order)}).join(F.broadcast(starts), "range")
    before = F.col("words") + F.col("inner")
    kept = dealt.where(2 * before + F.col("size") <= 2 * F.col("budget"))
    return kept.select("doc", "size", "pass", (F.col("copies") + F.col("row")).cast("long").alias("place"), before.cast("long").alias("words_before"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
  md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= weight * level AS is_full FROM l),
t AS (SELECT source, source_size, least(CASE WHEN is_full THEN cap ELSE weight * (SELECT arg_min(level, (cap / weight, weight)) FROM f WHERE NOT is_full) END, cap) AS target FROM f),
r AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, CAST(doc_id AS VARCHAR), tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (CASE WHEN size > 0 AND 2 * sent + size <= 2 * target THEN 1 ELSE 0 END + CASE WHEN size > 0 AND 2 * source_size + 2 * sent + size <= 2 * target THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@query("op9_mixing", ORACLE)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = schedule(docs, ["doc_id"])
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORDER_ORACLE = (
    ORACLE[: ORACLE.rindex("SELECT doc_id, CAST(size")].rstrip()
    + """,
c AS (SELECT doc_id, source, size, pass, (sent + size)::DOUBLE / target + (pass * source_size)::DOUBLE / target AS fin FROM r, range(2) p(pass) WHERE size > 0),
b AS (SELECT *, row_number() OVER w AS place, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM c WINDOW w AS (ORDER BY fin, source NULLS LAST))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(pass AS INT) AS pass, CAST(place AS BIGINT) AS place, CAST(words_before AS BIGINT) AS words_before
FROM b WHERE 2 * words_before + size <= 2 * (SELECT 1.5::DOUBLE * sum(source_size) FROM s)
"""
)


@query("op9_mixing_order", ORDER_ORACLE)
def op9_mixing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: all sources in one order of virtual finish times, up to the total budget."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return sequence(docs, ["doc_id"]).select("doc.doc_id", "size", "pass", "place", "words_before")
