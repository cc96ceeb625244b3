"""URL filters by a sort-merge range join of reversed hosts.

The canonical key of a host is its labels in reverse, each followed by a dot: ``www.example.org`` is ``org.example.www.``.
A rule for a host then covers the interval of keys that begin with the rule's key, and intervals are nested or apart. Pages
and interval starts are put in key order; one sweep keeps the open intervals on a stack, at most one for each label of a
host, and a page only looks at the rules on the stack.

Pages are dealt into ranges of (key, path, page), so one host may fill many ranges. A rule goes to every range that its
interval meets. No page is compared with a rule outside its stack, and neither side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.ranges import cuts, range_of
from trajspark.llm.storage import partitions, query

# The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RANGES = 2048  # a sweep keeps nothing but its stack, so ranges may be long
AFTER_DOT = "/"  # the character after the dot: keys from "k" to "k" with its last dot replaced begin with "k"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end.

    A null url, or one without ``://``, has neither: both are empty.
    """
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    rules: host, path, verdict. A rule fits its host and all subdomains if the page's path begins with the rule's. The longest
    rule wins (host and path together; then the longer host; then the smaller verdict), whatever the order of the rules. Pages
    that no rule fits get ``otherwise``. Null fields of a rule count as empty; a rule with an empty host fits no page. Repeated
    pages give repeated rows, and repeated rules count once.
    """
    spark = pages.sparkSession
    n = min(partitions(spark), MOST_RANGES)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    at = cuts(rows, [F.col("key"), F.col("path"), F.coalesce("page_id", F.lit(-1))], n)
    dealt = rows.withColumn("range", range_of([F.col("key"), F.col("path"), F.coalesce("page_id", F.lit(-1))], at))
    named = rules.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path", "verdict")]).where("host <> ''").distinct()
    named = named.withColumn("host", F.translate("host", UPPER, LOWER)).withColumn("key", host_key(F.col("host")))
    beyond = F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit(AFTER_DOT))
    low = range_of([F.col("key"), F.lit(""), F.lit(np.iinfo(np.int64).min)], at)
    high = range_of([beyond, F.lit(""), F.lit(np.iinfo(np.int64).min)], at)
    spread = named.withColumn("range", F.explode(F.sequence(low, high)))
    columns = ["range", "key", "kind", "page_id", "host", "path", "verdict"]
    events = dealt.withColumn("kind", F.lit(1)).withColumn("verdict", F.lit(None).cast("string")).select(columns).unionByName(
        spread.withColumn("kind", F.lit(0)).withColumn("page_id", F.lit(None).cast("long")).select(columns)
    )

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, list[tuple[str, str, str]]]] = []  # open intervals: key, and (path, host, verdict) of its rules
        now = None
        for f in frames:
            out = []
            for where, key, kind, page, host, path, verdict in zip(*[f[c].tolist() for c in columns], strict=True):
                if where != now:
                    stack, now = [], where
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, host, verdict))
                    continue
                best = None
                for _, held in stack:
                    for rule_path, rule_host, says in held:
                        if path.startswith(rule_path):
                            size = (-len(rule_host) - len(rule_path), -len(rule_host), says, rule_host, rule_path)
                            best = size if best is None or size < best else best
                out.append((page, host, path, best and best[3] + best[4], best[2] if best else otherwise))
            if out:
                result = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
                result["page_id"] = pd.array(result["page_id"], dtype="Int64")
                yield result

    ordered = events.repartition(n, "range").sortWithinPartitions("range", "key", "kind", "path", "page_id")
    return ordered.mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")


ORACLE = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, coalesce(any_value(host), '') AS host, coalesce(any_value(path), '') AS path, arg_max(rh || rp, length(rh) + length(rp)) AS rule,
  coalesce(arg_max(says, length(rh) + length(rp)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
"""


@query("op2_url_rules", ORACLE)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
