"""WARC archives of pages, and an index of their captures by external merge.

Archives: one gzipped text file per task, written and committed by Spark, so that any shared storage and lost tasks are
handled. Records follow WARC 1.1; every record of a run begins with the same two header lines, of which the second names the
run by a random id, so a reader may split the files at that mark whatever the payloads hold.

Index: the captures read from each file are sorted locally in runs of bounded length. Each run is cut at global bounds, and
the pieces of one range are merged by a loser tree. Ranges follow (URL key, time stamp, page), so a host, or a URL, with very
many captures fills as many ranges as it needs, and the ranges together are in global order.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm.ranges import cuts
from trajspark.llm.storage import partitions, query, scratch, written
from trajspark.llm.urlrules import host_and_path

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN_ROWS = 1 << 16  # captures of one locally sorted run
RANGE_ROWS = 50_000  # captures that a merge is meant to hold
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal digest: five hexadecimal digits make four."""
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds payload, its bytes and digest, and ``first``: the smallest page with an equal payload of at least ``least`` bytes.

    Only the groups of two or more pages are written and joined; where they are few, Spark broadcasts them by their size.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    same = rows.where(F.col("payload_bytes") >= least).groupBy("hex", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(same.where("n > 1").drop("n"), "groups")
    return rows.join(groups, ["hex", "payload_bytes"], "left").withColumn("first", F.coalesce("first", "page_id")).withColumn("payload_digest", base32(F.col("hex")))


def mark(run: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{run}>\r\n"


def write_archives(pages: DataFrame, path: str, run: str, least: int = 0) -> None:
    """A record per page. A page whose payload an earlier page has is a revisit of that page and holds no payload again.

    Null html is an empty payload; a null url has no target line; line breaks in a url are percent-encoded. Rows that repeat a
    page id with its payload are each written, as responses where the id is the smallest. The date counts seconds from the
    page id, because pages have none.
    """
    rows = with_first(pages, least)
    revisit = ~F.col("first").eqNullSafe(F.col("page_id"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit(mark(run) + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <urn:page:{run}:"), number, F.lit(">\r\nWARC-Date: "), date,
        F.when(target.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), target)),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{run}:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit(END + HTTP_HEAD), F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The captures of all archives: page_id, url, stamp, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, file.

    Bytes and digest of a response are taken from its payload; where the header differs, reading fails.
    """
    raw = spark.read.option("lineSep", mark(run)).text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.length("value") > 0)
    split = F.instr("value", END)
    rows = raw.select("file", F.substring("value", 1, split - 1).alias("head"), F.expr("substr(value, " + f"instr(value, '{END}') + {len(END) + len(HTTP_HEAD)})").alias("rest"))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    kind = field("WARC-Type")
    payload = F.when(kind == "response", F.expr(f"substr(rest, 1, length(rest) - {len(END)})"))
    rows = rows.select(
        field("WARC-Record-ID").alias("id"), field("WARC-Target-URI").alias("url"), F.regexp_replace(field("WARC-Date"), "[^0-9]", "").alias("stamp"),
        kind.alias("record_type"), field("WARC-Refers-To").alias("refers"), payload.alias("payload"), field("WARC-Payload-Digest").substr(6, 32).alias("told"),
        field("X-Payload-Length").cast("long").alias("told_bytes"), "file",
    )
    number = lambda c: F.regexp_extract(c, r":([0-9-]*)>$", 1)
    own = F.when(F.col("record_type") == "response", base32(F.sha1(F.col("payload").cast("binary")))).otherwise(F.col("told"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("told_bytes"))
    whole = (own == F.col("told")) & (size == F.col("told_bytes"))
    return rows.select(
        F.when(number("id") != "", number("id")).cast("long").alias("page_id"), "url", "stamp", "payload",
        F.when(whole, size).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("id")))).alias("payload_bytes"), own.alias("payload_digest"),
        "record_type", number("refers").cast("long").alias("refers_to"), "file",
    )


class LoserTree:
    """Merges k sorted iterators; each inner node keeps the loser of its match, so a step costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self.replay(leaf)

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self.before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (best := self.losers[0]) >= 0 and (head := self.heads[best]) is not None:
            yield head
            self.heads[best] = next(self.runs[best], None)
            self.replay(best)


def capture_index(captures: DataFrame) -> DataFrame:
    """The captures in global order of (url_key, stamp, page_id), with their place ``index_pos`` from 0.

    url_key: the host's labels in reverse, a bracket, then path and query. Null urls have an empty key and come first.
    """
    spark = captures.sparkSession
    host, path = host_and_path(F.col("url"))
    tail = F.regexp_extract("url", r"://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, F.coalesce(tail, F.lit("")))
    rows = captures.drop("payload").withColumn("url_key", F.when(F.col("url").isNull(), "").otherwise(key))
    rows = written(rows.withColumn("order_id", F.coalesce("page_id", F.lit(-(1 << 62)))), "captures")
    n = max(partitions(spark), -(-rows.count() // RANGE_ROWS))
    order = ["url_key", "stamp", "order_id"]
    at = spark.sparkContext.broadcast(cuts(rows, [F.col(c) for c in order], n))
    names = rows.columns

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = 0, [], 0

        def close() -> pd.DataFrame:
            f = pd.concat(held).sort_values(order, kind="stable", ignore_index=True)
            keys = zip(*[f[c].tolist() for c in order], strict=True)
            return f.assign(range=[bisect.bisect_right(at.value, k) for k in keys], run=(TaskContext.get().partitionId() << 20) + number, place=range(len(f)))

        for f in frames:
            held.append(f.astype({"page_id": "Int64", "refers_to": "Int64"}))
            size += len(f)
            if size >= RUN_ROWS:
                yield close()
                number, held, size = number + 1, [], 0
        if size:
            yield close()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def close() -> pd.DataFrame:
            f = pd.concat(held, ignore_index=True)
            keys = list(zip(*[f[c].tolist() for c in order], range(len(f)), strict=True))
            run = f["run"].to_numpy()
            starts = [0, *((run[1:] != run[:-1]).nonzero()[0] + 1).tolist(), len(f)]
            merged = [k[-1] for k in LoserTree([iter(keys[a:b]) for a, b in zip(starts, starts[1:], strict=False)])]
            return f.iloc[merged].assign(place=range(len(f))).drop(columns="run")

        for f in frames:
            f = f.astype({"page_id": "Int64", "refers_to": "Int64"})
            for where, part in f.groupby("range", sort=False):
                if where != now and held:
                    yield close()
                    held = []
                now = where
                held.append(part)
        if held:
            yield close()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    sorted_runs = rows.mapInPandas(runs, schema + ", range long, run long, place long")
    dealt = sorted_runs.repartition(partitions(spark), "range").sortWithinPartitions("range", "run", "place")
    merged = written(dealt.mapInPandas(merge, schema + ", range long, place long"), "index")
    sizes = merged.groupBy("range").count()
    offsets = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    return merged.join(offsets, "range").withColumn("index_pos", F.col("before") + F.col("place")).drop("range", "place", "before", "order_id")


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives to a new shared folder, reads them back and indexes their captures."""
    spark = pages.sparkSession
    path, run = scratch(spark, "warc"), str(uuid.uuid4())
    write_archives(pages, path, run, least)
    return capture_index(read_archives(spark, path, run))


@query("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "index_pos")
