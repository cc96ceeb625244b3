"""Personal data by patterns, and by contexts that are learned from what the patterns find.

The base finds e-mail addresses, IP addresses, card and phone numbers. Bootstrapping then takes these as seed entities: the word
before an entity, the two words before it and the word after it are lexical patterns, and every word with a digit or ``@`` is an
instance. Patterns and instances score each
other in rounds over their graph: a pattern by the share of its instances that are entities, smoothed so that few instances
prove little; an instance by noisy-or over its patterns. Instances of high score that the base did not find are added as ``id``.

Everything is DataFrame functions. Texts are read once; what follows works on the few words that can be identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.storage import query, written

KINDS = ("email", "ip", "card", "phone", "id")
# A run is tried from its start only (or from the end of the last match), and possessively: from any later character it ends at the
# same place, so nothing more is found, and one long run costs its length. A card pattern that also takes a single digit finds nothing
# more, because a single digit touches no other match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
BLOCK = 256  # matches whose positions are summed in one go
SMOOTH, LEAST_SEEDS = 2.0, 3  # instances added to every pattern's count; seeds a pattern needs
ACCEPT, ROUNDS = 0.7, 3
LEAST_CHARS = 6  # shortest instance that is added


def located(rows: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, for each name with (pattern, filter), array<struct<start, end, match, before, after>> of the leftmost non-overlapping
    matches, in code points.

    Java's split cuts at the same matches that the extraction finds, so lengths of pieces and matches add up to positions. Sums
    run in blocks, so that many matches in one text cost little more than their number. Each step is a column of its own, which
    keeps Spark from running a pattern again for every use.
    """
    empty = F.array().cast("array<string>")
    whole = F.col(text)
    found = {f"_m_{n}": F.when(maybe, F.regexp_extract_all(whole, F.lit(p), F.lit(0))).otherwise(empty) for n, (p, maybe) in patterns.items()}
    pieces = {f"_p_{n}": F.when(maybe, F.split(whole, p, -1)).otherwise(empty) for n, (p, maybe) in patterns.items()}
    rows = rows.withColumns(found | pieces)
    for_each = {}
    for n in patterns:
        m, p = F.col(f"_m_{n}"), F.col(f"_p_{n}")
        for_each[f"_z_{n}"] = F.arrays_zip(m.alias("m"), F.slice(p, 1, F.size(m)).alias("p"), F.slice(p, 2, F.greatest(F.size(m), F.lit(1))).alias("q"))
    rows = rows.withColumns(for_each).drop(*found, *pieces)
    return rows.withColumns({n: _positions(F.col(f"_z_{n}")) for n in patterns}).drop(*for_each)


def _positions(z: Column) -> Column:
    one = "struct<start:int,end:int,match:string,before:string,after:string>"
    none, nothing = F.array().cast(f"array<{one}>"), F.array().cast(f"array<array<{one}>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), x["p"].alias("before"), x["q"].alias("after"))
        return F.struct(end.alias("pos"), F.concat(acc["done"], F.array(hit)).alias("done"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["pos"].alias("pos"), none.alias("done")), step)
        return F.struct(inner["pos"].alias("pos"), F.concat(acc["done"], F.array(inner["done"])).alias("done"))

    blocks = F.when(F.size(z) > 0, F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), nothing.alias("done")), block, lambda acc: F.flatten(acc["done"]))


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check-digit rule."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, 1).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise((2 * d) % 10 + F.floor(2 * d / 10).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda part: (F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3) & (F.regexp_replace(part, "^0+(?=.)", "").substr(1, 3).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: array<struct<start, kind, end>> by start, then kind in the order of ``KINDS``."""
    t = F.col(text)
    maybe = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]"), "phone": t.rlike(r"\+[0-9]")}
    rows = located(rows, text, {f"_{k}": (PATTERNS[k], maybe[k]) for k in KINDS[:4]})
    spans = F.array_sort(F.concat(*[_spans(F.col(f"_{k}"), order) for order, k in enumerate(KINDS[:4])]))
    return rows.withColumn("base", spans).drop(*[f"_{k}" for k in KINDS[:4]])


def _spans(hits: Column, order: int) -> Column:
    valid = F.filter(hits, lambda x: _valid(KINDS[order], x["match"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")))


def _count(spans: Column, order: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == order)).cast("long")


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``words``: array<struct<start, end, match, contexts, seed>> of the words that may be identifiers, without closing punctuation.

    contexts: the word before (``l:``), the two words before (``ll:``) and the word after (``r:``), of those that hold a letter.
    """
    base = F.col("base")

    def shape(x: Column) -> Column:
        bare = F.regexp_replace(x["match"], r"(?<![.,;:!?\"')\]])[.,;:!?\"')\]]++$", "")
        end = x["start"] + F.length(bare)
        near = lambda c: F.regexp_replace(F.lower(c), r"^[^\p{L}]++|(?<![^\p{L}])[^\p{L}]++$", "")
        one = near(F.regexp_extract(x["before"], r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$", 1))
        two = near(F.regexp_extract(x["before"], r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$", 1))
        after = near(F.regexp_extract(x["after"], r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))
        contexts = F.array(
            F.when(one != "", F.concat(F.lit("l:"), one)), F.when((one != "") & (two != ""), F.concat(F.lit("ll:"), two, F.lit(" "), one)),
            F.when(after != "", F.concat(F.lit("r:"), after)),
        )
        contexts = F.array_compact(contexts)
        seed = F.exists(base, lambda b: (b["start"] < end) & (x["start"] < b["end"]))
        return F.struct(x["start"].alias("start"), end.alias("end"), bare.alias("match"), contexts.alias("contexts"), seed.alias("seed"))

    rows = located(rows, text, {"_word": (WORD, F.col(text).rlike("[0-9@]"))})
    return rows.withColumn("words", F.transform("_word", shape)).drop("_word")


def discover(words: DataFrame) -> DataFrame:
    """The words (row, start, end, match, contexts, seed) that are no seeds and whose instance scores at least ``ACCEPT``.

    Scores of patterns and instances settle over ``ROUNDS`` rounds. An instance that a round accepts counts as an entity in the
    next. Sums are combined before the shuffle, so a very common context is no single task's work.
    """
    graph = words.select("match", "seed", F.explode("contexts").alias("context")).groupBy("context", "match").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("double")).alias("seed"))
    graph = written(graph, "graph")
    scores = graph.groupBy("match").agg(F.max("seed").alias("score"))
    for _ in range(ROUNDS):
        edges = graph.join(scores, "match")
        trusted = F.when((F.col("score") >= ACCEPT), F.col("score")).otherwise(0.0)
        patterns = edges.groupBy("context").agg(
            (F.sum(trusted) / (F.count("*") + F.lit(SMOOTH))).alias("trust"), F.sum(F.when(F.col("score") >= ACCEPT, 1).otherwise(0)).alias("entities")
        ).where(F.col("entities") >= LEAST_SEEDS)
        doubt = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999))))
        near = graph.join(patterns, "context").groupBy("match").agg((1 - F.exp(doubt)).alias("near"))
        scores = written(scores.join(near, "match", "left").select("match", F.greatest("score", F.coalesce("near", F.lit(0.0))).alias("score")), "scores")
    good = scores.where(F.col("score") >= ACCEPT).select("match")
    added = words.where(~F.col("seed") & (F.length("match") >= LEAST_CHARS) & F.col("match").rlike("[0-9]"))
    return added.join(good, "match")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row.

    spans: ``kind:start:end`` of base and added spans by start, then kind. Null and empty texts have none, and the digest of an
    empty string. Repeated rows are judged each for itself; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), "text")
    rows = with_words(rows, "text").drop("text").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "spans")  # fixes the row numbers
    words = rows.where(F.size("words") > 0).select("row", F.inline("words"))
    found = discover(words).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = rows.join(found, "row", "left").withColumn("added", F.coalesce("added", none))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    counts = [_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select(
        "doc_id", *counts, F.sha2(say(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        say(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_found"),
    )


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
