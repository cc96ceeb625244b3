"""Quality rules by suffix-array repetition: how much of a text is said twice.

Each text is an array of words. Sorting its suffixes puts equal beginnings next to each other; the longest common prefix
of neighbours gives, at every word, the longest run from there that occurs elsewhere in the same text. These runs are the
maximal repeated substrings; their spans are united and the covered part and the longest run are held to limits.

Texts never leave the task that reads them: no shuffle, and memory follows one chunk of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import text as tx
from trajspark.llm.storage import query

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long"
)


def suffix_order(words: np.ndarray, owner: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The suffixes in order, by text first: sorted by their first 1, 2, 4, ... words until no two suffixes tie.

    words: an integer per word; last: one past the last word of the word's text. Only tied suffixes are sorted again, and only
    the ranks of the last round are kept.
    """
    n = len(words)
    order = np.lexsort((words, owner))
    head = np.ones(n, bool)
    head[1:] = (words[order[1:]] != words[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    reach = 1
    tied = order[~(head & np.append(head[1:], True))]
    while len(tied):
        there = tied + reach
        inside = there < last[tied]
        follow = np.where(inside, rank[np.where(inside, there, 0)] + 1, 0)
        group = rank[tied]
        by = np.lexsort((follow, group))
        tied, follow, group = tied[by], follow[by], group[by]
        new_group = np.ones(len(tied), bool)
        new_group[1:] = group[1:] != group[:-1]
        head = new_group.copy()
        head[1:] |= follow[1:] != follow[:-1]
        place = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        rank[tied] = group + np.maximum.accumulate(np.where(head, place, 0)) - start
        reach *= 2
        tied = tied[~(head & np.append(head[1:], True))]
    order[rank] = np.arange(n)
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, owner: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that the same text also has from another word.

    Where a suffix and the one before it in order are each one word on from the suffix at the word before and its predecessor,
    their common prefix is one word shorter. All others are counted word by word; together they have at most 2 n log n words, so
    time stays low in texts that repeat themselves, and memory is a few integers per word.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    other = np.full(n, -1)
    other[order[1:]] = order[:-1]
    other[(owner[other] != owner) | (words[other] != words)] = -1
    some = other >= 0
    follows = np.zeros(n, bool)
    follows[1:] = some[1:] & some[:-1] & (other[1:] == other[:-1] + 1)
    first = np.flatnonzero(some & ~follows)
    x, y = first, other[first]
    length, most = np.ones(len(first), np.int64), last[x] - np.maximum(x, y)
    alive = np.flatnonzero(most > 1)
    while len(alive):
        at = length[alive, None] + np.arange(max(1, min(4096, 65536 // len(alive))))
        inside = at < most[alive, None]
        differ = ~inside | (words[np.where(inside, x[alive, None] + at, 0)] != words[np.where(inside, y[alive, None] + at, 0)])
        stop = differ.any(axis=1)
        length[alive] += np.where(stop, differ.argmax(axis=1), at.shape[1])
        alive = alive[~stop]
    prefix = np.zeros(n, np.int64)
    place = np.flatnonzero(some)
    if len(place):
        head = np.searchsorted(first, place, "right") - 1
        prefix[place] = length[head] - (place - first[head])
        np.maximum.at(longest, place, prefix[place])
        np.maximum.at(longest, other[place], prefix[place])
    return longest


def covered(longest: np.ndarray, least: int, owner: np.ndarray, n: int) -> np.ndarray:
    """Words of each text in the union of its repeated runs of at least ``least`` words."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=n)


def repeated_lines(texts: tx.Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, by text."""
    first = texts.first()
    size = len(texts.bytes)
    if size == 0:
        return np.zeros(texts.n, np.int64)
    breaks = texts.bytes == 10
    start = np.flatnonzero(first[:size] | np.concatenate(([False], breaks[:-1])))
    end = np.append(start[1:], size)
    end = end - (breaks[end - 1])  # without the line break itself
    dark = np.concatenate(([0], np.cumsum(~tx.WHITE[texts.bytes])))
    keep = dark[end] > dark[start]
    start, end = start[keep], end[keep]
    owner = np.searchsorted(texts.offsets, start, "right") - 1
    key = tx.mixed(texts.keys(start, end) + owner.astype(np.uint64) * np.uint64(tx.BASE))
    _, unique = np.unique(key, return_index=True)
    return np.bincount(owner, minlength=texts.n) - np.bincount(owner[unique], minlength=texts.n)


def measures(column: pa.Array, least: int) -> list[np.ndarray]:
    w = tx.Words(column)
    dark = ~tx.WHITE[w.bytes]
    chars = w.per_text(dark & ((w.bytes & 0xC0) != 0x80))
    longest = np.zeros(len(w.owner), np.int64)
    if len(w.owner):
        _, ids = np.unique(w.word_keys(), return_inverse=True)
        last = w.begin[1:][w.owner]
        longest = common_prefixes(ids, suffix_order(ids, w.owner, last), w.owner, last)
    top = np.zeros(w.n, np.int64)
    np.maximum.at(top, w.owner, longest)
    return [
        w.counts, chars, w.per_text(SYMBOLS[w.bytes]), repeated_lines(w),
        covered(longest, 3, w.owner, w.n), covered(longest, least, w.owner, w.n), top,
    ]


def repetition(docs: DataFrame, least: int = 10, text: str = "text") -> DataFrame:
    """The given columns, and the seven measures of the text. A measure replaces a column of the same name.

    least: words of the shortest repeat that counts as covered. Null and empty texts: all measures 0.
    Repeated rows are measured each for itself.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, text):
            got = [pa.array(m.astype(np.int64)) for m in measures(part[text], least)]
            yield pa.RecordBatch.from_arrays([*part.columns, *got], [*part.schema.names, *names])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*columns, SCHEMA]))


def verdicts(docs: DataFrame, least: int = 10, max_covered: int = 30, max_longest: int = 150) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the measures.

    kept: not base_failed, at most ``max_covered`` per cent of the words in repeats of ``least`` words or more, and no
    repeat of over ``max_longest`` words.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (100 * F.col("n_covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return repetition(docs, least).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns (also those named like a measure)."""
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    return verdicts(own).where("kept").select(*[F.col("row").getField(c).alias(c) for c in names])


W = r"[^\x20\x09-\x0D]+"


def _windows(k: int) -> str:
    return f"SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM d, unnest(range(1, n_words - {k - 2})) AS u(i) WHERE n_words >= {k}"


def _covered(k: int) -> str:
    return (
        f"SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest(range(i, i + {k})) AS j FROM (SELECT doc_id, i, count(*) OVER "
        f"(PARTITION BY doc_id, s) AS n FROM ({_windows(k)})) WHERE n > 1) GROUP BY doc_id"
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS n_words FROM documents),
l AS (SELECT doc_id, sum(c - 1) AS c FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{W}') GROUP BY doc_id, line) GROUP BY doc_id),
r3 AS ({_covered(3)}), r10 AS ({_covered(10)}),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, s) AS n FROM ({_windows(151)})) WHERE n > 1),
m AS (SELECT d.doc_id, n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(coalesce(l.c, 0) AS BIGINT) AS n_dup_lines, coalesce(r3.c, 0) AS n_repeat_words, coalesce(r10.c, 0) AS n_covered_words, long.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r10 USING (doc_id) LEFT JOIN long USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT base_failed AND 100 * n_covered_words <= 30 * n_words AND NOT too_long AS kept FROM v
"""


@query("op5_repetition", ORACLE)
def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "base_failed", "kept"
    )
