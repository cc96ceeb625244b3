"""Ranked search against a plain scan of all documents."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trajspark.llm import bitslices

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for d, t in held:
            m = 75 + 25 * len(t) * n // total
            score = 0
            for x in terms(text):
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if no else d, -s) for k, (s, no, d) in enumerate(sorted(rows)[:best])]
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = [rng.choice(["Ab", "ça", "語", "x1", "q"]) * rng.randint(1, 3) + str(rng.randint(0, 40)) for _ in range(300)]
    return [" ".join(rng.choice(words[: rng.choice([5, 300])]) + rng.choice(["", ",", "-_", "\n"]) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("best, block", [(20, 512), (3, 7)])
def test_search(spark, monkeypatch, best, block):
    monkeypatch.setattr(bitslices, "BLOCK_DOCS", block)
    monkeypatch.setattr(bitslices, "FIRST", block // 2)
    monkeypatch.setattr(bitslices, "ITEMS", 4)
    docs = [*enumerate(texts(best, 150)), (500, None), (501, ""), (502, " -,"), (3, "again x1"), (None, "ab10 AB10"), (None, "ab10 AB10"), (503, "ab10 " * 5000)]
    docs += [docs[5], docs[5]]
    items = [*enumerate(texts(99, 10)), (50, None), (51, ""), (52, "nothing_here!"), (53, "AB10 ab10 q5"), (None, "x1 ab10"), (53, "AB10 ab10 q5")]
    table = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int").repartition(4)
    blocks = bitslices.index(table)
    got = bitslices.search(blocks, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int"), best)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, best)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert bitslices.search(bitslices.index(none), some).collect() == []
    assert bitslices.search(bitslices.index(some.withColumnRenamed("item_id", "doc_id")), none.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_signatures_overestimate():
    rows = pa.array(texts(7, 60))
    t = bitslices.Terms(rows)
    owner, term, count = t.counted()
    sizes = np.bincount(t.owner, minlength=t.n)
    m, packed = bitslices._signatures(owner, term, count, t.n)
    every = np.unique(term)
    items = bitslices.Items([0, 1], every, np.zeros(len(every), np.int64), np.arange(len(every)), np.ones(len(every), np.int64), t.n, int(sizes.sum()))
    begin = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=t.n))))
    exact = bitslices.exact(items, np.arange(t.n), sizes, begin, term, count)
    bound = bitslices.bounds(items, m, packed, sizes)
    assert (bound >= exact).all() and bound[0].sum() < 1.3 * exact[0].sum()
