"""Vector codes against plain k-means of integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from trajspark.llm import ballcodes


def plain(rows, parts, entries, rounds):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept or len(kept[0][1]) % parts:
        return []
    size = len(kept[0][1])
    width = size // parts
    kept = [r for r in kept if len(r[1]) == size]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(held[k]) for x in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, bytes(k for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str)


def vectors(seed, n, size):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(size)] for _ in range(5)]
    rows = [(k * 3, [round(c + rng.gauss(0, 0.5), rng.choice([0, 3])) for c in rng.choice(centres)], rng.choice([None, 1, 1, 1, 2])) for k in range(n)]
    return rows + rows[2:5] + [(rows[0][0], rows[4][1], 9)]


@pytest.mark.parametrize("seed, n, size, parts, entries, rounds", [(1, 200, 8, 4, 16, 2), (2, 90, 12, 4, 64, 3), (3, 300, 4, 2, 5, 2), (4, 5, 16, 16, 64, 2)])
def test_codes(spark, monkeypatch, seed, n, size, parts, entries, rounds):
    monkeypatch.setattr(ballcodes, "BLOCK", 32)
    rows = vectors(seed, n, size)
    rows += [(1, None, 1), (4, [], 1), (7, [None] * size, 1), (10, [math.nan] * size, 1), (13, [math.inf] * size, 1), (16, [1.0], 1), (None, [2.5] * size, 3), (19, [1e30] * size, 1)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, v int").repartition(3)
    got, books = ballcodes.encode(table.select("vec_id", "embedding", "label", "v"), parts, entries, rounds)
    narrow = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got.collect()), key=str) == plain(narrow, parts, entries, rounds)
    assert len(books) == parts


def test_no_rows(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        assert ballcodes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))[0].collect() == []


def test_rings_leave_out_no_entry():
    rng = np.random.default_rng(0)
    for _ in range(60):
        x = rng.integers(-9, 9, (200, 3))
        book = ballcodes.Ball(x[rng.integers(0, 200, 12)], np.zeros(12, bool))
        code, error = book.assign(x, rng.integers(0, 12, 200), False)
        d = ((x[:, None] - book.entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
        moved = book.entries.copy()
        moved[rng.integers(0, 12, 3)] += rng.integers(-2, 3, (3, 3))
        later = ballcodes.Ball(moved, (moved == book.entries).all(1))
        d = ((x[:, None] - moved[None]) ** 2).sum(2)
        again, error = later.assign(x, code, True)
        assert (again == d.argmin(1)).all() and (error == d.min(1)).all()


def test_query(spark, sf_dir):
    from trajspark.llm.queries import QUERIES

    rows = QUERIES["op12_ball_codes"](spark, sf_dir).collect()
    labels = {}
    for r in rows:
        assert len(r["code"]) == 32 and r["label_error"] >= r["error"]
        labels.setdefault(r["codebooks_sha256"], 0)
    assert len(labels) == 1 and len(rows) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len(hashlib.sha256().hexdigest()) == len(next(iter(labels)))
