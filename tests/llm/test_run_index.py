"""Removal of repeated byte strings against a plain count of all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from trajspark.llm import runindex

N = runindex.LENGTH


def plain(rows):
    raw = [(d, (t or "").encode()) for d, t in rows]
    times = {}
    for _, b in raw:
        for i in range(len(b) - N + 1):
            times[b[i : i + N]] = times.get(b[i : i + N], 0) + 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - N + 1):
            if times[b[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len([1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    chars = "ab cdé語\n"
    make = lambda k: "".join(rng.choice(chars) for _ in range(k))
    passages = [make(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(6)]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice([rng.choice(passages), make(rng.randint(0, 300)), rng.choice(passages)[: rng.randint(100, 700)]]) for _ in range(rng.randint(0, 4))))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(5)
    got = runindex.remove_repeats(docs).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str)


@pytest.mark.parametrize("hot", [runindex.HOT, 3])
def test_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(runindex, "HOT", hot)
    rows = list(enumerate(texts(hot, 60)))
    rows += [(100, None), (101, ""), (102, "x" * 199), (103, "x" * 200), (104, "y" * 200), (105, "y" * 201), (106, "z" * 3000), (107, "pq" * 900)]
    rows += [(None, "q" * 100 + "r" * 200), (None, "q" * 90 + "r" * 200), rows[3], rows[3], (3, "other"), (200, "w" * 120 + "v" * 80), (201, "w" * 120 + "v" * 80)]
    assert found(spark, rows) == plain(rows)


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(runindex, "LARGE", 700)
    rng = random.Random(5)
    part = "".join(rng.choice("abcd") for _ in range(450))
    long = "".join("".join(rng.choice("efgh") for _ in range(rng.randint(1, 500))) + part[rng.randint(0, 250) :] for _ in range(12))
    rows = [(1, long), (2, long[300:2000]), (3, part)]
    assert found(spark, rows) == plain(rows)


def test_strings_twice_in_one_piece(spark):
    rng = random.Random(8)
    make = lambda k: "".join(rng.choice("ABCDEFGH") for _ in range(k))
    rows = [(1, "k" * 300), (2, "=-" * 101), (3, make(250) + "#" * 201 + make(250)), (4, "m" * 200), (5, make(400))]
    rows += [(10 + p, make(90) + (make(p) * 99)[: 200 + p + extra] + make(30)) for p, extra in ((3, -1), (7, 0), (47, 5), (49, 0), (150, 0), (154, 1), (199, 0), (255, 40))]
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_statistics_of_the_index():
    rng = random.Random(1)
    for trial in range(150):
        bodies = sorted({bytes(rng.choice(b"ab\0" if trial % 2 else range(256)) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))})
        index = runindex.RunIndex(bodies)
        for k, body in enumerate(bodies):
            for i in range(len(body)):
                longest = max(
                    (next((n for n in range(min(len(body) - i, len(o) - j)) if body[i + n] != o[j + n]), min(len(body) - i, len(o) - j)) for m, o in enumerate(bodies) for j in range(len(o)) if (m, j) != (k, i)),
                    default=0,
                )
                assert index.statistics[index.begin[k] + i] == longest
    same = runindex.RunIndex([b"abcd" * 40 + bytes([k]) for k in range(200)])
    assert same.runs < 6_000


def test_pieces_cover_every_start_once():
    rng = np.random.default_rng(3)
    for text in ["a" * 1000, "".join(map(chr, rng.integers(97, 100, 1500)))]:
        t = pa.array([text, "b" * 150, text[:230]])
        seen = []
        for data, offsets, _, _ in runindex.stretches(t):
            a, b, _ = runindex.pieces(data, offsets)
            seen += [i for x, y in zip(a, b, strict=True) for i in range(x, y)]
        n = len(text)
        assert seen == [*range(n - N + 1), *range(n + 150, n + 150 + 31)]
