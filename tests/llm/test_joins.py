"""Operators that join or sort across texts, against plain versions."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest

from trajspark.llm import components, jaccard, pii, warc

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def linked(rows):
    up = {d: d for d, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(rng.randint(0, 60))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([1, 3, 5, 20, 80]))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        rows.append((3 * k + 1, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 1500])
def test_jaccard(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = [*corpus(chunk, 150), (1000, None), (1001, ""), (1002, " \n"), (1003, "Up to DOWN"), (1004, "up to down"), (1005, "x " * 3000), (1006, "x " * 2000)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shingles string")
    assert sorted(map(tuple, jaccard.join(docs).collect())) == linked(rows)


def test_jaccard_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(None, same), (9, same), (4, same), (4, same), (7, other), (9, other), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jaccard.join(docs).collect(), key=str)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(2, 2), (4, 4), (4, 4), (7, 4), (9, 4), (9, 4)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(26, None)]
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == ["2", "4", "4", "None"]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(3)
    members = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64))
        for _ in range(rng.integers(1, 5)):
            keep = rng.random(len(base)) > rng.choice([0.0, 0.05, 0.2])
            members.append(base[keep] if keep.any() else base)
    forest = jaccard.Forest(len(members))
    list(jaccard.SignatureTree(members).links(forest))
    plain = jaccard.Forest(len(members))
    for i in range(len(members)):
        for j in range(i):
            both = len(np.intersect1d(members[i], members[j]))
            if 100 * both >= 75 * (len(members[i]) + len(members[j]) - both):
                plain.join(i, j)
    assert [forest.find(i) for i in range(len(members))] == [plain.find(i) for i in range(len(members))]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), *((k, k + 1) for k in range(10, 40)), (50, 50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {k: 10 for k in range(10, 41)}


def test_warc(spark):
    rows = [
        (0, "http://b.org/x", "same"), (1, "http://a.org/x?q=1", "same"), (2, None, None), (3, "http://a.org/x?q=1", ""), (4, "http://www.a.org/", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny\r\n\r\n"),
        (5, "http://a.org/\r\nX: y", "é" * 5000), (6, "http://a.org/x?q=1", "own"), (None, "http://n.org/", "null id"),
    ]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive(pages).collect()
    assert sorted(r.index_pos for r in got) == list(range(len(rows)))
    keys = [(r.url_key, r.stamp) for r in sorted(got, key=lambda r: r.index_pos)]
    assert keys == sorted(keys)
    first: dict = {}
    for page, _, html in rows:
        first.setdefault(html or "", page)
    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        raw = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html[r.page_id]] == r.page_id else ("revisit", first[html[r.page_id]]))
    assert warc.archive(pages.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warc.capture_index(_read(spark, pages, 5)).collect() if html[r.page_id] == "same")


def _read(spark, pages, least):
    path, run = warc.scratch(spark, "warc"), "test-run"
    warc.write_archives(pages, path, run, least)
    return warc.read_archives(spark, path, run)


def test_loser_tree():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 12))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if ok[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_personal_data(spark):
    texts = [
        None, "", "5 " * 3000 + "4111 1111 1111 1111 x", "é😀 a@b.c %x@y.z.com 1.2.3.4.5 +1 (234) 567-8901 4111-1111-1111-1111", "999.1.1.1 0255.1.1.1 a@b 00000000000000001.2.3.4",
        "1" * 20000, "a.b+c@d-e.f.g@h.i", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "ip 10.0.0.1, ip 10.0.0.256. card 5500005555555559 5500005555555558",
        *(f"my account ACC-{k:05d} and account me{k}@mail{k}.example.com here" for k in range(40)), "your account ZX9981-77 here", "chapter ZX9981-78 here",
    ]
    docs = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)] + [(3, texts[3], "e")], "doc_id long, text string, base string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] or ""
        want = base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("id:")] == want
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"write to user u{k}@mail{k}.example.com today" for k in range(30)] + ["tell user QX-77120 now", "see page QX-77121 now"]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[30] == "id:10:18" and got[31] == ""


def test_recall_on_planted_contexts(spark):
    """Unseen identifiers after a word, after two words and before a word, among texts in which numbers have nothing around them in common."""
    rng, texts, planted = random.Random(8), [], set()
    shape = ("contact {} please", "the number is {} .", "see {} mailbox")
    for k in range(300):
        noise = " ".join(f"w{rng.randint(0, 10**6)} {''.join(rng.choice('abcdefgh') for _ in range(6))}" for _ in range(10))
        if k % 3:
            seen = shape[k % 5 % 3].format(rng.choice([f"u{k}@mail{k}.example.com", f"10.0.{k % 250}.{k % 99}"]))
            texts.append(f"{noise} {seen} {noise}")
        elif k % 2:
            texts.append(f"{noise} {shape[k % 7 % 3].format(f'QX-{77000 + k}')} {noise}")
            planted.add(k)
        else:
            texts.append(noise)
    got = {r.doc_id: r.n_found for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    caught = {k for k, n in got.items() if n}
    assert len(caught & planted) >= 0.9 * len(planted) and not caught - planted
    assert max(got.values()) == 1


def test_long_runs_cost_their_length(spark):
    texts = ["a" * 100_000 + " x@y.z.com", "1" * 100_000 + ".2.3 " + "." * 20_000, "a@" + "b" * 50_000 + " c1 d", "+1" + " " * 50_000 + "x1" + "!" * 20_000]
    start = time.monotonic()
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "email:100001:100010", 1: "", 2: "", 3: ""} and time.monotonic() - start < 60
