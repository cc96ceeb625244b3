"""Operators that work text by text, against plain versions."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trajspark.llm import mixing, quality, repetition, tiling, tokens, toxicity, urlrules
from trajspark.llm import text as tx

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g " * 40), (5, "one two"), (6, "é ß 漢字 x\r\ny"), (7, "x " * 5000), (7, "x " * 5000), (None, "no id")]
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows, more="source string"):
    full = [(*r, "s") for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, {more}")


def repeated(words, k):
    seen, hit = {}, set()
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in range(i, i + k)}
    return len(hit)


def test_repetition(spark):
    rng = random.Random(5)
    rows = list(ODD)
    for k in range(60):
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))]
        rows.append((100 + k, "".join(w + rng.choice([" ", "\n", "  "]) for w in words)))
    got = repetition.verdicts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = WORD.findall(r.text or "")
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert (r.n_repeat_words, r.n_covered_words) == (repeated(words, 3), repeated(words, 10))
        longest = max([k for k in range(1, len(words)) if repeated(words, k)] or [0]) if len(words) < 200 else r.longest_repeat
        assert r.longest_repeat == longest
    assert repetition.verdicts(frame(spark, rows).limit(0)).count() == 0


def test_repetition_keeps_columns(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(80)), 5), (2, "short", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert [tuple(r) for r in repetition.keep_good(docs).collect()] == [rows[0]]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 10**9), (1000, 1000), (5000, 10**6)):
        values = np.sort(rng.integers(0, top, n))
        ef = tokens.EliasFano.encode(values, top)
        assert (ef.values() == values).all()
        assert all(ef.select(i) == values[i] for i in range(0, n, 17))
        some = rng.integers(0, n, 50)
        assert (ef.select(some) == values[some]).all() and len(ef.select(np.arange(0))) == 0
        assert (len(ef.low) + len(ef.high)) * 8 <= n * (3 + max(0, np.log2(top / n))) + 16
    with pytest.raises(IndexError):
        ef.select(n)


def test_tokens(spark):
    plain = Tokenizer.from_file(tokens.vocabulary())
    rows = [*ODD[:-1], (8, "It's a b.\nThe c, d  e \n f*** <|endoftext|> x.y"), (9, "tab\there. éa, ß.\n漢字 z "), (10, "q\0r s\x1c t"), (-4, "first")]
    got = sorted(map(tuple, tokens.token_output(frame(spark, rows), tokens.vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert tokens.token_output(frame(spark, [(None, "x")]), tokens.vocabulary()).first().doc_id is None
    assert tokens.token_output(frame(spark, rows).limit(0), tokens.vocabulary()).count() == 0


def test_chosen_documents(spark, tmp_path, monkeypatch):
    plain = Tokenizer.from_file(tokens.vocabulary())
    rows = [(k, f"text {k} " * k if k % 7 else None) for k in range(40)] + [(3, "again")]
    monkeypatch.setattr(tokens, "BLOCK", 50)
    tokens.write_blocks(frame(spark, rows), tokens.vocabulary(), str(tmp_path / "t"))
    got = sorted((r.doc_id, r.ids) for r in tokens.read_ids(spark, str(tmp_path / "t"), [0, 3, 39, 14, 99, None]).collect())
    assert got == sorted((d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows if d in (0, 3, 39, 14))
    assert tokens.read_ids(spark, str(tmp_path / "t"), []).count() == 0


def test_encoder_on_odd_texts(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "IDS", 3000)  # the table is emptied many times
    encoder, plain = tokens.Encoder(tokens.vocabulary(), 2), Tokenizer.from_file(tokens.vocabulary())
    parts = [" ", "  ", "\n", "\t", "a", "B", "ab", "'s", "'", "é", "\u00a0", "\u3000", "\u2003", "\u2014", "漢", "カ", "<|endoftext|>", "<|", "|>", "endoftext", "1", "23",
             ".", ",", "-", "_", "\r", "\x1c", "\x85", "\0", "🙂", "\u200b", "\u1680", " x", "x" * 80]
    rng = random.Random(6)
    for _ in range(10):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1000)] + [None]
        ids, n = encoder.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [plain.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_that_a_polynomial_confuses(spark):
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    words = tx.Words(pa.array([f"{one} {two}"]))
    assert words.hashes(words.start, words.end)[0] == words.hashes(words.start, words.end)[1]
    assert words.word_keys()[0] != words.word_keys()[1]
    row = repetition.repetition(frame(spark, [(1, f"{one}\n{two}")])).first()
    assert (row.n_dup_lines, row.longest_repeat) == (0, 0)


def test_long_repeats():
    words = np.tile(np.random.default_rng(3).integers(0, 1000, 50_000), 2)
    one, ends = np.zeros(len(words), int), np.full(len(words), len(words))
    longest = repetition.common_prefixes(words, repetition.suffix_order(words, one, ends), one, ends)
    assert longest.max() == longest[0] == longest[50_000] == 50_000 and longest[1] == 49_999


def longest_first(a, b, least):
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least or not k:
            return total
        total += k
        free_a[i : i + k], free_b[j : j + k] = [False] * k, [False] * k


def test_tiles():
    rng = random.Random(2)
    for _ in range(2000):
        kinds = rng.choice([2, 3, 5, 9])
        a = [rng.randint(1, kinds) for _ in range(rng.randint(1, 26))]
        b = [rng.randint(1, kinds) for _ in range(rng.randint(1, 30))]
        cut = rng.randint(0, len(a))
        b[3:3] = a[cut:] + a[:cut]
        least = min(3, len(a))
        found = tiling.tiles(np.array(a, np.uint64), np.array(b, np.uint64), least)
        assert sum(t[2] for t in found) == longest_first(a, b, least)
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in found)


def test_tiles_of_repetitive_texts():
    start = time.process_time()
    for period in (1, 7):
        a, b = np.arange(600, dtype=np.uint64) % period + 1, np.arange(42_000, dtype=np.uint64) % period + 1
        assert tiling.tiles(a, b, 4) == [(0, 0, 600)]
    assert time.process_time() - start < 20


def test_decontamination(spark):
    item = [f"q{i}" for i in range(40)]
    noise = [f"n{i}" for i in range(60)]
    docs = frame(spark, [
        (1, " ".join(noise + item + noise)), (2, " ".join(item[20:] + noise + item[:20]).upper()), (3, " ".join(noise)), (4, " ".join(noise + item[:10])),
        (5, "tiny"), (6, None), (7, ""), (8, " ".join(w for x in item for w in (x, "z"))), (2, "again"),
    ])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny"), (5, "one two")], "item_id long, text string")
    pairs = {(r.doc_id, r.item_id, r.covered_words) for r in tiling.contaminated(docs, bench).collect()}
    assert pairs == {(1, 1, 40), (2, 1, 40), (5, 4, 1)}
    assert sorted(r.doc_id for r in tiling.keep_clean(docs, bench).collect()) == [2, 3, 4, 6, 7, 8]
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 and tiling.keep_clean(docs, bench.limit(0)).count() == 9
    assert tiling.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"b{k}w{i}" for i in range(12))) for k in range(30)], "item_id long, text string")
    docs = frame(spark, [(k, f"x y {' '.join(f'b{k}w{i}' for i in range(12))} z") for k in range(0, 60, 2)])
    monkeypatch.setattr(tiling.blocks, "__defaults__", (200,))
    assert sorted(r.doc_id for r in tiling.contaminated(docs, bench).collect()) == list(range(0, 30, 2))
    assert sorted(r.doc_id for r in tiling.keep_clean(docs, bench).collect()) == list(range(30, 60, 2))


def test_url_rules(spark):
    urls = [
        "http://WWW.Example.ORG/es/1", "http://example.org/en/12?x=/es/", "http://notexample.org/es/", "http://a.b.com/fr/x", "http://a.b.com/de/", "http://org", "http://org/",
        "http://x.net/fr/", None, "", "no scheme", "http://", "http://.example.org/es/", "ftp://example.org#/es/", "http://example.org:80/es/", "a://b://c.org/", "http://x.com/fr/", "http://x.com/fr/",
    ]
    rules = [*urlrules.RULES, ("example.org", "/es/", "block"), ("", "/", "block"), (None, None, "block"), ("x.com", None, "block")]
    pages = spark.createDataFrame([(k if k != 3 else None, u, "extra") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = []
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [((r[0] or "") + (r[1] or ""), r[2]) for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1] or "")]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        want.append((str(k if k != 3 else None), host, path, str(best[0]), best[1]))
    assert got == sorted(want)
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, None if k % 50 == 0 else "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(900)]
    rows += [(5, "w w", "e"), (5, "w w", "e"), (None, "w", "f"), (7000, "", "g")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.schedule(docs, ["doc_id", "source", "size"]).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        above = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        full |= above
    taken: dict = {}
    for r in got:
        s = r.doc.source
        assert r.target == pytest.approx(2 * sizes[s] if s in full else weight[s] * level)
        assert r.source_size == sizes[s] and 0 <= r.copies <= 2
        taken[s] = taken.get(s, 0) + r.size * r.copies
        goal = r.target
        assert goal >= 0
    for s in order:
        goal = 2 * sizes[s] if s in full else weight[s] * level
        assert abs(taken[s] - goal) <= 30
    again = mixing.schedule(docs.repartition(7), ["doc_id", "source", "size"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == sum(r.copies for r in got) and mixing.mix(docs.limit(0)).count() == 0


def test_classifiers_on_held_out_rows(spark, sf_dir):
    large = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    good = [(r.predicted, labels[r.doc_id].quality) for r in quality.op4_quality(spark, large).where("held_out").collect() if r.doc_id in labels]
    assert sum(a == b for a, b in good) >= 0.95 * len(good)
    bad = [(r.predicted, labels[r.doc_id].toxic, r.score) for r in toxicity.op10_toxicity(spark, large).where("held_out").collect() if r.doc_id in labels]
    assert sum(a == b for a, b, _ in bad) >= 0.9 * len(bad)


def test_classifiers_on_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ODD, "score string")
    for module in (quality, toxicity):
        for known in (labels, labels.limit(0)):
            got = module.score(docs, module.fit(docs, known)).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_offending_sentences():
    texts = pa.array([f"all is well here number {k}. " * 5 + ("you are scum indeed. " if k % 4 == 0 else "fine day. ") + "the end" for k in range(400)])
    model = toxicity.train(texts, np.array([int(k % 4 == 0) for k in range(400)]))
    w = toxicity.tx.Words(pa.array(["Good morning. You are SCUM, indeed. Bye"]))
    sentence, rows = toxicity.sentences(w)
    z = model["bias"][0] + np.bincount(sentence, model["weight"][rows].sum(axis=1))
    assert z.argmax() == 1 and z[1] > 0 > z[0]


def test_encoder_stays_with_its_worker():
    from pyspark import cloudpickle

    first = tokens._encoder(tokens.vocabulary(), 2)
    first.encode(pa.array(["the same words in two tasks"]))

    def task():
        return tokens._encoder(tokens.vocabulary(), 2)

    assert cloudpickle.loads(cloudpickle.dumps(task))() is first and first.n_ids > 0
