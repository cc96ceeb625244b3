"""The stages together against plain versions of each decision."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from trajspark.llm import jaccard, mixing, repetition, tiling, tokens
from trajspark.llm.storage import QUERIES, written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf_dir), "stage"))
    assert all(k.columns == columns for k in kept[1:-1])
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[1] == sorted(r.doc_id for r in repetition.verdicts(docs).where("kept").collect())
    assert ids[2] == sorted(r.doc_id for r in jaccard.join(kept[1]).where("component_id = doc_id").collect())
    hit = {r.doc_id for r in tiling.contaminated(kept[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids[3] == [d for d in ids[2] if d not in hit] and hit
    copies = {r.doc.doc_id: r.copies for r in mixing.schedule(kept[3], ["doc_id"]).collect()}
    assert ids[4] == sorted(d for d, n in copies.items() for _ in range(n))
    plain, start, want = Tokenizer.from_file(tokens.vocabulary()), 0, []
    for r in sorted(kept[4].collect(), key=lambda r: r.doc_id):
        row = [*plain.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(row), zlib.crc32(np.array(row, "<u4").tobytes())))
        start += len(row)
    assert sorted(map(tuple, kept[5].collect())) == sorted(want)


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import trajspark.llm.queries  # noqa: F401

    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
