"""Cleaned episodes as CSV documents, and the hash of their bytes."""

import csv
import hashlib
import io

from pyspark.sql import functions as F
from test_queries import test_query_matches_sql as matches_sql

from trajspark.functions.layout import Layout
from trajspark.operators import repair, sinks


def test_documents_and_hashes_match_sql(spark, sf_dir):
    matches_sql(spark, sf_dir, "repair_csv")


def test_the_hash_is_that_of_the_written_bytes(spark, tmp_path):
    rows = [(e, i, i * 0.1, None if i == 2 else i * 1e-5, text) for e in ("a", 'b,"', "ü") for i, text in enumerate(["reach", 'a "b", c', None, "x\ny", "1e-05"])]
    steps = spark.createDataFrame(rows, "episode_id string, seq bigint, timestamp double, ee_x double, phase string")
    for name, layout in (("whole", Layout()), ("chunked", Layout(chunk_rows=2))):
        done = repair.repair_steps(steps, layout=layout)
        path = str(tmp_path / name)
        sinks.write_episode_csv(done, path)
        written = b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*")))
        texts = [b"\xef\xbb\xbf" + x for x in written.split(b"\xef\xbb\xbf")[1:]]
        found = {r.sha256: (r.episode_id, r.n_bytes) for r in sinks.episode_csv_sha256(done).collect()}
        assert set(found) == {hashlib.sha256(x).hexdigest() for x in texts} and len(texts) == 3
        for text in texts:
            lines = list(csv.DictReader(io.StringIO(text.decode("utf-8-sig"), newline="")))
            assert found[hashlib.sha256(text).hexdigest()] == (lines[0]["episode_id"], len(text))
            assert [x["source_row"] for x in lines] == list("01234") and lines[1]["ee_x"] == "1e-05" and lines[2]["ee_x__original"] == "" and lines[3]["phase"] == "x\ny"
        shown = [c for c, kind in done.cleaned.dtypes if kind != "string"]
        back = sinks.read_episode_csv(done, path)
        assert back.select("episode_id", *shown).exceptAll(done.cleaned.select("episode_id", *shown)).isEmpty() and back.count() == 15
        assert back.filter(F.col("phase") == 'a "b", c').count() == 3
