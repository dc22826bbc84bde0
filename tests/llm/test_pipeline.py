"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import pii

from .test_operators import prose


def corpus(spark, folder):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            for w in ("idiot", "moron", "scum"):
                words.insert(rng.randrange(60), w)
        if i % 10 == 1:
            words[5] = f"user{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s", 0) for i in range(1, 40)]
    rows += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = corpus(spark, str(tmp_path))
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i in range(400) if i % 4}
    assert clean <= ids[0] and len([i for i in ids[0] if i < 400 and i % 4 == 0]) <= 2
    assert clean <= ids[1] and not [i for i in ids[1] if 1000 <= i < 2000 and (i - 1000) in ids[0]] and len(ids[1] & {2000, 2001}) == 1
    assert ids[2] == ids[1]
    text = " ".join(r["text"] or "" for r in docs.collect())
    assert "user11@mail" not in text and "@" in text
    assert all(m.kind == "email" for m in pii.mentions(text))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids[2]


def test_run(spark, tmp_path):
    docs = corpus(spark, str(tmp_path))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    clean = {i for i in range(400) if i % 4}
    kept = {r["doc_id"] for r in packed.select("doc_id").collect()}
    assert clean <= kept <= {r["doc_id"] for r in docs.select("doc_id").collect()} and packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


CLASHING = "score double, text_hash long, special string, kinds string, id long, kept string, rank int, `__id` int, `__hash` int, component int, length int, salt int"


def odd_corpus(spark, folder, docs):
    rows = [(*r, 0.5, 1, "s", "k", 2, "x", 3, 4, 5, 6, 7, 8) for r in docs]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty, equal and very long texts, and columns of the names that the stages use themselves."""
    rng = random.Random(3)
    long_text, one, two = prose(rng, 40_000), prose(rng, 50), prose(rng, 50)
    rows = [(1, one), (1, two), (2, one), (2, one), (None, two + " x"), (None, prose(rng, 50)), (3, None), (4, ""), (None, None), (5, long_text), (6, long_text), (7, "mail me@corp.org")]
    odd_corpus(spark, str(tmp_path), [(i, t, "en", "s", len(t or "")) for i, t in rows])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["start"] == 0) == ["1", "1", "3", "5", "7", "None"]
    assert sum(r["length"] for r in packed if r["doc_id"] == 5) == next(r["doc_tokens"] for r in packed if r["doc_id"] == 5) > 40_000


def test_run_on_no_rows(spark, tmp_path):
    odd_corpus(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
