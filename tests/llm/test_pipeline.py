"""The pipeline's stages on the smallest tables and on edge rows."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf_small, edge):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").unionByName(edge.drop("score").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small).persist()
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not ids["language_id"] & {1_000_004, 1_000_005, 1_000_006, 1_000_013}
    assert 1_000_001 in ids["near_dedup"] and 1_000_002 not in ids["near_dedup"]
    assert ids["secret_scan"] == ids["decontamination"] == ids["byte_bpe"]
    assert seen["byte_bpe"].filter(~F.col("round_trip")).count() == 0
    assert seen["secret_scan"].filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0


def test_run(spark, sf_small):
    assert corpus_pipeline.run(spark, sf_small).count() > 0


def test_near_duplicates_of_rows_with_one_id_or_none(spark, sf_small):
    copied = "one copy of a text that more than a single row holds, and it is long enough to have shingles"
    other = "nothing like it stands in any of the rows around this one, which is why it has to stay here"
    rows = [(1, copied), (2, copied + " too"), (2, other), (2, other), (2, None), (None, copied), (None, copied), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_small)
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, copied), (2, other), (2, None), (None, copied), (None, copied), (None, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_run_on_no_documents(spark, sf_small, tmp_path):
    for name in ("documents", "benchmark"):
        rows = spark.read.parquet(f"{sf_small}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "round_trip"] and got.count() == 0
