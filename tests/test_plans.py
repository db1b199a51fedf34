import re

import pytest
from pyspark.sql import functions as F

from privacyframes.operators.detection import findings_table, with_summary
from privacyframes.operators.files import sanitize_files
from privacyframes.operators.risk import top_files
from privacyframes.operators.sanitization import sanitize_columns, sanitize_documents, sanitize_nested, token_map
from privacyframes.plans import inputs


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def narrow(df):
    text = plan(df)
    assert "Exchange" not in text and "Python" not in text and "Pandas" not in text, text[:3000]
    return text


def detections(text):
    """How often the plan runs the person-name pattern's extraction."""
    return len(re.findall(r"regexp_extract_all\([^()]*text[^()]*, [^,]*\[A-Z\]\[a-z\]\{1,24\}", text))


@pytest.mark.parametrize("mode", ["mask", "redact", "tokenize"])
def test_sanitizing_is_one_narrow_stage(spark, sf, mode):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = narrow(sanitize_documents(docs, ["doc_id"], mode=mode))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_tables_are_narrow(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    narrow(findings_table(docs, ["doc_id"]))
    narrow(with_summary(docs, ["doc_id"]))
    narrow(token_map(docs, ["doc_id"]))
    narrow(sanitize_columns(docs.select("doc_id", "text", "lang")))
    narrow(sanitize_nested(docs.select("doc_id", F.struct("text", F.array("lang").alias("l")).alias("s"))))
    files = docs.select("doc_id", F.lit("a.txt").alias("filename"), F.lit("mask").alias("sanitization_mode"), F.col("text").cast("binary").alias("content"))
    narrow(sanitize_files(files, ["doc_id"]))


def test_detection_runs_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (findings_table(docs, ["doc_id"]), sanitize_documents(docs, ["doc_id"])):
        optimized = df._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("face_tmp_[a-zA-Z0-9]") == 2  # one extraction and one split


def test_top_files_needs_no_full_sort(spark, sf):
    files = with_summary(inputs.files(spark, sf), ["id", "filename", "uploaded_by", "upload_time"])
    text = plan(top_files(files.withColumnRenamed("id", "file_id")))
    assert "TakeOrderedAndProject" in text


def test_key_filter_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(findings_table(docs, ["doc_id"]).filter("doc_id > 900"))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,900)]" in text
