"""Training-data pipeline: language, near-duplicates, benchmark passages, secrets, tokens. Each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privacyframes.llm.blocks import Shelf
from privacyframes.llm.bpe import bpe_encode, public_vocabulary
from privacyframes.llm.decontaminate import decontaminate
from privacyframes.llm.language_id import UNKNOWN, predict, train
from privacyframes.llm.near_dedup import BROADCAST, near_dedup
from privacyframes.llm.sampling import held_out
from privacyframes.llm.secrets import in_order, redact, secret_scan
from privacyframes.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; ``lang`` becomes the predicted one. Null texts and texts without a letter go."""
    labels, logs = train(docs.filter(~held_out("doc_id")), "doc_id", "text", "lang")
    found = predict(docs.select(COLUMNS), labels, logs).filter(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near-duplicates (five-word shingles, 0.8).

    Rows with one id and different texts stay or go on their own. Of rows with the same id and text one stays: an anti-join on what goes
    would keep copies. Rows without an id are all kept."""
    docs = docs.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    shelf = Shelf(spark, "pipeline-near-dedup")
    marks = shelf.put(near_dedup(docs, words=5, row_key="text_key").select("doc_id", "text_key", "kept")).filter("doc_id is not null")
    # Decisions and repeats are worked out on ids and keys; texts move only where more rows go than can be broadcast.
    gone = _few(shelf.put(marks.filter("not kept").select("doc_id", "text_key").distinct()))
    repeated = _few(shelf.put(marks.groupBy("doc_id", "text_key").count().filter("count > 1").drop("count")))
    same = [F.col("d.doc_id") == F.col("k.doc_id"), F.col("d.text_key").eqNullSafe(F.col("k.text_key"))]
    named = docs.filter("doc_id is not null").alias("d").join(gone.alias("k"), same, "left_anti").alias("d")
    once = named.join(repeated.alias("k"), same, "left_anti")
    more = named.join(repeated.alias("k"), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return once.select(COLUMNS).union(more.select(COLUMNS)).union(docs.filter("doc_id is null").select(COLUMNS))


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts hold none; every row is judged on its own, with an id or without."""
    found = decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks") == 0).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; ``n_chars`` follows where it was given. No document is dropped."""
    found = secret_scan(docs.select(COLUMNS))
    clean = redact(F.col("text"), in_order("assign", "access", "hex", "markov"))
    changed = found.withColumn("text", clean)
    return changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and whether they decode to them: one row per row. Null and empty texts have no ids."""
    lines, pattern = public_vocabulary()
    found = bpe_encode(docs, lines, pattern, extra=["lang", "source"], decoded=False)
    return found.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "round_trip")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secret_scan", secrets),
    ("byte_bpe", tokens),
]

#: SQL can express neither the trained stages nor the verified similarity.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
