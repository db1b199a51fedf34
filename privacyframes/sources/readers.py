"""Reading raw files into the tables the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mask import csv_rows
from ..functions.text import utf8_text


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, filename, modified, n_bytes, content`` of raw files. Selecting no content reads no content; Spark passes over empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("n_bytes"),
        "content",
    )


def read_text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as text; undecodable bytes are dropped."""
    return read_files(spark, path, glob).select("path", "filename", utf8_text(F.col("content")).alias("text"))


def read_csv_rows(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, row, cells`` of CSV files: every row with all its cells, the first line like any other. Empty lines have no cells.

    Quoted line breaks are kept. A file is one task's work, as admission bounds it (25 MB).
    """
    files = read_text_documents(spark, path, glob)
    return files.select("path", F.posexplode(csv_rows("text")).alias("row", "cells"))


def read_csv_cells(spark: SparkSession, path: str, glob: str | None = None, rows_per_task: int = 0) -> DataFrame:
    """CSV cells as columns ``_c0``, ``_c1``, ...: as many as the longest row has, null beyond the end of a shorter one.

    The width takes a pass over the files of its own, so no cell of a long row is lost. With ``rows_per_task`` the rows are dealt out to
    tasks of about that many, whatever the files hold: for costly work on the cells.
    """
    rows = read_csv_rows(spark, path, glob)
    seen = rows.agg(F.max(F.size("cells")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    cells = rows.select(*[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(seen["width"] or 0)])
    return cells.repartition(max(spark.sparkContext.defaultParallelism, -(-seen["n"] // rows_per_task))) if rows_per_task else cells


def read_json_records(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON with a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def plain_csv_line(df: DataFrame) -> Column:
    """Row rendered with plain commas and no quoting, as the raw preview shows it."""
    return F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])


def preview(text: Column, n: int = 5000) -> Column:
    return F.substring(text, 1, n)
