"""Sanitizing raw files of mixed formats, each back into its own format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.detect import FINDINGS, entity_counts
from ..functions.mask import sanitize_csv, sanitize_json, sanitize_struct
from ..functions.text import utf8_text
from .admission import effective_mode, extension, looks_like_text

PLAIN = [".txt", ".sql"]
# Formats whose text a decoder must supply first (pages, cells, paragraphs): see chunks.py.
DECODED = [e for e in fixed.SUPPORTED_EXTENSIONS if e not in (*PLAIN, ".csv", ".json")]


def file_kind(filename, content):
    """How a file is read: plain, json, csv, decoded (needs a decoder), generic text, or unsupported."""
    ext = extension(filename)
    return (
        F.when(ext.isin(*PLAIN), F.substring(ext, F.lit(2), F.length(ext)))
        .when(ext == ".json", "json")
        .when(ext == ".csv", "csv")
        .when(ext.isin(*DECODED), "decoded")
        .when(looks_like_text(content), "generic_text")
        .otherwise("unsupported")
    )


def sanitize_files(files: DataFrame, keys: list[str], **options) -> DataFrame:
    """Keys plus parser, mode, sanitized_text, findings, summary, pii_count, error. One narrow stage.

    files: keys, filename, sanitization_mode, content. Broken JSON, formats that need a decoder and unknown
    binary files get ``error`` instead of text, so one bad file never stops a job.
    """
    kind = file_kind(F.col("filename"), F.col("content"))
    mode = effective_mode(F.col("filename"), F.col("sanitization_mode"))
    staged = files.select(
        *keys, kind.alias("parser"), mode.alias("mode"), utf8_text(F.col("content")).alias("text")
    )
    bad_json = (F.col("parser") == "json") & F.try_parse_json("text").isNull()
    bad_mode = ~F.col("mode").isin(*fixed.MODES)
    error = (
        F.when(F.col("parser").isin("decoded", "unsupported"), F.concat(F.lit("Unsupported file type: "), "parser"))
        .when(bad_mode, F.concat(F.lit("Invalid mode: "), "mode"))
        .when(bad_json, F.lit("Invalid JSON"))
    )
    checked = staged.withColumn("error", error)
    usable = F.col("error").isNull()
    is_plain = F.col("parser").isin("txt", "sql", "generic_text")
    # CSV and JSON are sanitized cell by cell, value by value; the mode picks one of three expressions.
    plain = sanitize_struct(F.when(usable & is_plain, F.col("text")), F.when(usable, F.col("mode")).otherwise("mask"), **options)
    out = F.when(is_plain, F.struct(plain["sanitized"].alias("sanitized"), plain["findings"].alias("findings")))
    for name in fixed.MODES:
        here = usable & (F.col("mode") == name)
        out = out.when(here & (F.col("parser") == "json"), sanitize_json("text", name, **options))
        out = out.when(here & (F.col("parser") == "csv"), sanitize_csv("text", name, **options))
    done = checked.withColumn("s", out)
    found = F.coalesce("s.findings", F.array().cast(FINDINGS))
    return done.select(
        *keys,
        "parser",
        "mode",
        F.col("s.sanitized").alias("sanitized_text"),
        found.alias("findings"),
        entity_counts(found).alias("summary"),
        F.size(found).cast("long").alias("pii_count"),
        "error",
    )
