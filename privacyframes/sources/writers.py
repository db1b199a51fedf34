"""Sinks: sanitized data in its own format, audit exports, and backups."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.governance import iso_timestamp, missing_originals
from .readers import read_files

AUDIT_COLUMNS = ["id", "user_id", "action", "details", "timestamp", "prev_hash", "log_hash"]


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """Minimal quoting, ``\\n`` line ends, blanks kept."""
    df.write.csv(
        path,
        header=header,
        lineSep="\n",
        quote='"',
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(df: DataFrame, path: str, rows_per_part: int = 0) -> None:
    """One record per line; non-ASCII text as it is. With ``rows_per_part`` no part holds more records."""
    df.write.option("maxRecordsPerFile", rows_per_part).json(path, ignoreNullFields=False)


def write_text(df: DataFrame, path: str, text: str = "sanitized_text") -> None:
    df.select(F.col(text).alias("value")).write.text(path, lineSep="\n")


def write_documents(df: DataFrame, path: str, keys: list[str], text: str = "sanitized_text") -> None:
    """One text per document with its keys, line ends and all: a JSON record per line, so documents never run into each other."""
    write_json(df.select(*keys, text), path)


def write_text_files(df: DataFrame, path: str, key: str, text: str = "value") -> None:
    """A text file for each ``key`` (an integer; its path has ``key=<number>``), its texts as lines of it. ``df`` is dealt out by ``key``.

    On a file system of the machines each task has a folder of its own and writes its files itself: Hadoop's local file system starts three
    processes for a file in a folder of its own (20 to 30 ms), and the folders are listed one by one. Elsewhere Spark writes a folder for each key.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)
        return
    base = target.toUri().getPath()

    def write(batches):
        folder = f"{base}/{TaskContext.get().partitionId():06d}"
        os.makedirs(folder, exist_ok=True)
        # A task that runs again, or twice, puts the same files in their places; what it leaves unfinished has another ending.
        name = started = None
        for batch in batches:
            for k, line in zip(batch["key"].to_pylist(), batch["line"], strict=True):
                if name != k:
                    if started:
                        started.close()
                        os.replace(started.name, f"{folder}/{key}={name}.txt")
                    name, started = k, open(f"{folder}/{key}={k}.{uuid.uuid4().hex}", "wb")
                started.write(line.as_buffer() or b"")
                started.write(b"\n")
        if started:
            started.close()
            os.replace(started.name, f"{folder}/{key}={name}.txt")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    os.makedirs(base, exist_ok=True)
    lines = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("line")).sortWithinPartitions("key")
    lines.mapInArrow(write, "n long").count()


def write_results(results: DataFrame, path: str, month_of: str | None = None) -> None:
    """Stored sanitized results, partitioned by month when a time column is named (search and dashboards
    then read only the months they need). Rebalancing first gives few files per month and splits big months."""
    if month_of:
        results = results.withColumn("upload_month", F.date_format(month_of, "yyyy-MM"))
        results.hint("rebalance", "upload_month").write.partitionBy("upload_month").parquet(path)
    else:
        results.write.parquet(path)


def audit_export_rows(logs: DataFrame) -> DataFrame:
    """Export columns with ISO times, newest first (a range-partitioned sort)."""
    ordered = logs.orderBy(F.desc("timestamp"), F.desc("id"))
    return ordered.select(*AUDIT_COLUMNS).withColumn("timestamp", iso_timestamp(F.col("timestamp")))


def export_audit_logs(logs: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the log as csv, jsonl or json, in parts whose names follow the order.

    csv and json: the parts, read one after the other, form one file - with one header, and as one array; no task ever holds it whole.
    """
    rows = audit_export_rows(logs)
    if fmt == "jsonl":
        write_json(rows, path)
        return
    if fmt not in ("csv", "json"):
        raise ValueError("format must be csv, json or jsonl")
    place = F.struct("timestamp", "id")
    ends = logs.agg(F.max(place).alias("newest"), F.min(place).alias("oldest")).first()
    newest, oldest = (None, None) if ends.newest is None else (ends.newest["id"], ends.oldest["id"])
    first, last = F.col("id") == newest, F.col("id") == oldest
    if fmt == "csv":
        shown = [F.coalesce(c, F.lit("")).alias(c) if c == "prev_hash" else F.col(c) for c in AUDIT_COLUMNS]
        kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "", "escape": '"'}
        line = F.concat(F.when(first, ",".join(AUDIT_COLUMNS) + "\n").otherwise(""), F.to_csv(F.struct(*shown), kept))
    else:
        item = F.to_json(F.struct(*AUDIT_COLUMNS), {"ignoreNullFields": "false"})
        line = F.concat(F.when(first, "[").otherwise(","), item, F.when(last, "]").otherwise(""))
    rows.select(line.alias("value")).write.text(path)


def backup(
    users: DataFrame, files: DataFrame, audit_logs: DataFrame, originals: DataFrame, path: str, rows_per_part: int = 100_000
) -> dict[str, DataFrame]:
    """Snapshot of the three tables as JSON lines under ``path`` and a manifest of what was written.

    ``originals``: storage listing (path, n_bytes). Password hashes are never exported. Every table is computed once: rows are counted as
    they are written, and what else is needed is read back from the parts, none of which has more than ``rows_per_part`` records.
    Returns ``counts`` (item, value), ``manifest`` (table, n_rows, n_parts, n_bytes, sha256 of the hashes of its parts in the order of
    their names), ``parts`` (table, part, n_bytes, sha256) and ``missing`` (paths without an original).
    """
    spark = files.sparkSession
    tables = {"users": users.drop("password_hash"), "files": files, "audit_logs": audit_logs}
    written = {}
    for name, df in tables.items():
        seen = Observation(f"backup-{uuid.uuid4().hex}")
        write_json(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/{name}", rows_per_part)
        written[name] = seen.get["n"]
    listed = read_files(spark, path, "part-*")
    parts = listed.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("table"),
        F.col("filename").alias("part"),
        "n_bytes",
        F.sha2("content", 256).alias("sha256"),
    )
    rows = spark.createDataFrame(list(written.items()), "table string, n_rows long")
    # A table has as many parts as it has rows_per_part of records and tasks: their hashes are 64 characters each.
    of_table = parts.groupBy("table").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("part", "sha256"))).alias("p"))
    sums = of_table.select("table", "n_parts", "n_bytes", F.sha2(F.array_join("p.sha256", ""), 256).alias("sha256"))
    manifest = rows.join(sums, "table", "left").na.fill(0, ["n_parts", "n_bytes"])
    snapshot = spark.read.schema(files.schema).json(f"{path}/files").select("original_path")
    missing = missing_originals(snapshot, originals).select("original_path")
    present = originals.join(snapshot.select(F.col("original_path").alias("path")).distinct(), "path", "left_semi")
    counts = rows.select(F.col("table").alias("item"), F.col("n_rows").alias("value"))
    found = present.agg(F.count(F.lit(1)).alias("original_files_included"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("original_total_bytes"))
    more = [found.unpivot([], ["original_files_included", "original_total_bytes"], "item", "value"), missing.agg(F.count(F.lit(1)).alias("value")).select(F.lit("missing_original_files").alias("item"), "value")]
    for one in more:
        counts = counts.unionByName(one)
    return {"counts": counts, "manifest": manifest, "parts": parts, "missing": missing}
