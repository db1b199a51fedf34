"""Bounded samples of labelled rows, and what trained models share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str | Column) -> Column:
    """One row in five is kept for measuring."""
    return F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column) % 5 == 0


def bounded(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` different rows: those with the smallest hashes of ``columns``, the same on every run and however they are partitioned.

    Name the id and the text, so that neither rows with one id nor rows without an id stand or fall together; rows that are equal in
    both are one. Only hashes are compared: first those under a bound that about twice as many rows pass, and all of them where
    repeated rows leave too few there.
    """
    kept = rows.withColumn("__hash", F.xxhash64(*columns, F.lit(7)))
    n = kept.count()

    def limit(hashes):
        return hashes.select("__hash").distinct().orderBy("__hash").limit(most).agg(F.count("*"), F.max("__hash")).first()

    found, highest = 0, None
    if n > 4 * most:
        found, highest = limit(kept.filter(F.col("__hash") < -(1 << 63) + int(2 * most / n * (1 << 64))))
    if found < most:
        found, highest = limit(kept)
    return kept.filter(F.col("__hash") <= F.lit(highest if found else 0)).dropDuplicates(["__hash"]).drop("__hash")


def slices(texts: list[str | None], most: int = 1 << 19):
    """Ranges of rows with about ``most`` characters together; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def sliced(batch: pa.RecordBatch, text_column: str, most: int):
    """Parts of a batch with about ``most`` characters of text together; a longer text is alone."""
    first, size = 0, 0
    for i, length in enumerate(pc.utf8_length(batch.column(text_column)).fill_null(0).to_pylist()):
        size += length + 1
        if size >= most:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)
