"""Sanitizing whole DataFrames: text columns, tables, nested records, token maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detect import FINDINGS, entity_counts
from ..functions.mask import check_mode, sanitize_cells, sanitize_struct


def sanitize_documents(
    df: DataFrame, keys: list[str], text: str = "text", mode: Column | str = "mask", **options
) -> DataFrame:
    """Keys plus sanitized_text, findings, summary, pii_count, tokens. One narrow stage, batch or stream."""
    wide = df.select(*keys, sanitize_struct(text, mode, **options).alias("s"))
    return wide.select(
        *keys,
        F.col("s.sanitized").alias("sanitized_text"),
        F.col("s.findings").alias("findings"),
        entity_counts(F.coalesce("s.findings", F.array().cast(FINDINGS))).alias("summary"),
        F.coalesce(F.size("s.findings"), F.lit(0)).cast("long").alias("pii_count"),
        F.col("s.tokens").alias("tokens"),
    )


def token_map(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """``(keys, token, entity_type, original_value)``: the vault that makes tokens reversible."""
    wide = df.select(*keys, F.sort_array(sanitize_struct(text, "tokenize", **options)["tokens"]).alias("tokens"))
    # Sorted by token, so repeats are neighbours; this stays near-linear for long documents.
    once = F.filter("tokens", lambda t, i: (i == 0) | (F.get("tokens", i - 1)["token"] != t["token"]))
    return wide.select(*keys, F.inline_outer(once)).filter(F.col("token").isNotNull())


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def sanitize_columns(
    df: DataFrame, mode: str = "mask", columns: list[str] | None = None, with_summary: bool = False, **options
) -> DataFrame:
    """Every string column (or the named ones) sanitized cell by cell; other columns untouched.

    All cells of a row go through one expression, so the plan does not grow with the number of columns.
    ``with_summary`` adds the row's ``summary`` and ``pii_count``.
    """
    check_mode(mode)
    names = string_columns(df) if columns is None else columns
    if not names:
        return df
    cells = F.array(*[F.col(f"`{n}`") for n in names])
    staged = df.withColumn("__cells", sanitize_cells(cells, mode, **options))
    place = {n: i for i, n in enumerate(names)}
    out = [
        F.col("__cells")[place[n]]["sanitized"].alias(n) if n in place else F.col(f"`{n}`") for n in df.columns
    ]
    if with_summary:
        nothing = F.array().cast(FINDINGS)
        found = F.flatten(F.transform("__cells", lambda c: F.coalesce(c["findings"], nothing)))
        out += [entity_counts(found).alias("summary"), F.size(found).cast("long").alias("pii_count")]
    return staged.select(*out)


def _map_strings(value: Column, dtype: T.DataType, leaf) -> Column:
    """Rebuild a nested value with ``leaf`` applied to every string; map keys stay."""
    if isinstance(dtype, T.StringType):
        return leaf(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _map_strings(x, dtype.elementType, leaf))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda k, v: _map_strings(v, dtype.valueType, leaf))
    if isinstance(dtype, T.StructType):
        fields = [_map_strings(value[f.name], f.dataType, leaf).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _leaves(value: Column, dtype: T.DataType) -> Column | None:
    """Array of all leaf findings of a value whose strings were replaced by sanitize structs."""
    nothing = F.array().cast(FINDINGS)
    if isinstance(dtype, T.StringType):
        return F.coalesce(value["findings"], nothing)
    if isinstance(dtype, T.ArrayType):
        if not _has_string(dtype.elementType):
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x: _leaves(x, dtype.elementType))), nothing)
    if isinstance(dtype, T.MapType):
        if not _has_string(dtype.valueType):
            return None
        return F.coalesce(
            F.flatten(F.transform(F.map_values(value), lambda x: _leaves(x, dtype.valueType))), nothing
        )
    if isinstance(dtype, T.StructType):
        parts = [p for f in dtype.fields if (p := _leaves(value[f.name], f.dataType)) is not None]
        return F.concat(*[F.coalesce(p, nothing) for p in parts]) if parts else None
    return None


def _has_string(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_string(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_string(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_string(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType)


def sanitize_nested(df: DataFrame, mode: str = "mask", columns: list[str] | None = None, **options) -> DataFrame:
    """Strings at any depth of arrays, maps and structs sanitized; adds ``summary`` and ``pii_count``.

    Strings are first replaced by their sanitize structs, then both results are read off that one value.
    """
    check_mode(mode)
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in (columns or fields) if _has_string(fields[n])]
    if not names:
        return df.withColumn("summary", entity_counts(F.array().cast(FINDINGS))).withColumn("pii_count", F.lit(0).cast("long"))
    staged = df.select(
        *[
            _map_strings(F.col(f"`{n}`"), fields[n], lambda v: sanitize_struct(v, mode, **options)).alias(n)
            if n in names
            else F.col(f"`{n}`")
            for n in df.columns
        ]
    )

    def unwrap(value: Column, dtype: T.DataType) -> Column:
        return _map_strings(value, dtype, lambda v: v["sanitized"])

    found = F.concat(*[F.coalesce(_leaves(F.col(f"`{n}`"), fields[n]), F.array().cast(FINDINGS)) for n in names])
    return staged.select(
        *[unwrap(F.col(f"`{n}`"), fields[n]).alias(n) if n in names else F.col(f"`{n}`") for n in df.columns],
        entity_counts(found).alias("summary"),
        F.size(found).cast("long").alias("pii_count"),
    )
