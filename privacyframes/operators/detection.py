"""Findings as tables: long form, summaries, and hits produced outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import SPACE
from ..functions.detect import EXTERNAL_HITS, LATE_HITS, candidates, entity_counts, findings, resolution


def _long(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    # inline_outer + not-null test: a plain inline makes the optimizer add size(found) > 0 below the
    # projection, which would run detection twice.
    wide = df.select(*keys, found.alias("found"))
    return wide.select(*keys, F.inline_outer("found")).filter(F.col("entity_type").isNotNull())


def findings_table(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """One row per kept finding: keys, start, end, entity_type, score, value, source. Narrow."""
    return _long(df, keys, findings(text, **options))


def candidates_table(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """One row per valid hit before overlap resolution. Narrow."""
    return _long(df, keys, candidates(text, **options))


def resolution_table(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """One row per hit that is no repetition of another, and once more if it is kept: keys, ``kept``, and the hit. One detection, narrow."""
    wide = df.select(*keys, resolution(text, **options).alias("r"))
    names = ("start", "end", "entity_type", "score", "value", "source")

    def flagged(part: str, kept: bool) -> Column:
        return F.transform(F.col("r")[part], lambda x: F.struct(F.lit(kept).alias("kept"), *(x[c].alias(c) for c in names)))

    return wide.select(*keys, F.inline_outer(F.concat(flagged("unique", False), flagged("kept", True)))).filter(F.col("entity_type").isNotNull())


def with_summary(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """Keys plus ``summary`` (entity -> count, empty when clean) and ``pii_count``. Narrow: one chunk per row."""
    wide = df.select(*keys, findings(text, **options).alias("found"))
    return wide.select(*keys, entity_counts("found").alias("summary"), F.size("found").cast("long").alias("pii_count"))


def chunk_entity_counts(chunks: DataFrame, doc_key: str, text: str = "text", **options) -> DataFrame:
    """``(doc, entity_type, n)`` where a document has many chunks.

    Each chunk is reduced to a few counts before the shuffle, so a document holding a third of all chunks
    sends partial sums, not findings.
    """
    per_chunk = chunks.select(doc_key, entity_counts(findings(text, **options)).alias("summary"))
    long = per_chunk.select(doc_key, F.explode_outer("summary").alias("entity_type", "n"))
    return long.filter(F.col("entity_type").isNotNull()).groupBy(doc_key, "entity_type").agg(F.sum("n").alias("n"))


def document_summaries(documents: DataFrame, chunks: DataFrame, doc_key: str, text: str = "text", **options):
    """``(doc, summary, pii_count)`` for every document, empty map for the clean ones."""
    counts = chunk_entity_counts(chunks, doc_key, text, **options)
    # At most one entry per entity (a few dozen) and document.
    maps = counts.groupBy(doc_key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("summary"),
        F.sum("n").alias("pii_count"),
    )
    return documents.select(doc_key).join(maps, doc_key, "left").select(
        doc_key,
        F.coalesce("summary", F.create_map().cast("map<string,bigint>")).alias("summary"),
        F.coalesce("pii_count", F.lit(0)).cast("long").alias("pii_count"),
    )


def attach_hits(chunks: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``external_hits`` and ``late_hits`` arrays to each chunk, in the order of ``hit_no``.

    ``hits``: keys, hit_no, start, end, label, score, value, stage (1 = first stage, 2 = second stage).
    Hits are collected per chunk before the join, so only hit arrays and not single hits meet the texts.
    """
    item = F.struct("hit_no", "start", "end", "label", "score", "value")
    per_chunk = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("stage") == 1, item))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("stage") == 2, item))).alias("second"),
    )
    first = F.transform("first", lambda h: F.struct(h.start, h.end, h.label, h.score)).cast(EXTERNAL_HITS)
    second = F.transform("second", lambda h: F.struct(h.start, h.end, h.label, h.value)).cast(LATE_HITS)
    small = per_chunk.select(*keys, first.alias("external_hits"), second.alias("late_hits"))
    return chunks.join(small, keys, "left")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _whole_number(item: Column, field: str) -> Column:
    """A bound as Python's ``int`` reads it: numbers lose their fraction, strings must be whole numbers; else null."""
    value = F.try_variant_get(item, f"$.{field}", "variant")
    text = F.try_variant_get(item, f"$.{field}", "string")
    kind = F.schema_of_variant(value)
    digits = F.when(text.rlike(rf"^[{SPACE}]*[+-]?[0-9]+(_[0-9]+)*[{SPACE}]*$"), _strip(F.replace(text, F.lit("_"), F.lit("")))).try_cast("int")
    return (
        F.when(kind == "STRING", digits)
        .when(kind == "BOOLEAN", F.try_variant_get(item, f"$.{field}", "boolean").cast("int"))
        .otherwise(text.try_cast("double").try_cast("bigint").try_cast("int"))
    )


def _as_text(item: Column, field: str) -> Column:
    """A value as Python's ``str`` writes it (a JSON null is ``None``); null where the field is missing."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))
    return F.when(kind == "VOID", "None").otherwise(F.try_variant_get(item, f"$.{field}", "string"))


def parse_model_reply(reply: Column) -> Column:
    """Second-stage hits from a model's reply: code fence removed, a JSON list and nothing behind it, or no hits.

    An entry that is no object, or has no usable bounds or label, is skipped; the others stay.
    """
    trimmed = _strip(reply)
    fence = rf"(?is)```(?:json)?[{SPACE}]*(.*?)[{SPACE}]*```"
    body = F.when(trimmed.rlike(fence), _strip(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)
    # A list ends with its bracket, so text behind it shows at the end or breaks the parse of what is put around it.
    whole = F.when(body.startswith("[") & body.endswith("]"), F.try_parse_json(F.concat(F.lit('{"items":'), body, F.lit("}"))))
    items = F.coalesce(F.try_variant_get(whole, "$.items", "array<variant>"), F.array().cast("array<variant>"))
    typed = F.transform(
        items,
        lambda x: F.struct(
            _whole_number(x, "start").alias("start"),
            _whole_number(x, "end").alias("end"),
            _strip(_as_text(x, "entity_type")).alias("entity_type"),
            F.coalesce(_as_text(x, "value"), F.lit("")).alias("value"),
        ),
    )
    return F.filter(
        typed, lambda x: x.start.isNotNull() & x.end.isNotNull() & x.entity_type.isNotNull()
    ).cast(LATE_HITS)


def normalized_entity(label: Column) -> Column:
    """Entity of a recogniser label (labels without an entry stand for themselves)."""
    pairs = [F.lit(x) for kv in fixed.LABEL_ENTITY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)
