"""Documents made of chunks: pages, paragraphs, cells, decoded payloads, and page regions to black out.

Input tables hold what a file decoder produced; the text work and the re-assembly happen here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detect import FINDINGS
from ..functions.mask import sanitize_struct
from ..functions.text import SPACE


def strip_text(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"^[{SPACE}]+|[{SPACE}]+$"), F.lit(""))


def sanitize_chunks(chunks: DataFrame, mode: Column | str = "mask", text: str = "text", **options) -> DataFrame:
    """Each chunk on its own: adds ``sanitized`` and ``findings``. Narrow."""
    staged = chunks.withColumn("__s", sanitize_struct(text, mode, **options))
    return staged.select(
        *chunks.columns,
        F.col("__s.sanitized").alias("sanitized"),
        F.coalesce("__s.findings", F.array().cast(FINDINGS)).alias("findings"),
    )


def join_in_order(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str, alias: str) -> DataFrame:
    """Text pieces of one document joined in order. A group is one document, bounded by the file size limit."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["__t"]), separator).alias(alias))


def sanitize_paragraphs(chunks: DataFrame, mode: str = "mask", **options) -> DataFrame:
    """Paragraphs first, then table cells; non-empty pieces only, one per line; cells of a row by `` | ``.

    Input: doc_id, chunk_kind ('paragraph' or 'cell'), chunk_ord (paragraph number, or row number over all
    tables), col, text.
    """
    is_cell = F.col("chunk_kind") == "cell"
    clean = sanitize_chunks(chunks.filter(is_cell | (F.length("text") > 0)), mode, **options)
    rank = F.when(is_cell, 1).otherwise(0)
    lines = join_in_order(
        clean.withColumn("part", rank), ["doc_id", "part", "chunk_ord"], ["col"], "sanitized", " | ", "line"
    )
    return join_in_order(lines, ["doc_id"], ["part", "chunk_ord"], "line", "\n", "sanitized_text")


def sanitize_sheets(cells: DataFrame, mode: str = "mask", **options) -> DataFrame:
    """Spreadsheet preview: sheet heading, then non-blank rows with cells joined by `` | ``.

    Input: doc_id, sheet_no, sheet, row, col, value, is_string. Only string cells are sanitized.
    """
    text = F.when(F.col("is_string"), F.col("value"))
    clean = sanitize_chunks(cells.withColumn("text", text), mode, **options)
    shown = F.coalesce(F.when(F.col("is_string"), F.col("sanitized")).otherwise(F.col("value")), F.lit(""))
    shown_cells = clean.withColumn("shown", shown)
    keys = ["doc_id", "sheet_no", "sheet", "row"]
    pieces = F.array_sort(F.collect_list(F.struct("col", "shown")))
    rows = shown_cells.groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["shown"]), " | ").alias("line"),
        F.max(F.length("shown")).alias("widest"),
    )
    heads = cells.select("doc_id", "sheet_no", "sheet").distinct()
    lines = (
        rows.filter(F.col("widest") > 0)
        .select("doc_id", "sheet_no", F.col("row").cast("long").alias("row"), "line")
        .unionByName(
            heads.select(
                "doc_id", "sheet_no", F.lit(-1).cast("long").alias("row"), F.concat(F.lit("[Sheet: "), "sheet", F.lit("]")).alias("line")
            )
        )
    )
    return join_in_order(lines, ["doc_id"], ["sheet_no", "row"], "line", "\n", "sanitized_text")


def sanitize_payloads(payloads: DataFrame, mode: Column | str = "mask", **options) -> DataFrame:
    """Decoded code payloads (QR and the like) that hold personal data, prefixed by their number.

    Input: doc_id, page, payload_no (1-based among all payloads of the page), text. Findings get source 'qr'.
    """
    trimmed = payloads.withColumn("text", strip_text(F.col("text")))
    clean = sanitize_chunks(trimmed, mode, **options)
    marked = F.transform("findings", lambda f: f.withField("source", F.lit("qr")))
    return (
        clean.withColumn("has_pii", F.size("findings") > 0)
        .withColumn("block", F.format_string("[QR_%d] %s", F.col("payload_no").cast("int"), "sanitized"))
        .withColumn("findings", marked)
        # A filter on the array itself would be pushed below detection and run it twice.
        .select("*", F.explode_outer(F.when(F.col("has_pii"), F.array(F.lit(True)))).alias("keep"))
        .filter("keep")
        .drop("has_pii", "keep", "sanitized")
    )


def sanitize_pages(pages: DataFrame, payloads: DataFrame | None = None, mode: str = "redact", **options) -> DataFrame:
    """``(doc_id, sanitized_text, pii_count)``: stripped page texts, each followed by its payload blocks,
    pages separated by a blank line.

    Input: doc_id, page, text; payloads as in :func:`sanitize_payloads`.
    """
    trimmed = pages.withColumn("text", strip_text(F.col("text")))
    done = sanitize_chunks(trimmed, mode, **options).select(
        "doc_id", "page", "sanitized", F.size("findings").alias("n")
    )
    if payloads is not None:
        blocks = sanitize_payloads(payloads, mode, **options)
        per_page = blocks.groupBy("doc_id", "page").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("payload_no", "block"))), lambda b: b["block"]), "\n"
            ).alias("blocks"),
            F.sum(F.size("findings")).alias("payload_n"),
        )
        text = (
            F.when(F.col("blocks").isNull(), F.col("sanitized"))
            .when(F.col("sanitized") == "", F.col("blocks"))
            .otherwise(F.concat("sanitized", F.lit("\n"), "blocks"))
        )
        done = done.join(per_page, ["doc_id", "page"], "left").select(
            "doc_id", "page", text.alias("sanitized"), (F.col("n") + F.coalesce("payload_n", F.lit(0))).alias("n")
        )
    pieces = F.array_sort(F.collect_list(F.struct("page", "sanitized")))
    return done.groupBy("doc_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["sanitized"]), "\n\n").alias("sanitized_text"),
        F.sum("n").cast("long").alias("pii_count"),
    )


def segments_to_hide(segments: DataFrame, page_findings: DataFrame, keys: list[str]) -> DataFrame:
    """Text segments touched by any finding of their page.

    ``page_findings``: keys and ``findings``, which are disjoint and in order. So the last finding that starts before a segment's end
    decides: one pass over the segments and findings of a page in order, nothing is compared pair by pair.
    """
    spans = page_findings.select(*keys, F.explode("findings").alias("f")).select(
        *keys, F.col("f.start").alias("pos"), F.lit(1).alias("kind"), F.col("f.end").alias("reach"),
        F.lit(None).cast(segments.select(F.struct(*segments.columns).alias("s")).schema["s"].dataType).alias("segment"),
    )
    placed = segments.select(
        *keys, F.col("end").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast(spans.schema["reach"].dataType).alias("reach"),
        F.struct(*segments.columns).alias("segment"),
    )
    before = Window.partitionBy(*keys).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.unionByName(spans).withColumn("reach", F.last("reach", ignorenulls=True).over(before))
    return met.filter((F.col("kind") == 0) & (F.col("reach") > F.col("segment.start"))).select("segment.*")


def scale_boxes(boxes: DataFrame, x_scale: Column, y_scale: Column) -> DataFrame:
    """Adds x0, y0, x1, y1 in page units; a box is at least one unit wide and high before scaling."""
    return boxes.withColumns(
        {
            "x0": F.col("left") * x_scale,
            "y0": F.col("top") * y_scale,
            "x1": (F.col("left") + F.greatest(F.lit(1), F.col("width"))) * x_scale,
            "y1": (F.col("top") + F.greatest(F.lit(1), F.col("height"))) * y_scale,
        }
    )


def page_scale(page_size: Column, pixels: Column) -> Column:
    return page_size / F.greatest(F.lit(1), pixels)


def values_to_hide(page_findings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-empty finding values of each page, first seen first."""
    values = F.array_distinct(F.filter(F.transform("findings", lambda f: f["value"]), lambda v: v != ""))
    return page_findings.select(*keys, values.alias("hide_values"))


def text_segments(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a page laid out as one blank-separated text: adds ``start`` and ``end`` of each word.

    Input: keys, word_no, text and box columns. Empty words are dropped. A window is one page.
    """
    from pyspark.sql import Window

    trimmed = words.withColumn("text", strip_text(F.col("text"))).filter(F.length("text") > 0)
    before = Window.partitionBy(*keys).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return trimmed.withColumn("start", start).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
