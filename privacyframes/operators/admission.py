"""Which incoming files are accepted, with which mode, and why the others are not."""

from __future__ import annotations

import binascii

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import SPACE

VERDICTS = ["clean", "malicious", "unknown"]


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot; names made of leading dots only have none."""
    base = F.regexp_extract(F.lower(filename), r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1)


def looks_like_text(content: Column) -> Column:
    """Empty, valid UTF-8, or at least 90 % printable within the first 4096 bytes."""
    sample = F.substring(content, 1, fixed.TEXT_SNIFF_BYTES)
    latin = F.decode(sample, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\x20-\x7e\t\n\r]", ""))
    return (
        (F.octet_length(sample) == 0)
        | F.is_valid_utf8(sample.cast("string"))
        | (printable / F.octet_length(sample) >= 0.9)
    )


def media_type(content_type: Column) -> Column:
    head = F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)
    return F.lower(F.regexp_replace(head, F.lit(rf"^[{SPACE}]+|[{SPACE}]+$"), F.lit("")))


def is_supported(filename: Column, content_type: Column, content: Column) -> Column:
    kind = media_type(content_type)
    return (
        extension(filename).isin(*fixed.SUPPORTED_EXTENSIONS)
        | kind.startswith("text/")
        | kind.isin(*fixed.STRUCTURED_MIME_TYPES)
        | looks_like_text(content)
    )


def is_executable(content: Column) -> Column:
    out = F.lit(False)
    for magic in fixed.EXECUTABLE_MAGIC:
        out = out | (F.substring(content, 1, len(magic)) == F.unhex(F.lit(magic.hex())))
    return out


def has_test_virus(content: Column) -> Column:
    marker = binascii.hexlify(fixed.EICAR_MARKER.encode()).decode()
    return F.call_function("contains", content, F.unhex(F.lit(marker)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def verdict(malicious: Column, suspicious: Column, harmless: Column) -> Column:
    """Verdict from engine counts."""

    def some(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) > 0

    return F.when(some(malicious) | some(suspicious), "malicious").when(some(harmless), "clean").otherwise("unknown")


def resolve_reputation(incoming: DataFrame, known_files: DataFrame, provider: DataFrame) -> DataFrame:
    """Add ``scan_status``, ``scan_source`` and ``scan_payload`` by content hash.

    The newest earlier file record with a status decides (if that status is a known one); otherwise the
    provider's counts; otherwise unknown, with source none. Both lookups are reduced to one row per hash before they join.

    known_files: id, file_sha256, malware_scan_status, malware_scan_payload if stored. provider: sha256, malicious, suspicious,
    harmless; its payload is the counts as JSON.
    """
    payload = "malware_scan_payload"
    stored = F.coalesce(payload, F.lit("{}")) if payload in known_files.columns else F.lit("{}")
    latest = (
        known_files.filter(F.col("malware_scan_status").isNotNull())
        .groupBy(F.col("file_sha256").alias("content_sha256"))
        .agg(F.max_by("malware_scan_status", "id").alias("cached"), F.max_by(stored, "id").alias("cached_payload"))
        .filter(F.col("cached").isin(*VERDICTS))
    )
    counts = provider.groupBy(F.col("sha256").alias("content_sha256")).agg(
        *[F.max(c).alias(c) for c in ("malicious", "suspicious", "harmless")]
    )
    listed = counts.select(
        "content_sha256",
        verdict(F.col("malicious"), F.col("suspicious"), F.col("harmless")).alias("asked"),
        F.to_json(F.struct("malicious", "suspicious", "harmless")).alias("asked_payload"),
    )
    return (
        incoming.join(latest, "content_sha256", "left")
        .join(listed, "content_sha256", "left")
        .withColumn("scan_status", F.coalesce("cached", "asked", F.lit("unknown")))
        .withColumn("scan_source", F.when(F.col("cached").isNotNull(), "cache").when(F.col("asked").isNotNull(), "provider").otherwise("none"))
        .withColumn("scan_payload", F.coalesce("cached_payload", "asked_payload", F.lit("{}")))
        .drop("cached", "asked", "cached_payload", "asked_payload")
    )


def admission_status(
    filename: Column,
    content_type: Column,
    content: Column,
    scan_status: Column,
    block_unknown: bool = False,
    max_bytes: int = fixed.MAX_FILE_BYTES,
) -> Column:
    """First failing rule, or ACCEPT."""
    blocked = scan_status == "malicious"
    if block_unknown:
        blocked = blocked | (scan_status == "unknown")
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), "EMPTY")
        .when(size > max_bytes, "TOO_LARGE")
        .when(~is_supported(filename, content_type, content), "UNSUPPORTED")
        .when(is_executable(content), "EXECUTABLE")
        .when(has_test_virus(content), "MALWARE_TEST_SIGNATURE")
        .when(blocked & (scan_status == "malicious"), "MALWARE")
        .when(blocked, "MALWARE_UNKNOWN")
        .otherwise("ACCEPT")
    )


def admit(
    incoming: DataFrame,
    known_files: DataFrame,
    provider: DataFrame,
    block_unknown: bool = False,
    max_bytes: int = fixed.MAX_FILE_BYTES,
) -> DataFrame:
    """Decide on each file and drop the content: only hash, size and decision go through the lookups.

    incoming: path (or any key), filename, content_type, content. A file that is too large is not hashed (its hash stays null).
    """
    # The content-based part is decided before the joins, so file bodies are never shuffled.
    hashed = F.when(F.octet_length("content") <= max_bytes, content_hash(F.col("content")))
    local = incoming.withColumn("content_sha256", hashed).withColumn(
        "local_status",
        admission_status(
            F.col("filename"), F.col("content_type"), F.col("content"), F.lit("clean"), False, max_bytes
        ),
    )
    slim = local.withColumn("n_bytes", F.octet_length("content")).drop("content")
    looked_up = resolve_reputation(slim, known_files, provider)
    bad = F.when(F.col("scan_status") == "malicious", "MALWARE")
    if block_unknown:
        bad = bad.when(F.col("scan_status") == "unknown", "MALWARE_UNKNOWN")
    status = F.when(F.col("local_status") != "ACCEPT", F.col("local_status")).otherwise(F.coalesce(bad, F.lit("ACCEPT")))
    return looked_up.withColumn("admission_status", status).drop("local_status")


def admit_files(
    files: DataFrame,
    known_files: DataFrame,
    provider: DataFrame,
    block_unknown: bool = False,
    max_bytes: int = fixed.MAX_FILE_BYTES,
) -> DataFrame:
    """The same for files that are not read yet: ``n_bytes`` comes from the listing and decides first, so no body of an empty or too
    large file is ever read.

    files: as ``read_files`` gives them, with a content_type. The two filters on the size reach the file source, and the plan for what
    they reject has no content.
    """
    size = F.coalesce("n_bytes", F.lit(0))
    rejected = files.filter((size == 0) | (size > max_bytes)).drop("content")
    fits = files.filter((F.col("n_bytes") > 0) & (F.col("n_bytes") <= max_bytes))
    read = admit(fits, known_files, provider, block_unknown, max_bytes)
    none = {"content_sha256": F.lit(None).cast("string"), "scan_status": F.lit("unknown"), "scan_source": F.lit("none"), "scan_payload": F.lit("{}")}
    unread = rejected.withColumns(none | {"admission_status": F.when(size == 0, "EMPTY").otherwise("TOO_LARGE")})
    return read.unionByName(unread.select(read.columns))


def block_events(admitted: DataFrame) -> DataFrame:
    """Audit events of blocked malware (other rejections leave no audit record)."""
    status = F.col("admission_status")
    source = F.when(status == "MALWARE_TEST_SIGNATURE", F.lit("local_eicar_signature")).otherwise(F.col("scan_source"))
    details = F.concat(
        F.lit("Blocked upload filename='"), "filename", F.lit("' sha256="), "content_sha256", F.lit(" source="), source
    )
    return admitted.filter(status.startswith("MALWARE")).select(
        "filename", F.lit("MALWARE_BLOCK").alias("action"), details.alias("details")
    )


def effective_mode(filename: Column, requested: Column) -> Column:
    """Image and PDF files are always redacted; otherwise the requested mode, or masking."""
    forced = extension(filename).isin(*fixed.REDACT_ONLY_EXTENSIONS)
    return F.when(forced, "redact").otherwise(F.coalesce(F.nullif(requested, F.lit("")), F.lit("mask")))


def retention_deadline(upload_time: Column, days: int = fixed.RETENTION_DAYS) -> Column:
    return upload_time + F.make_interval(days=F.lit(days))
