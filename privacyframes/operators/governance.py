"""Audit chain, retention, incremental sanitizing, access scopes, catalog and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .admission import effective_mode, extension
from ..streaming.machines import ChainLink
from .ordered import neighbours, run_in_order
from ..functions.mask import known_mode
from .sanitization import sanitize_documents

CHAIN_COLUMNS = ["id", "user_id", "action", "details", "timestamp", "prev_hash", "log_hash"]


def iso_timestamp(ts: Column) -> Column:
    """ISO text of a timestamp; the fraction only appears when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def audit_head(user_id: Column, action: Column, details: Column, ts: Column) -> Column:
    """Record text up to (not including) the previous hash."""
    none = F.lit("None")
    return F.concat_ws(
        "|",
        F.coalesce(user_id.cast("string"), none),
        F.coalesce(action, none),
        F.coalesce(details, none),
        iso_timestamp(ts),
        F.lit(""),
    )


def audit_digest(user_id: Column, action: Column, details: Column, ts: Column, prev_hash: Column) -> Column:
    return F.sha2(F.concat(audit_head(user_id, action, details, ts), F.coalesce(prev_hash, F.lit(""))), 256)


def audit_links(logs: DataFrame, chain: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """Add ``before`` (stored hash of the preceding record, null for the first) and ``seq`` (0-based place).

    A link only needs its neighbour. Records are split by (chain, range of ``width`` ids), so one long chain, or the single
    global one, is checked by many tasks; ids are unique, so a task's share is bounded. Make ``width`` larger where ids are sparse.
    """
    return neighbours(logs, list(chain or []), "id", "log_hash", width, CHAIN_COLUMNS)


def audit_check(logs: DataFrame, chain: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """Every record with ``ok``: it points to its predecessor's stored hash, and its own hash recomputes."""
    linked = audit_links(logs, chain, width)
    expected = audit_digest(*[F.col(c) for c in ("user_id", "action", "details", "timestamp", "before")])
    ok = F.col("prev_hash").eqNullSafe(F.col("before")) & F.col("log_hash").eqNullSafe(expected)
    return linked.withColumn("ok", ok)


def verify_chain(logs: DataFrame, chain: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """One row per chain: ok, verified_count, last_hash, or the first broken place and id."""
    keys = chain or []
    checked = audit_check(logs, chain, width)
    bad = F.when(~F.col("ok"), F.struct("seq", "id"))
    agg = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("log_hash", "id").alias("tail"), F.min(bad).alias("broken")
    )
    ok = F.col("broken").isNull()
    return agg.select(
        *keys,
        ok.alias("ok"),
        F.when(ok, F.col("n")).alias("verified_count"),
        F.when(ok, F.col("tail")).alias("last_hash"),
        F.col("broken.seq").alias("broken_at_index"),
        F.col("broken.id").alias("broken_log_id"),
    )


def append_events(events: DataFrame, tails: DataFrame | None = None, chain: str = "user_id") -> DataFrame:
    """Hash-chained audit records for new events, one chain per value of ``chain``.

    A hash needs its predecessor's hash, so a chain is sequential by nature: make chains many (per user, per
    user and day). The record texts are built in parallel; one chain is then streamed through one task that
    keeps only the running hash.

    events: id, user_id, action, details, timestamp and the chain column. tails: chain column, last_hash.
    """
    if tails is None:
        source = events.withColumn("last_hash", F.lit(None).cast("string"))
    else:
        known = tails.select(F.col(chain).alias("__chain"), "last_hash")
        source = events.join(known, F.col(chain).eqNullSafe(F.col("__chain")), "left").drop("__chain")
    fields = ["id", "user_id", "action", "details", "timestamp"]
    slim = source.select(
        F.col(chain).alias("chain_key"),
        *fields,
        "last_hash",
        audit_head(*[F.col(c) for c in fields[1:]]).alias("head"),
    )
    linked = run_in_order(
        slim,
        ["chain_key"],
        ["id"],
        lambda first: ChainLink(first.last_hash),
        "prev_hash string, log_hash string",
        ["chain_key", *fields],
    )
    return linked.drop("chain_key") if chain in CHAIN_COLUMNS else linked.withColumnRenamed("chain_key", chain)


def recent_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest records first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def retention_split(files: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(expired, kept): expired means no hold and a deadline strictly before ``as_of``."""
    expired = F.coalesce(~F.col("legal_hold") & (F.col("retention_expires_at") < as_of), F.lit(False))
    return files.filter(expired), files.filter(~expired)


def set_legal_hold(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes`` (id, hold); files without a change keep their flag."""
    return (
        files.join(changes.select("id", "hold"), "id", "left")
        .withColumn("legal_hold", F.coalesce("hold", "legal_hold"))
        .drop("hold")
        .select(*files.columns)
    )


def delete_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id"), "id", "left_anti")


def missing_originals(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files whose ``original_path`` is not in the storage listing (column ``path``)."""
    return files.join(listing.select(F.col("path").alias("original_path")), "original_path", "left_anti")


def cache_key(id_: Column, mode: Column, sha: Column, filename: Column, version: str = fixed.CACHE_VERSION) -> Column:
    text = F.concat_ws(":", F.lit(version), id_.cast("string"), mode, F.coalesce(F.nullif(sha, F.lit("")), F.lit("nohash")), filename)
    return F.substring(F.sha2(text, 256), 1, 24)


def with_cache_key(files: DataFrame) -> DataFrame:
    mode = effective_mode(F.col("filename"), F.col("sanitization_mode"))
    return files.withColumn("mode", mode).withColumn(
        "cache_key", cache_key(F.col("id"), F.col("mode"), F.col("file_sha256"), F.col("filename"))
    )


RESULT_COLUMNS = ["id", "cache_key", "mode", "sanitized_text", "summary", "pii_count"]


def incremental_sanitize(files: DataFrame, stored: DataFrame, **options) -> DataFrame:
    """Results of all files: stored ones where the key is known, freshly sanitized ones otherwise.

    files: id, filename, sanitization_mode, file_sha256, text. stored: RESULT_COLUMNS. What is open is decided on ids and keys alone;
    texts meet only the open ids. A file whose mode is unknown comes back without text, with an empty summary and a null count.
    """
    keyed = with_cache_key(files)
    keys = keyed.select("id", "cache_key")
    reused = stored.join(keys, ["id", "cache_key"], "left_semi").select(*RESULT_COLUMNS)
    open_ = keys.join(stored.select("id", "cache_key"), ["id", "cache_key"], "left_anti")
    usable = known_mode(F.col("mode"))
    todo = keyed.join(open_, ["id", "cache_key"], "left_semi")
    todo = todo.withColumn("text", F.when(usable, F.col("text"))).withColumn("safe_mode", F.when(usable, F.col("mode")).otherwise("mask"))
    fresh = sanitize_documents(todo, ["id", "cache_key", "mode", "safe_mode"], "text", F.col("safe_mode"), **options)
    fresh = fresh.withColumn("pii_count", F.when(usable, F.col("pii_count")))
    return reused.unionByName(fresh.select(*RESULT_COLUMNS))


def refresh_metadata(files: DataFrame, results: DataFrame) -> DataFrame:
    """Copy pii_count and summary onto files; ``changed`` marks the rows that need a write.

    files: id, pii_count, summary (map). results: id, pii_count, summary (map).
    """
    def entries(m: str) -> Column:
        return F.array_sort(F.map_entries(m))

    new = results.select("id", F.col("pii_count").alias("new_count"), F.col("summary").alias("new_summary"))
    known = F.col("new_count").isNotNull()
    same = F.col("pii_count").eqNullSafe(F.col("new_count")) & entries("summary").eqNullSafe(entries("new_summary"))
    changed = known & ~same
    return (
        files.join(new, "id", "left")
        .withColumn("changed", changed)
        .withColumn("pii_count", F.when(changed, F.col("new_count")).otherwise(F.col("pii_count")))
        .withColumn("summary", F.when(changed, F.col("new_summary")).otherwise(F.col("summary")))
        .drop("new_count", "new_summary")
    )


def visible_files(files: DataFrame, user_id: int, role: str) -> DataFrame:
    """Raw data: administrators see everything, users what they uploaded."""
    return files if role == "admin" else files.filter(F.col("uploaded_by") == user_id)


def catalog(files: DataFrame) -> DataFrame:
    """File list, newest first; the summary stays a map. A file without a scan shows status unknown and source none."""

    def scanned(column: str, missing: str) -> Column:
        value = F.col(column) if column in files.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(missing)).alias(column)

    return files.select(
        "id",
        "filename",
        "uploaded_by",
        "upload_time",
        "pii_count",
        effective_mode(F.col("filename"), F.col("sanitization_mode")).alias("sanitization_mode"),
        "summary",
        scanned("malware_scan_status", "unknown"),
        scanned("malware_scan_source", "none"),
        "retention_expires_at",
        "legal_hold",
    ).orderBy(F.desc("upload_time"), F.desc("id"))


def search(
    sanitized: DataFrame,
    terms: str | list[str],
    user_id: int | None = None,
    months: tuple[str, str] | None = None,
    preview: int = 350,
) -> DataFrame:
    """Rows that hold any of the terms in their stored sanitized text or file name, whatever the case, newest first.

    One scan and one sort for all terms. With ``user_id`` only that user's files are searched (administrators search all);
    ``months`` ('2024-01', '2024-03', both included) reads only those partitions of a store written by month.
    """
    wanted = [terms] if isinstance(terms, str) else list(terms)
    if not wanted or any(len(t) < 2 for t in wanted):
        raise ValueError("the search term needs at least two characters")
    text, name = F.lower("sanitized_text"), F.lower("filename")
    hit = F.lit(False)
    for t in wanted:
        needle = F.lower(F.lit(t))
        hit = hit | F.contains(text, needle) | F.contains(name, needle)
    if user_id is not None:
        sanitized = sanitized.filter(F.col("uploaded_by") == user_id)
    if months is not None:
        sanitized = sanitized.filter(F.col("upload_month").between(*months))
    return (
        sanitized.filter(hit)
        .select("id", "filename", "upload_time", F.substring("sanitized_text", 1, preview).alias("preview"))
        .orderBy(F.desc("upload_time"), F.desc("id"))
    )


def download_name(filename: Column, plain_text: bool) -> Column:
    """Name of a sanitized download: ``stem.sanitized.txt`` or ``stem.sanitized.<ext>``."""
    ext = extension(filename)
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return F.concat(stem, F.lit(".sanitized"), F.lit(".txt") if plain_text else ext)
