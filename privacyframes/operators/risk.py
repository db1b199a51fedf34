"""Risk scores and the dashboard's result sets.

Input is ``files``: file_id, filename, uploaded_by, upload_time, summary (map entity -> count).
Every report is its own DataFrame; counts are summed per key before any shuffle that matters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

TOP_FILES, TOP_ENTITIES, HEATMAP_ENTITIES = 200, 10, 8


def _weights() -> Column:
    return F.create_map(*[F.lit(x) for kv in fixed.RISK_WEIGHT.items() for x in kv])


def weighted_sum(summary: Column) -> Column:
    """Sum of weight * count over a summary map; unknown entities weigh 2, negative counts nothing."""
    weights = _weights()
    return F.aggregate(
        F.map_entries(summary),
        F.lit(0.0),
        lambda acc, e: acc
        + F.coalesce(F.try_element_at(weights, e["key"]), F.lit(fixed.DEFAULT_WEIGHT))
        * F.greatest(e["value"], F.lit(0).cast("long")),
    )


def entity_weight(entity: Column) -> Column:
    return F.coalesce(F.try_element_at(_weights(), entity), F.lit(fixed.DEFAULT_WEIGHT))


def risk_score(weighted: Column) -> Column:
    """Saturating 0-100 score, rounded half to even."""
    curve = F.lit(100.0) * (F.lit(1.0) - F.exp(-weighted / F.lit(fixed.RISK_SCALE)))
    return F.when(weighted <= 0, 0).otherwise(F.rint(F.least(F.lit(100.0), curve)).cast("int")).cast("int")


def risk_level(score: Column) -> Column:
    out = F
    for floor, name in fixed.RISK_LEVELS[:-1]:
        out = out.when(score >= floor, name)
    return out.otherwise(fixed.RISK_LEVELS[-1][1])


def summary_total(summary: Column) -> Column:
    return F.aggregate(
        F.map_values(summary), F.lit(0).cast("long"), lambda a, n: a + F.greatest(n, F.lit(0).cast("long"))
    )


def parse_summary(json_text: Column) -> Column:
    """Stored summary text as a map; empty or broken text gives an empty map."""
    return F.coalesce(F.from_json(json_text, "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))


def in_scope(files: DataFrame, user_id: int | None = None) -> DataFrame:
    """An administrator (``None``) sees all files, a user their own."""
    return files if user_id is None else files.filter(F.col("uploaded_by") == user_id)


def file_scores(files: DataFrame) -> DataFrame:
    """Score of every file. Narrow."""
    score = risk_score(weighted_sum(F.col("summary")))
    scored = files.select(
        "file_id",
        "filename",
        "uploaded_by",
        "upload_time",
        summary_total(F.col("summary")).alias("pii_count"),
        score.alias("risk_score"),
        F.col("summary").alias("entities"),
    )
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def top_files(files: DataFrame, limit: int = TOP_FILES) -> DataFrame:
    """Riskiest files: score, count, time, all descending; the file id settles full ties."""
    return (
        file_scores(files)
        .orderBy(F.desc("risk_score"), F.desc("pii_count"), F.desc("upload_time"), F.asc("file_id"))
        .limit(limit)
    )


def entity_rows(files: DataFrame) -> DataFrame:
    """One row per file and entity."""
    return files.select(
        "file_id", "uploaded_by", "upload_time", F.explode_outer("summary").alias("entity", "n")
    ).filter(F.col("entity").isNotNull())


def top_entities(files: DataFrame, limit: int = TOP_ENTITIES) -> DataFrame:
    totals = entity_rows(files).groupBy("entity").agg(F.sum("n").alias("count"))
    return totals.orderBy(F.desc("count"), F.asc("entity")).limit(limit)


def user_scores(files: DataFrame, users: DataFrame) -> DataFrame:
    """Score per uploader from the summed counts; unknown uploaders get a made-up name.

    First sum per (user, entity): at most a few dozen rows per user reach the second step.
    """
    per_entity = entity_rows(files).groupBy("uploaded_by", "entity").agg(F.sum("n").alias("n"))
    counted = F.greatest("n", F.lit(0).cast("long"))
    per_user = per_entity.groupBy("uploaded_by").agg(
        F.sum("n").alias("pii_count"),
        F.sum(entity_weight(F.col("entity")) * counted).alias("weighted"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "n")))).alias("entities"),
    )
    score = risk_score(F.col("weighted"))
    named = per_user.join(
        users.select(F.col("user_id").alias("uploaded_by"), "username"), "uploaded_by", "left"
    ).select(
        F.col("uploaded_by").alias("user_id"),
        F.coalesce("username", F.concat(F.lit("user-"), F.col("uploaded_by").cast("string"))).alias("username"),
        "pii_count",
        score.alias("risk_score"),
        risk_level(score).alias("risk_level"),
        "entities",
    )
    return named.orderBy(F.desc("risk_score"), F.desc("pii_count"), F.asc("user_id"))


def overall(files: DataFrame) -> DataFrame:
    """One row: file_count, pii_count, risk_score, risk_level over everything.

    Every file counts once, at its first entity (or its only, empty row), so one pass gives both the file
    count and the per-entity totals; a few dozen totals reach the last step.
    """
    rows = files.select(F.posexplode_outer("summary").alias("pos", "entity", "n"))
    totals = rows.groupBy("entity").agg(
        F.sum("n").alias("n"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("files")
    )
    counted = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0).cast("long"))
    sums = totals.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("file_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pii_count"),
        F.coalesce(F.sum(entity_weight(F.col("entity")) * counted), F.lit(0.0)).alias("w"),
    )
    score = risk_score(F.col("w"))
    return sums.select("file_count", "pii_count", score.alias("risk_score"), risk_level(score).alias("risk_level"))


def first_month(as_of: dt.datetime, months: int) -> dt.datetime:
    """Start of the period: 31 days per month back from the first of the current month."""
    if not 1 <= months <= 36:
        raise ValueError("months must be between 1 and 36")
    return dt.datetime(as_of.year, as_of.month, 1) - dt.timedelta(days=31 * (months - 1))


def month_axis(as_of: dt.datetime, months: int, axis: str = "reference") -> list[str]:
    """Month keys. ``reference`` repeats the original stepping (it can miss a month); ``calendar`` is gapless."""
    if axis == "calendar":
        n = as_of.year * 12 + as_of.month - 1
        return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(n - months + 1, n + 1)]
    if axis != "reference":
        raise ValueError("axis must be 'reference' or 'calendar'")
    day, keys = first_month(as_of, months), []
    for _ in range(months):
        keys.append(day.strftime("%Y-%m"))
        day = (day + dt.timedelta(days=32)).replace(day=1)
    return keys


def _axis_frame(files: DataFrame, keys: list[str]) -> DataFrame:
    rows = ", ".join(f"({i}, '{k}')" for i, k in enumerate(keys))
    return files.sparkSession.sql(f"select * from values {rows} as t(month_no, month)")


def _recent(files: DataFrame, as_of: dt.datetime, months: int) -> DataFrame:
    cutoff = F.lit(first_month(as_of, months).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return files.filter(F.col("upload_time") >= cutoff).withColumn("month", F.date_format("upload_time", "yyyy-MM"))


def monthly_trend(files: DataFrame, as_of: dt.datetime, months: int = 12, axis: str = "reference") -> DataFrame:
    """Per month key: pii_count and mean file score (half-even); zero where there are no files.

    The scan is cut to the period by a filter on upload_time; the axis has at most 36 rows.
    """
    recent = _recent(files, as_of, months)
    score = risk_score(weighted_sum(F.col("summary")))
    total = F.aggregate(F.map_values("summary"), F.lit(0).cast("long"), lambda a, n: a + n)
    sums = recent.select("month", score.alias("s"), total.alias("t")).groupBy("month").agg(
        F.sum("t").alias("pii_count"), F.rint(F.sum("s") / F.count("s")).cast("int").alias("avg_risk_score")
    )
    keys = _axis_frame(files, month_axis(as_of, months, axis))
    return (
        keys.join(F.broadcast(sums.filter(F.col("month").isin(month_axis(as_of, months, axis)))), "month", "left")
        .select(
            "month",
            F.coalesce("pii_count", F.lit(0)).cast("long").alias("pii_count"),
            F.coalesce("avg_risk_score", F.lit(0)).alias("avg_risk_score"),
        )
        .orderBy("month")
    )


def heatmap(files: DataFrame, as_of: dt.datetime, months: int = 12, axis: str = "reference") -> DataFrame:
    """Counts of the top entities (by all-time total) per month key; one column per month, zero-filled."""
    keys = month_axis(as_of, months, axis)
    cutoff = F.lit(first_month(as_of, months).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    month = F.when(F.col("upload_time") >= cutoff, F.date_format("upload_time", "yyyy-MM"))
    # One pass gives the all-time total and every month's count: no join back to a top list.
    sums = [
        F.coalesce(F.sum(F.when(F.col("month") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in keys
    ]
    totals = entity_rows(files).withColumn("month", month).groupBy("entity").agg(F.sum("n").alias("total"), *sums)
    return totals.orderBy(F.desc("total"), F.asc("entity")).limit(HEATMAP_ENTITIES).drop("total")


def heatmap_long(files: DataFrame, as_of: dt.datetime, months: int = 12, axis: str = "reference") -> DataFrame:
    """The same as rows (entity, month, n)."""
    return heatmap(files, as_of, months, axis).unpivot("entity", month_axis(as_of, months, axis), "month", "n")


def score_buckets(files: DataFrame, shown: int | None = None) -> DataFrame:
    """Three-way distribution of file scores plus totals; ``shown`` counts only the riskiest files listed."""
    s = F.col("risk_score")
    scored = file_scores(files) if shown is None else top_files(files, shown)
    return scored.agg(
        F.count_if(s >= 80).alias("high"),
        F.count_if((s >= 60) & (s < 80)).alias("medium"),
        F.count_if(s < 60).alias("low"),
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_count"),
    )


def fill_missing_summaries(files: DataFrame, texts: DataFrame, key: str = "file_id", **options) -> DataFrame:
    """Detect only where no summary is stored yet and the count is zero; stored summaries pass through.

    ``files``: key, summary map, pii_count. ``texts``: key, text. The text scan is limited by the join to the
    unscanned files, and scanned files never meet their text. A file without a text row stays, with an empty summary.
    """
    from .detection import with_summary

    open_ = (F.size("summary") == 0) & (F.coalesce("pii_count", F.lit(0)) == 0)
    todo = files.filter(open_).drop("summary", "pii_count")
    met = todo.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    scanned = with_summary(met, todo.columns, "text", **options)
    return files.filter(~open_).unionByName(scanned)


def dashboard(
    files: DataFrame, users: DataFrame, as_of: dt.datetime, months: int = 12, user_id: int | None = None
) -> dict[str, DataFrame]:
    """All result sets of the risk dashboard. Per-user scores are for administrators only."""
    scoped = in_scope(files, user_id)
    out = {
        "overall": overall(scoped),
        "top_entities": top_entities(scoped),
        "monthly_trend": monthly_trend(scoped, as_of, months),
        "exposure_heatmap": heatmap(scoped, as_of, months),
        "per_file_scores": top_files(scoped),
    }
    if user_id is None:
        out["per_user_scores"] = user_scores(scoped, users)
    return out
