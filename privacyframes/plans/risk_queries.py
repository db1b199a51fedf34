"""Queries: the risk dashboard's result sets over scanned files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import risk as R
from ..operators.detection import with_summary
from . import inputs, oracle
from .detection_queries import CORPUS_TEXTS
from .inputs import DUCK_FILES_SQL, DUCK_USERS
from .registry import query

AS_OF, MONTHS = dt.datetime(2025, 2, 10), 12
_META = ["id", "filename", "uploaded_by", "upload_time"]


def scanned_files(spark, sf):
    """Files with the summary of their text, as the reports expect them."""
    return with_summary(inputs.files(spark, sf), _META).withColumnRenamed("id", "file_id")


_WEIGHT = "case {e} " + " ".join(f"when '{k}' then {v}" for k, v in fixed.RISK_WEIGHT.items()) + f" else {fixed.DEFAULT_WEIGHT} end"


def weight(e: str) -> str:
    return f"cast({_WEIGHT.replace('{e}', e)} as double)"


def score(w: str) -> str:
    return f"cast(case when {w} <= 0 then 0 else round_even(least(100.0, 100.0 * (1.0 - exp(-({w}) / 20.0))), 0) end as int)"


def level(s: str) -> str:
    return f"case when {s} >= 80 then 'critical' when {s} >= 60 then 'high' when {s} >= 30 then 'medium' else 'low' end"


_BASE = f"""f as (select * exclude (text) from ({DUCK_FILES_SQL})),
c as (select doc_id as id, entity_type as entity, count(*) as n from kept group by doc_id, entity_type),
w as (select f.id, f.filename, f.uploaded_by, f.upload_time, cast(coalesce(sum(n), 0) as bigint) as pii_count, coalesce(sum(n * {weight('entity')}), 0) as weighted
  from f left join c on f.id = c.id group by all),
s as (select *, {score('weighted')} as risk_score from w)"""


def _check(select: str, extra: str = "") -> str:
    return oracle.findings_sql(CORPUS_TEXTS, select, extra=_BASE + (",\n" + extra if extra else ""))


@query("k01_weighted_sum", _check("select id as file_id, weighted from s"))
def weighted(spark, sf):
    return scanned_files(spark, sf).select("file_id", R.weighted_sum(F.col("summary")).alias("weighted"))


@query("k02_risk_score", _check("select id as file_id, pii_count, risk_score from s"))
def scores(spark, sf):
    return R.file_scores(scanned_files(spark, sf)).select("file_id", "pii_count", "risk_score")


@query("k03_risk_level", _check(f"select {level('risk_score')} as risk_level, count(*) as n_files, sum(pii_count)::bigint as pii_count from s group by 1"))
def levels(spark, sf):
    return R.file_scores(scanned_files(spark, sf)).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("pii_count").alias("pii_count")
    )


@query(
    "k04_top_files",
    _check(
        f"select id as file_id, filename, uploaded_by, upload_time, pii_count, risk_score, {level('risk_score')} as risk_level from s "
        "order by risk_score desc, pii_count desc, upload_time desc, id limit 200"
    ),
)
def top_files(spark, sf):
    return R.top_files(scanned_files(spark, sf)).drop("entities")


@query(
    "k04_top_documents",
    oracle.findings_sql(
        "select 'doc' as src, doc_id, text from documents",
        f"select doc_id as file_id, pii_count, risk_score, {level('risk_score')} as risk_level from (select doc_id, pii_count, {score('weighted')} as risk_score from "
        f"(select d.doc_id, count(k.doc_id) as pii_count, coalesce(sum(case when k.doc_id is not null then {weight('entity_type')} end), 0) as weighted from documents d left join kept k on d.doc_id = k.doc_id group by d.doc_id)) "
        "order by risk_score desc, pii_count desc, doc_id limit 200",
    ),
)
def top_documents(spark, sf):
    docs = with_summary(inputs.documents(spark, sf), ["doc_id"]).select(
        F.col("doc_id").alias("file_id"),
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("long").alias("uploaded_by"),
        F.lit(None).cast("timestamp").alias("upload_time"),
        "summary",
    )
    return R.top_files(docs).select("file_id", "pii_count", "risk_score", "risk_level")


@query("k05_top_entities", _check("select entity, sum(n)::bigint as count from c group by entity order by count desc, entity limit 10"))
def top_entities(spark, sf):
    return R.top_entities(scanned_files(spark, sf))


@query(
    "k06_user_scores",
    _check(
        f"select uploaded_by as user_id, coalesce(username, 'user-' || uploaded_by) as username, pii_count, risk_score, {level('risk_score')} as risk_level from "
        f"(select uploaded_by, sum(pii_count)::bigint as pii_count, {score('sum(weighted)')} as risk_score from s where pii_count > 0 group by uploaded_by) "
        f"left join ({DUCK_USERS}) on uploaded_by = user_id"
    ),
)
def user_scores(spark, sf):
    return R.user_scores(scanned_files(spark, sf), inputs.users(spark, sf)).drop("entities")


@query(
    "k07_overall",
    _check(f"select file_count, pii_count, risk_score, {level('risk_score')} as risk_level from (select count(*) as file_count, sum(pii_count)::bigint as pii_count, {score('sum(weighted)')} as risk_score from s)"),
)
def overall(spark, sf):
    return R.overall(scanned_files(spark, sf))


_START = R.first_month(AS_OF, MONTHS).strftime("%Y-%m-%d")
# The axis once more by recursion: step 32 days, back to the first of the month.
_AXIS = f"""axis as (select strftime(d, '%Y-%m') as month, i from (
  with recursive a as (select timestamp '2025-02-01' - interval (31 * {MONTHS - 1}) day as d, 1 as i
    union all select date_trunc('month', d + interval 32 day), i + 1 from a where i < {MONTHS}) select * from a))"""


@query(
    "k08_month_axis_files",
    _check("select month, count(id) as n_files from axis left join s on strftime(upload_time, '%Y-%m') = month and upload_time >= timestamp '" + _START + "' group by month", _AXIS),
)
def axis_files(spark, sf):
    files = scanned_files(spark, sf)
    recent = R._recent(files, AS_OF, MONTHS).groupBy("month").agg(F.count(F.lit(1)).alias("n_files"))
    keys = R._axis_frame(files, R.month_axis(AS_OF, MONTHS))
    return keys.join(recent, "month", "left").select("month", F.coalesce("n_files", F.lit(0)).alias("n_files"))


@query(
    "k09_monthly_trend",
    _check(
        "select month, cast(coalesce(sum(pii_count), 0) as bigint) as pii_count, cast(coalesce(round_even(avg(risk_score), 0), 0) as int) as avg_risk_score "
        f"from axis left join s on strftime(upload_time, '%Y-%m') = month and upload_time >= timestamp '{_START}' group by month",
        _AXIS,
    ),
)
def trend(spark, sf):
    return R.monthly_trend(scanned_files(spark, sf), AS_OF, MONTHS)


@query(
    "k10_heatmap",
    _check(
        "select entity, month, cast(coalesce(sum(n), 0) as bigint) as n from (select entity, month from top8, axis) g "
        f"left join (select strftime(upload_time, '%Y-%m') as month, entity, n from c join f on c.id = f.id where upload_time >= timestamp '{_START}') m using (entity, month) group by entity, month",
        _AXIS + ", top8 as (select entity from c group by entity order by sum(n) desc, entity limit 8)",
    ),
)
def heat(spark, sf):
    return R.heatmap_long(scanned_files(spark, sf), AS_OF, MONTHS)


@query(
    "k11_lazy_scan",
    _check(
        "select f.id as file_id, case when f.id % 3 = 0 then f.id % 5 + 1 else s.pii_count end as pii_count, case when f.id % 3 = 0 then 1 else (select count(*) from c where c.id = f.id) end as n_entities from f join s on f.id = s.id"
    ),
)
def lazy_scan(spark, sf):
    """A third of the files has a stored summary; only the others are scanned."""
    files = inputs.files(spark, sf).withColumnRenamed("id", "file_id")
    known = F.col("file_id") % 3 == 0
    stored = files.select(
        "file_id",
        "filename",
        F.when(known, F.create_map(F.lit("IN_PAN"), F.col("file_id") % 5 + 1))
        .otherwise(F.create_map().cast("map<string,bigint>"))
        .alias("summary"),
        F.when(known, F.col("file_id") % 5 + 1).otherwise(0).alias("pii_count"),
    )
    done = R.fill_missing_summaries(stored, files.select("file_id", "text"))
    return done.select("file_id", "pii_count", F.size("summary").cast("long").alias("n_entities"))


@query(
    "k11_files_without_text",
    _check(
        "select f.id as file_id, case when f.id % 4 = 0 then 0 else s.pii_count end as pii_count, case when f.id % 4 = 0 then 0 else (select count(*) from c where c.id = f.id) end as n_entities from f join s on f.id = s.id"
    ),
)
def lazy_scan_without_text(spark, sf):
    """No summary is stored, and a quarter of the files has no text row: all files come back."""
    files = inputs.files(spark, sf).withColumnRenamed("id", "file_id")
    stored = files.select("file_id", "filename", F.create_map().cast("map<string,bigint>").alias("summary"), F.lit(0).cast("long").alias("pii_count"))
    done = R.fill_missing_summaries(stored, files.filter("file_id % 4 != 0").select("file_id", "text"))
    return done.select("file_id", "pii_count", F.size("summary").cast("long").alias("n_entities"))


@query(
    "k12_score_buckets",
    _check(
        "select count(*) filter (risk_score >= 80) as high, count(*) filter (risk_score between 60 and 79) as medium, count(*) filter (risk_score < 60) as low, "
        "count(*) as file_count, cast(sum(pii_count) as bigint) as pii_count from s"
    ),
)
def buckets(spark, sf):
    return R.score_buckets(scanned_files(spark, sf))


@query(
    "k12_top_six",
    _check("select id as file_id, risk_score from s order by risk_score desc, pii_count desc, upload_time desc, id limit 6"),
)
def top_six(spark, sf):
    return R.top_files(scanned_files(spark, sf), 6).select("file_id", "risk_score")


@query(
    "k13_personal_scope",
    _check(
        f"select file_count, pii_count, risk_score, {level('risk_score')} as risk_level from (select count(*) as file_count, sum(pii_count)::bigint as pii_count, {score('sum(weighted)')} as risk_score from s where uploaded_by = 7)"
    ),
)
def personal(spark, sf):
    mine = R.in_scope(inputs.files(spark, sf), 7)
    scanned = with_summary(mine, _META).withColumnRenamed("id", "file_id")
    return R.dashboard(scanned, inputs.users(spark, sf), AS_OF, MONTHS, user_id=7)["overall"]
