import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from privacyframes.functions import fixed
from privacyframes.operators import risk as R


def score(summary):
    w = sum(fixed.RISK_WEIGHT.get(k, 2.0) * max(0, n) for k, n in summary.items())
    return int(round(min(100.0, 100.0 * (1.0 - math.exp(-w / 20.0))))) if w > 0 else 0


SUMMARIES = [{}, {"IN_VID": 1}, {"IN_AADHAAR": 1}, {"EMAIL_ADDRESS": 1}, {"PERSON_NAME": -3}, {"PERSON_NAME": -3, "IN_PAN": 2}, {"IN_AADHAAR": 500}]


@pytest.fixture()
def files(spark):
    rows = [
        (i, f"f{i}", i % 3, dt.datetime(2025, 1 + i % 3, 10), {k: int(v) for k, v in s.items()})
        for i, s in enumerate(SUMMARIES * 3)
    ]
    return spark.createDataFrame(rows, "file_id long, filename string, uploaded_by long, upload_time timestamp, summary map<string,bigint>")


def test_scores(files):
    for r in R.file_scores(files).collect():
        assert r.risk_score == score(r.entities)
        assert r.risk_level == next(n for floor, n in fixed.RISK_LEVELS if r.risk_score >= floor)
    known = {score(s) for s in SUMMARIES[:4]}
    assert known == {0, 10, 39, 22}


def test_overall_counts_clean_files(files):
    row = R.overall(files).first()
    assert row.file_count == 21 and row.pii_count == 3 * (1 + 1 + 1 - 3 - 3 + 2 + 500) and row.risk_score == 100
    none = R.overall(files.filter("false")).first()
    assert (none.file_count, none.pii_count, none.risk_score, none.risk_level) == (0, 0, 0, "low")


def test_users_with_fallback_names(spark, files):
    users = spark.createDataFrame([(0, "ann"), (2, "bob")], "user_id long, username string")
    got = {r.user_id: r for r in R.user_scores(files, users).collect()}
    assert [got[i].username for i in (0, 1, 2)] == ["ann", "user-1", "bob"]
    for u, r in got.items():
        total = {}
        for i, s in enumerate(SUMMARIES * 3):
            if i % 3 == u:
                for k, n in s.items():
                    total[k] = total.get(k, 0) + n
        assert r.entities == total and r.risk_score == score(total)


AXES = [
    ("2026-12-01", 12, ["2025-12", "2026-01", "2026-02", "2026-03", "2026-04", "2026-05", "2026-06", "2026-07", "2026-08", "2026-09", "2026-10", "2026-11"]),
    ("2026-12-01", 2, ["2026-10", "2026-12"]),
    ("2026-12-01", 1, ["2026-12"]),
    ("2026-03-15", 3, ["2025-12", "2026-01", "2026-02"]),
]


@pytest.mark.parametrize("as_of,months,want", AXES)
def test_month_axis(as_of, months, want):
    day = dt.datetime.fromisoformat(as_of)
    assert R.month_axis(day, months) == want
    calendar = R.month_axis(day, months, "calendar")
    assert len(calendar) == months and calendar[-1] == as_of[:7]
    with pytest.raises(ValueError):
        R.month_axis(day, 37)


def test_trend_and_heatmap(files):
    as_of = dt.datetime(2025, 3, 20)
    trend = {r.month: r for r in R.monthly_trend(files, as_of, 4, "calendar").collect()}
    assert list(trend) == ["2024-12", "2025-01", "2025-02", "2025-03"]
    assert (trend["2024-12"].pii_count, trend["2024-12"].avg_risk_score) == (0, 0)
    scores = [score(s) for i, s in enumerate(SUMMARIES * 3) if i % 3 == 1]
    assert trend["2025-02"].avg_risk_score == round(sum(scores) / len(scores))
    heat = R.heatmap(files, as_of, 4, "calendar").collect()
    assert [r.entity for r in heat][:2] == ["IN_AADHAAR", "IN_PAN"] and heat[0]["2024-12"] == 0
    assert sum(heat[0][m] for m in trend) == 3 * 501


def test_top_files_order(files):
    rows = R.top_files(files, 5).collect()
    keys = [(-r.risk_score, -r.pii_count, -r.upload_time.timestamp(), r.file_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == 5


def test_broken_summary_text(spark):
    df = spark.createDataFrame([("",), (None,), ("{bad",), ('{"IN_PAN": 2}',)], "s string")
    assert [r.m for r in df.select(R.parse_summary(F.col("s")).alias("m")).collect()] == [{}, {}, {}, {"IN_PAN": 2}]


def test_personal_dashboard_has_no_user_list(spark, files):
    users = spark.createDataFrame([(0, "ann")], "user_id long, username string")
    assert "per_user_scores" in R.dashboard(files, users, dt.datetime(2025, 3, 1))
    mine = R.dashboard(files, users, dt.datetime(2025, 3, 1), user_id=2)
    assert "per_user_scores" not in mine and mine["overall"].first().file_count == 7
