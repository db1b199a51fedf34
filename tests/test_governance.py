import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from privacyframes.functions import fixed
from privacyframes.operators import admission as A
from privacyframes.operators import crypto as K
from privacyframes.operators import governance as G
from privacyframes.sources import readers, writers
from privacyframes.streaming import batch as B
from privacyframes.streaming.machines import SECOND, LoginGuard, LoginSpan, RateWindow

T0 = dt.datetime(2024, 1, 1)


def logs_frame(spark, n=400, chain="all"):
    rows = [
        (i, i % 7, "ACT", None if i % 5 == 0 else f"d{i}", T0 + dt.timedelta(seconds=i, microseconds=(i % 3) * 10), chain)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, user_id long, action string, details string, timestamp timestamp, ledger string")


def test_chain_text_and_order(spark):
    got = G.append_events(logs_frame(spark, 30), chain="ledger").orderBy("id").collect()
    prev = None
    for r in got:
        text = f"{r.user_id}|{r.action}|{r.details}|{r.timestamp.isoformat()}|{prev or ''}"
        assert r.prev_hash == prev
        prev = hashlib.sha256(text.encode()).hexdigest()
        assert r.log_hash == prev


def test_append_continues_from_tails(spark):
    first = G.append_events(logs_frame(spark, 50), chain="ledger")
    tail = first.groupBy("ledger").agg(F.max_by("log_hash", "id").alias("last_hash"))
    later = logs_frame(spark, 80).filter("id >= 50")
    both = first.unionByName(G.append_events(later, tail, "ledger")).drop("ledger")
    assert G.verify_chain(both).first().verified_count == 80


@pytest.mark.parametrize("width", [1, 7, 150, 1 << 16])
def test_global_chain_over_buckets(spark, width):
    logs = G.append_events(logs_frame(spark), chain="ledger").drop("ledger")
    linked = G.audit_links(logs, width=width)
    assert linked.filter(F.col("prev_hash").eqNullSafe(F.col("before"))).count() == 400
    assert [r.seq for r in linked.orderBy("id").collect()] == list(range(400))
    ok = G.verify_chain(logs, width=width).first()
    assert ok.ok and ok.verified_count == 400 and ok.broken_at_index is None
    bad = G.verify_chain(logs.withColumn("action", F.when(F.col("id") == 123, "X").otherwise(F.col("action"))), width=width).first()
    assert (bad.ok, bad.broken_at_index, bad.broken_log_id, bad.verified_count) == (False, 123, 123, None)
    gone = G.verify_chain(logs.filter("id != 200"), width=width).first()
    assert (gone.broken_at_index, gone.broken_log_id) == (200, 201)


def test_chains_are_checked_in_one_scan(spark, sf_small):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    logs = events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), F.col("ts").cast("timestamp").alias("timestamp"), F.md5("props").alias("prev_hash"), F.md5("event_type").alias("log_hash"))
    checked = G.verify_chain(logs, ["user_id"])
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and "percentile" not in plan


def hot_events(n=6000, seed=1):
    """One client with most of the events, in bursts; a few small ones."""
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 400]) * SECOND // 2
        rows.append((1 if rng.random() < 0.8 else rng.randint(2, 9), i, T0 + dt.timedelta(microseconds=t), rng.random() < 0.45))
    return rows


def micros(ts):
    return (ts - T0) // dt.timedelta(microseconds=1)


class Row:
    def __init__(self, **kw):
        self.__dict__.update(kw)


def expected(rows, make):
    state, out = {}, {}
    for key, i, ts, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        out[i] = state.setdefault(key, make()).step(Row(t=micros(ts), success=ok))[0]
    return out


@pytest.mark.parametrize("limit,window", [(3, 10), (20, 60), (120, 60)])
def test_rate_limit_on_a_hot_client(spark, limit, window):
    rows = hot_events()
    df = spark.createDataFrame(rows, "client long, event_id long, ts timestamp, success boolean")
    got = {r.event_id: r.accepted for r in B.rate_limit(df, limit=limit, window_seconds=window).collect()}
    assert got == expected(rows, lambda: RateWindow((), limit, window))


def test_rate_window_bounds():
    w = RateWindow((), 2, 60)
    hit = lambda s: w.step(Row(t=s * SECOND))[0]
    assert [hit(0), hit(1), hit(2), hit(60), hit(61), hit(62)] == [True, True, False, False, True, True]


@pytest.mark.parametrize("minutes", [0, 1, 15])
def test_login_lockout_on_a_hot_user(spark, minutes):
    rows = hot_events(seed=2)
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, success boolean")
    got = {r.event_id: r.action for r in B.login_actions(df, lock_minutes=minutes).collect()}
    assert got == expected(rows, lambda: LoginGuard(0, None, 5, minutes))


def test_login_machine():
    g = LoginGuard()
    acts = [g.action(t * 60 * SECOND, ok) for t, ok in [(0, False)] * 4 + [(1, False), (2, True), (15, True), (16, True), (17, False)]]
    assert acts == ["LOGIN_FAIL"] * 4 + ["LOGIN_LOCKOUT", "LOGIN_BLOCKED", "LOGIN_BLOCKED", "LOGIN", "LOGIN_FAIL"]


def test_busy_client_below_its_limit_stays_out_of_the_machine(spark):
    """One hit every 30 seconds for a week: never 120 in a minute, so no stretch is saturated, and its rows lie in many buckets."""
    rows = [(1, i, T0 + dt.timedelta(seconds=30 * i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "client long, event_id long, ts timestamp")
    timed = df.withColumn("t", B.micros("ts"))
    assert B.saturated_stretches(timed, "client", ["t", "event_id"], "t", 120, 60 * SECOND).count() == 0
    got = B.rate_limit(df)
    assert got.filter("accepted").count() == 20_000
    assert re.search(r"Exchange hashpartitioning\(client#\d+L?, __bucket", got._jdf.queryExecution().toString())


def test_full_windows_begin_anew_after_free_ones(spark):
    """Bursts over the limit, days apart: each is a stretch of its own."""
    rows, n = [], 0
    for day in range(30):
        for i in range(200):
            rows.append((None, n, T0 + dt.timedelta(days=day, seconds=i // 4), True))
            n += 1
    df = spark.createDataFrame(rows, "client long, event_id long, ts timestamp, success boolean")
    timed = df.withColumn("t", B.micros("ts"))
    cells = B.saturated_stretches(timed, "client", ["t", "event_id"], "t", 120, 60 * SECOND)
    assert cells.select("segment").distinct().count() == 30
    got = {r.event_id: r.accepted for r in B.rate_limit(df).collect()}
    assert got == expected(rows, lambda: RateWindow((), 120, 60)) and not all(got.values())


def test_user_who_only_fails_is_split(spark, monkeypatch):
    monkeypatch.setattr(LoginSpan, "PIECE", 7)
    rng = random.Random(4)
    rows = [(rng.choice([None, 5, 5, 5]), i, T0 + dt.timedelta(seconds=i * rng.choice([20, 20, 21])), False) for i in range(4000)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, success boolean")
    found = B.login_actions(df, bucket_seconds=1800)
    got = {r.event_id: r.action for r in found.collect()}
    assert got == expected(rows, LoginGuard) and set(got.values()) == {"LOGIN_FAIL", "LOGIN_LOCKOUT", "LOGIN_BLOCKED"}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan") == 1 and "ReusedExchange" in plan and len(re.findall(r" Exchange ", plan)) <= 4


def test_spans_compose_like_the_machine():
    """Any state through any stretch, cut anywhere: the same as attempt by attempt."""
    rng = random.Random(1)
    for _ in range(3000):
        attempts, minutes = rng.choice((1, 2, 5)), rng.choice((1, 3))
        t, rows = 0, []
        for _ in range(rng.randrange(14)):
            t += rng.choice((0, 10, 30, 61, 200)) * SECOND
            rows.append(Row(t=t, success=rng.random() < 0.2))
        a, b = sorted(rng.randrange(len(rows) + 1) for _ in range(2))
        span = LoginSpan.nothing(attempts)
        for piece in (rows[:a], rows[a:b], rows[b:]):
            span = span.then(LoginSpan.of(piece, attempts, minutes))
        state = (0, rng.choice((0, 5, 30, 61, 100, 200, 10_000)) * SECOND) if rng.random() < 0.5 else (rng.randrange(attempts), None)
        guard = LoginGuard(*state, attempts, minutes)
        for r in rows:
            guard.step(r)
        left = [s if s[1] is None or not rows or s[1] > rows[-1].t else (s[0], None) for s in (span(state), (guard.fails, guard.until))]
        assert left[0] == left[1]


FILES = [
    ("empty.txt", None, b"", "EMPTY"),
    ("big.txt", None, b"x" * 101, "TOO_LARGE"),
    ("x.bin", "application/octet-stream", bytes([0xFF, 0, 1]) * 9, "UNSUPPORTED"),
    ("x.bin", "text/x; charset=a", bytes([0xFF, 0, 1]) * 9, "ACCEPT"),
    ("a.txt", None, b"MZ\x90", "EXECUTABLE"),
    ("a.png", None, b"\x7fELF\x01", "EXECUTABLE"),
    ("a.json", None, b"zz" + fixed.EICAR_MARKER.encode(), "MALWARE_TEST_SIGNATURE"),
    ("a.txt", None, b"known bad", "MALWARE"),
    ("a.txt", None, b"once bad, now clean", "ACCEPT"),
    ("a.txt", None, b"odd status", "MALWARE"),
    ("README", None, b"plain words", "ACCEPT"),
    (".json", None, bytes([0xFF, 0, 1]) * 9, "UNSUPPORTED"),
]


def test_admission(spark):
    df = spark.createDataFrame([(i, *f[:3]) for i, f in enumerate(FILES)], "id int, filename string, content_type string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    known = spark.createDataFrame(
        [(1, sha(b"known bad"), "malicious"), (2, sha(b"once bad, now clean"), "malicious"), (3, sha(b"once bad, now clean"), "clean"),
         (4, sha(b"once bad, now clean"), None), (5, sha(b"odd status"), "clean"), (6, sha(b"odd status"), "weird")],
        "id int, file_sha256 string, malware_scan_status string",
    )
    provider = spark.createDataFrame([(sha(b"odd status"), 0, 1, 9)], "sha256 string, malicious int, suspicious int, harmless int")
    out = {r.id: r for r in A.admit(df, known, provider, max_bytes=100).collect()}
    assert [out[i].admission_status for i in range(len(FILES))] == [f[3] for f in FILES]
    assert out[8].scan_source == "cache" and out[9].scan_source == "provider"
    strict = {r.id: r.admission_status for r in A.admit(df, known, provider, True, 100).collect()}
    assert strict[10] == "MALWARE_UNKNOWN" and strict[8] == "ACCEPT"
    events = A.block_events(A.admit(df, known, provider, max_bytes=100)).collect()
    assert len(events) == 3 and {e.action for e in events} == {"MALWARE_BLOCK"}


def test_text_ratio(spark):
    nine = b"\xff" + b"a" * 9
    df = spark.createDataFrame([(0, nine), (1, b"\xff\xff" + b"a" * 9), (2, b"a" * 4095 + "é".encode()), (3, b"")], "i int, c binary")
    got = {r.i: r.x for r in df.select("i", A.looks_like_text(F.col("c")).alias("x")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_retention_keeps_null_deadlines(spark):
    rows = [(1, False, T0), (2, True, T0), (3, False, None), (4, False, T0 + dt.timedelta(days=1)), (5, None, T0)]
    df = spark.createDataFrame(rows, "id int, legal_hold boolean, retention_expires_at timestamp")
    expired, kept = G.retention_split(df, F.lit("2024-01-02").cast("timestamp"))
    assert [r.id for r in expired.collect()] == [1]
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5]


def key():
    return F.lit(bytes(range(32)))


def test_envelope(spark, tmp_path):
    df = spark.createDataFrame([(i, f"secret {i}".encode()) for i in range(20)], "id int, content binary")
    K.encrypt(df, key()).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert stored.select("encrypted_dek").distinct().count() == 20
    back = K.decrypt(stored, key()).collect()
    assert all(r.status == "ok" and bytes(r.content) == f"secret {r.id}".encode() for r in back)
    wrong = K.decrypt(stored, F.lit(bytes(32))).select("status", "content").distinct().collect()
    assert [(r.status, r.content) for r in wrong] == [("undecryptable", None)]
    row = stored.first()
    head, nonce, wrap, body = bytes(row.stored).decode().split(":")
    assert head == "ENC2" and len(nonce) == len(wrap) == 16 and "+" not in body and "/" not in body
    unhashed = stored.withColumn("file_sha256", F.lit(None).cast("string")).withColumn("cipher_sha256", F.lit(""))
    assert {r.status for r in K.decrypt(unhashed, key()).collect()} == {"ok"}
    bad = spark.createDataFrame([(b"ENC2:a:b",), (b"plain",), (b"ENC2:a:b:***",)], "s binary")
    assert [r.u for r in bad.select(K.unpack(F.col("s")).alias("u")).collect()] == [None] * 3


def test_audit_exports(spark, tmp_path):
    import csv
    import json

    logs = G.append_events(logs_frame(spark, 40), chain="ledger").drop("ledger")
    for fmt in ("csv", "json", "jsonl"):
        writers.export_audit_logs(logs, str(tmp_path / fmt), fmt)

    def text(fmt):
        return "".join(p.read_text() for p in sorted((tmp_path / fmt).glob("part-*")))

    array = json.loads(text("json"))
    assert [r["id"] for r in array] == list(range(39, -1, -1))
    assert list(array[0]) == ["id", "user_id", "action", "details", "timestamp", "prev_hash", "log_hash"]
    assert [json.loads(line)["id"] for line in text("jsonl").splitlines()] == list(range(39, -1, -1))
    head, *rows = csv.reader(text("csv").splitlines())
    assert head == list(array[0]) and [int(r[0]) for r in rows] == list(range(39, -1, -1)) and rows[-1][5] == ""
    with pytest.raises(ValueError):
        writers.export_audit_logs(logs, str(tmp_path / "x"), "xml")


def test_backup_manifest(spark, tmp_path):
    users = spark.createDataFrame([(1, "a", "secret")], "user_id int, username string, password_hash string")
    files = spark.createDataFrame([(1, "/s/1"), (2, "/s/2")], "id int, original_path string")
    listing = spark.createDataFrame([("/s/1", 10), ("/s/9", 5)], "path string, n_bytes long")
    logs = G.append_events(logs_frame(spark, 5), chain="ledger").drop("ledger")
    out = writers.backup(users, files, logs, listing, str(tmp_path / "b"))
    assert {r.item: r.value for r in out["counts"].collect()} == {
        "users": 1, "files": 2, "audit_logs": 5, "original_files_included": 1, "missing_original_files": 1, "original_total_bytes": 10,
    }
    assert [r.original_path for r in out["missing"].collect()] == ["/s/2"]
    for r in out["parts"].collect():
        data = (tmp_path / "b" / r.table / r.part).read_bytes()
        assert (r.n_bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest()) and b"secret" not in data


def test_search_and_limits(spark):
    df = spark.createDataFrame([(1, "A.TXT", T0, "Straße x"), (2, "b", T0, "nothing")], "id int, filename string, upload_time timestamp, sanitized_text string")
    assert [r.id for r in G.search(df, "a.tx").collect()] == [1]
    assert [r.id for r in G.search(df, "STRASS").collect()] == []
    assert [r.id for r in G.search(df, "NOTH").collect()] == [2]
    with pytest.raises(ValueError):
        G.search(df, "x")
    with pytest.raises(ValueError):
        G.recent_logs(df, 1001)


def test_missing_paths_and_listing(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    listing = readers.read_files(spark, str(tmp_path)).select("path", "n_bytes")
    there = listing.first().path
    files = spark.createDataFrame([(1, there), (2, there + "x")], "id int, original_path string")
    assert [r.id for r in G.missing_originals(files, listing).collect()] == [2]


def test_bodies_of_large_files_are_not_read(spark, tmp_path):
    for name, n in (("a.txt", 5), ("b.txt", 0), ("c.txt", 500)):
        (tmp_path / name).write_bytes(b"x" * n)
    files = readers.read_files(spark, str(tmp_path)).withColumn("content_type", F.lit(None).cast("string"))
    known = spark.createDataFrame([], "id int, file_sha256 string, malware_scan_status string")
    provider = spark.createDataFrame([], "sha256 string, malicious int, suspicious int, harmless int")
    done = A.admit_files(files, known, provider, max_bytes=100)
    got = {r.filename: (r.admission_status, r.n_bytes, r.content_sha256) for r in done.collect()}
    # Spark's file sources pass over files without a byte.
    assert got == {"a.txt": ("ACCEPT", 5, hashlib.sha256(b"x" * 5).hexdigest()), "c.txt": ("TOO_LARGE", 500, None)}
    scans = re.findall(r"FileScan binaryFile.*", done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    bodies = [x for x in scans if "content" in x.split("]")[0]]
    assert len(scans) > len(bodies) and all("LessThanOrEqual(length,100)" in x for x in bodies)


def test_keyed_hashes_and_legacy_tokens_are_built_in(spark):
    import base64
    import hmac
    import os

    rows = [(os.urandom(n), os.urandom(m)) for n in (1, 16, 32, 64) for m in (0, 1, 200)]
    df = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m in rows], "k binary, m binary")
    got = [bytes(r.h) for r in df.select(K.hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect()]
    assert got == [hmac.new(k, m, hashlib.sha256).digest() for k, m in rows]
    secret = os.urandom(32)
    body = b"\x80" + bytes(8) + os.urandom(16) + os.urandom(32)
    signed = body + hmac.new(secret[:16], body, hashlib.sha256).digest()
    keys = spark.createDataFrame([(1, bytearray(secret))], "no int, legacy binary")
    stored = spark.createDataFrame([(1, bytearray(base64.urlsafe_b64encode(x))) for x in (signed, signed[:-1] + b"x", b"short")], "no int, stored binary")
    opened = stored.join(keys, "no").withColumn("encrypted_dek", F.lit(None).cast("string"))
    opened = K.decrypt(opened.withColumn("file_sha256", F.lit("")).withColumn("cipher_sha256", F.lit("")), key(), F.col("legacy"))
    plan = opened._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and secret.hex() not in plan.lower()
    assert opened.filter("status = 'ok'").count() <= 1
