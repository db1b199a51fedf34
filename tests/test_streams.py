import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from privacyframes.operators import governance as G
from privacyframes.operators.sanitization import sanitize_documents
from privacyframes.streaming import batch as B
from privacyframes.streaming import stream as S


@pytest.fixture(scope="module")
def events(spark, sf_small, tmp_path_factory):
    """Events as six files in time order, one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    df = spark.read.parquet(f"{sf_small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = df.orderBy("ts").toPandas()
    for i in range(6):
        part = rows.iloc[i * len(rows) // 6 : (i + 1) * len(rows) // 6]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rate_limit_over_batches(spark, events):
    batch, stream = events
    pick = lambda d: d.select((F.col("user_id") % 4).alias("client"), "event_id", "ts")
    want = B.rate_limit(pick(batch), limit=3, window_seconds=7200)
    assert rows(S.run_available(S.rate_limit_stream(pick(stream), 3, 7200), spark)) == rows(want)


def test_lockout_over_batches(spark, events):
    batch, stream = events
    pick = lambda d: d.select((F.col("user_id") % 4).alias("user_id"), "event_id", "ts", (F.col("event_type") == "view").alias("success"))
    want = B.login_actions(pick(batch), lock_minutes=300)
    got = rows(S.run_available(S.login_stream(pick(stream), lock_minutes=300), spark))
    assert got == rows(want) and len({r[3] for r in got}) == 4


def test_chain_over_batches(spark, events):
    batch, stream = events
    pick = lambda d: d.select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("user_id"), F.col("event_type").alias("action"), F.col("props").alias("details"), F.col("ts").alias("timestamp"))
    got = S.run_available(S.audit_stream(pick(stream)), spark).drop("chain_key")
    assert rows(got.drop("timestamp")) == rows(G.append_events(pick(batch)).drop("timestamp"))
    assert {r.ok for r in G.verify_chain(got, ["user_id"]).collect()} == {True}


def test_sanitize_stream_equals_batch(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(sf_small)
    pick = lambda d: d.select("doc_id", "sanitized_text", "pii_count")
    got = S.run_available(pick(S.sanitize_stream(stream, ["doc_id"])), spark)
    assert rows(got) == rows(pick(sanitize_documents(docs, ["doc_id"])))


def test_states_of_the_silent_are_forgotten(spark, events, tmp_path):
    """Six batches, then one event two days later: only its client is remembered, and no result changes."""
    batch, stream = events
    last = batch.agg(F.max("ts")).first()[0] + dt.timedelta(days=2)
    pick = lambda d: d.select("user_id", "event_id", "ts", (F.col("event_type") == "view").alias("success")).withColumn("client", F.col("user_id"))
    more = spark.createDataFrame([(77, 10**9, last, False)], "user_id long, event_id long, ts timestamp, success boolean").withColumn("client", F.col("user_id"))
    path = str(tmp_path / "in")
    pick(batch).coalesce(1).write.parquet(path)
    source = spark.readStream.schema(pick(batch).schema).parquet(path)
    machines = [
        (S.rate_limit_stream(source, 3, 7200), lambda d: B.rate_limit(d, limit=3, window_seconds=7200), 1),
        (S.login_stream(source, lock_minutes=300), lambda d: B.login_actions(d, lock_minutes=300), None),
    ]
    folders = [str(tmp_path / f"out{i}") for i in range(2)]
    for (machine, _, _), folder in zip(machines, folders):
        dataclasses.replace(machine, compact=1).start(folder).awaitTermination()
    more.coalesce(1).write.mode("append").parquet(path)
    for (machine, whole, live), folder in zip(machines, folders):
        machine = dataclasses.replace(machine, compact=1)
        at = S.Folder(spark, folder)
        before = machine.latest(at, 1).count()
        machine.start(folder).awaitTermination()
        assert at.numbers("steps") == [0, 1]
        assert rows(machine.results(spark, folder)) == rows(whole(pick(batch).union(more)))
        states = {tuple(r.k) for r in machine.latest(at, 2).collect()}
        assert (77,) in states and len(states) < before + 1
        assert live is None or len(states) == live


def test_a_batch_that_runs_again_replaces_its_results(spark, events, tmp_path):
    batch, _ = events
    hot = batch.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.when(F.col("user_id") % 10 != 4, F.col("user_id"))))
    pick = lambda d: d.select("user_id", "event_id", "ts", (F.col("event_type") == "view").alias("success"))
    machine = dataclasses.replace(S.login_stream(pick(hot), lock_minutes=300), compact=2)
    at = S.Folder(spark, str(tmp_path / "again"))
    ordered = machine.stream.orderBy("ts").collect()
    for number in range(5):
        part = spark.createDataFrame(ordered[number * len(ordered) // 5 : (number + 1) * len(ordered) // 5], machine.stream.schema)
        for _ in range(2):
            machine._step(at, part, number)
    assert rows(machine.results(spark, at.path).fillna(-1)) == rows(B.login_actions(pick(hot), lock_minutes=300).fillna(-1))


def test_counters_tell_open_days_and_late_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 31, 10)
    first = [(t0, "mail a@b.co"), (t0 + dt.timedelta(days=1), "mail a@b.co and c@d.org"), (t0 + dt.timedelta(days=2), "10.0.0.1"), (None, "x@y.zz")]
    second = [(t0, "late q@r.st"), (t0 - dt.timedelta(days=40), "later 10.0.0.2"), (t0 + dt.timedelta(days=2, hours=1), "e@f.gh"), (t0, "nothing here")]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (first, second):
        df = spark.createDataFrame(part, "ts timestamp, text string")
        df.write.mode("append").parquet(source)
        S.start_counters(spark.readStream.schema(df.schema).parquet(source), folder).awaitTermination()
    daily = S.daily_counters(spark, folder)
    days = {(r.day and r.day.strftime("%m-%d"), r.entity_type): (r.n, r.late, r.open) for r in daily.collect()}
    assert days == {
        ("01-31", "EMAIL_ADDRESS"): (1, 1, False),
        ("02-01", "EMAIL_ADDRESS"): (2, 0, False),
        ("02-02", "IP_ADDRESS"): (1, 0, True),
        ("02-02", "EMAIL_ADDRESS"): (1, 0, True),
        ("12-22", "IP_ADDRESS"): (0, 1, False),
        (None, "EMAIL_ADDRESS"): (1, 0, True),
    }
    months = {(r.month, r.entity_type): r.open for r in S.monthly_counters(daily).collect()}
    assert months[("2024-01", "EMAIL_ADDRESS")] is False and months[("2024-02", "EMAIL_ADDRESS")] is True
    assert rows(S.late_rows(spark, folder)) == [(0, 4, 0), (1, 4, 3)]
