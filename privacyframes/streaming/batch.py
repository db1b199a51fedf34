"""Batch forms of the request-time state machines."""

from __future__ import annotations

from collections import namedtuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.ordered import BUCKET, run_in_order
from .machines import SECOND, LoginSpan, RateWindow, SeededGuard


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rate_limit(
    requests: DataFrame,
    client: str = "client",
    limit: int = fixed.RATE_MAX_HITS,
    window_seconds: int = fixed.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """``(client, event_id, ts, accepted)``. No more hits are accepted than made, so a hit with fewer than ``limit`` hits of any kind in
    its window is accepted without looking further. Only stretches around full windows run through the machine, each on its own: a
    busy client that stays below the limit is spread over all tasks, and its rows never reach Python."""
    window = window_seconds * SECOND
    timed = requests.select(client, "event_id", "ts", micros("ts").alias("t"))
    full = saturated_stretches(timed, client, ["t", "event_id"], "t", limit, window)
    cell = F.floor(F.col("t") / window).cast("long")
    same = [F.col(client).eqNullSafe(F.col("__client")), cell == F.col("__cell")]
    marked = timed.join(full, same, "left").drop("__client", "__cell")
    free = marked.filter("segment is null").select(client, "event_id", "ts", F.lit(True).alias("accepted"))
    decided = run_in_order(
        marked.filter("segment is not null"),
        [client, "segment"],
        ["t", "event_id"],
        lambda first: RateWindow((), limit, window_seconds),
        "accepted boolean",
        [client, "event_id", "ts"],
    )
    return free.union(decided)


def saturated_stretches(timed: DataFrame, key: str, order: list[str], t: str, limit: int, window: int) -> DataFrame:
    """``(__client, __cell, segment)``: cells of one window's length around the rows that ``limit`` rows precede within the window.

    Such a row marks its own cell and the one before, so the first cell of a run of marked cells holds none of them, and the rows
    before that run are out of reach of all: every run (``segment``) starts with an empty window. Rows are counted in buckets of several
    windows, with the rows of the last window before a bucket added, so a busy key is split by time.
    """
    size = max(3600 * SECOND, 4 * window)
    bucket = F.floor(F.col(t) / size).cast("long")
    also = (bucket + 1) * size - F.col(t) <= window
    spread = timed.select(key, *order, F.explode(F.when(also, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))).alias(BUCKET))
    w = Window.partitionBy(key, BUCKET).orderBy(*order)
    full = spread.withColumn("__full", F.lag(t, limit).over(w) >= F.col(t) - window).filter("__full")
    at = F.floor(F.col(t) / window).cast("long")
    cells = full.select(F.col(key).alias("__client"), F.explode(F.array(at - 1, at)).alias("__cell")).distinct()
    # Neighbouring cells have the same distance to their number among the key's cells.
    return cells.withColumn("segment", F.col("__cell") - F.row_number().over(Window.partitionBy("__client").orderBy("__cell")))


def login_actions(
    attempts: DataFrame,
    user: str = "user_id",
    max_attempts: int = fixed.MAX_LOGIN_ATTEMPTS,
    lock_minutes: int = fixed.LOGIN_LOCK_MINUTES,
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """``(user, event_id, ts, action)`` for login attempts with a boolean ``success``.

    A user's time is cut into buckets, and each is first reduced to what it does to any state it may begin with (``LoginSpan``: small).
    Going through a user's buckets with these gives the state at the start of each, and then all of them run side by side, so a user who
    only fails is spread over as many tasks as there are buckets. Attempts without a time come first.
    """
    t = F.coalesce(micros("ts"), F.lit(0))
    # Null is a user like others: a struct around it is never null, so it needs no special case.
    fields = [F.struct(F.col(user)).alias("k"), F.floor(t / (bucket_seconds * SECOND)).cast("long").alias(BUCKET), "event_id", "ts", "success", t.alias("t")]
    rows = attempts.select(*fields).repartition("k", BUCKET)
    kind = f"struct<`{user}`: {dict(attempts.dtypes)[user]}>"
    spans = rows.sortWithinPartitions("k", BUCKET, "t", "event_id").mapInArrow(_spans(max_attempts, lock_minutes), f"k {kind}, {BUCKET} long, span binary")
    begins = run_in_order(spans, ["k"], [BUCKET], lambda first: LoginSpan.Walk(), "fails int, until long", ["k", BUCKET])
    # The state at the start of a bucket comes in as its first row: without a time, and without an action.
    none = {c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("event_id", "ts", "success", "t")}
    seeds = begins.select("k", BUCKET, *none.values(), "fails", "until")
    both = rows.select("*", F.lit(None).cast("int").alias("fails"), F.lit(None).cast("long").alias("until")).union(seeds)
    found = run_in_order(
        both,
        ["k", BUCKET],
        ["t", "event_id"],
        lambda first: SeededGuard(first.fails, first.until, max_attempts, lock_minutes),
        "action string",
        ["k", "event_id", "ts"],
    )
    return found.filter("action is not null").select(F.col(f"k.{user}").alias(user), "event_id", "ts", "action")


def _spans(max_attempts: int, lock_minutes: int):
    """Sorted rows to one row for each (key, bucket): its effect, put together from pieces of bounded size."""
    Row = namedtuple("Row", ["t", "success"])

    def run(batches):
        current, span, piece = None, None, []

        def close():
            done = span.then(LoginSpan.of(piece, max_attempts, lock_minutes))
            return pa.RecordBatch.from_arrays([pa.array([current[0]], kind), pa.array([current[1]], pa.int64()), pa.array([done.dump()], pa.binary())], ["k", BUCKET, "span"])

        for batch in batches:
            kind = batch.schema.field("k").type
            for k, bucket, t, success in zip(*(batch.column(c).to_pylist() for c in ("k", BUCKET, "t", "success")), strict=True):
                if current != (k, bucket):
                    if current is not None:
                        yield close()
                    current, span, piece = (k, bucket), LoginSpan.nothing(max_attempts), []
                piece.append(Row(t, bool(success)))
                if len(piece) >= LoginSpan.PIECE:
                    span, piece = span.then(LoginSpan.of(piece, max_attempts, lock_minutes)), []
        if current is not None:
            yield close()

    return run
