"""Structured Streaming forms: sanitizing, counters, and keyed state machines.

Counters and machines run per micro-batch: Spark partitions and sorts a batch, results and what is carried over are written under the
number of the batch, and a batch that is run again after a failure replaces its own files. Nothing is held between batches but those files.
"""

from __future__ import annotations

import uuid
from collections import namedtuple
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed
from ..functions.detect import entity_counts, findings
from ..operators.governance import audit_head
from ..operators.sanitization import sanitize_documents
from ..session import checkpoint_dir
from .batch import micros
from .machines import SECOND, ChainLink, LoginGuard, RateWindow


def sanitize_stream(stream: DataFrame, keys: list[str], text: str = "text", mode: Column | str = "mask", **options):
    """Same narrow plan as in batch: stateless, so any trigger and sink will do."""
    return sanitize_documents(stream, keys, text, mode, **options)


class Folder:
    """Numbered results of micro-batches in a folder of any file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def numbers(self, name: str) -> list[int]:
        at = self._path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.removeprefix("batch=")) for x in found if x.startswith("batch="))

    def put(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def get(self, name: str, schema: T.StructType, numbers: list[int] | None = None) -> DataFrame:
        """Results of some batches or all, with their number as ``batch``."""
        numbers = self.numbers(name) if numbers is None else numbers
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not numbers:
            return self.spark.createDataFrame([], whole)
        base = f"{self.path}/{name}"
        return self.spark.read.schema(whole).option("basePath", base).parquet(*(f"{base}/batch={i}" for i in numbers))

    def drop(self, name: str, numbers: list[int]) -> None:
        for i in numbers:
            at = self._path(f"{self.path}/{name}/batch={i}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _start(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None], trigger: dict):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


# --- counters ---------------------------------------------------------------------------------------------
def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_COUNTS = _fields(day=T.TimestampType(), entity_type=T.StringType(), late=T.BooleanType(), n=T.LongType())
_MARKS = _fields(high=T.TimestampType(), n_rows=T.LongType(), n_late=T.LongType())


def start_counters(stream: DataFrame, folder: str, ts: str = "ts", text: str = "text", delay: str = "1 hour", trigger: dict | None = None, **options):
    """Counts findings per day and entity into ``folder``; read them with ``daily_counters``.

    The watermark is the highest time of all batches before, less ``delay``; a row whose day it has passed is late. Late rows are
    counted apart. Each text is reduced to its entity counts before the shuffle, and a batch adds one row per day, entity and lateness.
    """
    at = Folder(stream.sparkSession, folder)

    def step(batch: DataFrame, number: int) -> None:
        high = _highest(at, number)
        day = F.date_trunc("day", F.col(ts))
        late = F.lit(False) if high is None else F.coalesce(day + F.expr("interval 1 day") <= F.lit(high) - F.expr(f"interval {delay}"), F.lit(False))
        seen = Observation(f"batch-{uuid.uuid4().hex}")
        rows = batch.select(F.col(ts).alias("at"), day.alias("day"), late.alias("late"), F.col(text).alias("text"))
        rows = rows.observe(seen, F.max("at").alias("high"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("late").cast("long")), F.lit(0)).alias("n_late"))
        counts = rows.select("day", "late", F.explode(entity_counts(findings("text", **options))).alias("entity_type", "n"))
        at.put("counts", number, counts.groupBy("day", "entity_type", "late").agg(F.sum("n").cast("long").alias("n")))
        found = seen.get
        top = max((x for x in (high, found["high"]) if x is not None), default=None)
        at.put("marks", number, at.spark.createDataFrame([(top, found["n_rows"], found["n_late"])], _MARKS).coalesce(1))

    return _start(stream, folder, step, trigger)


def _highest(at: Folder, before: int | None = None):
    numbers = [i for i in at.numbers("marks") if before is None or i < before]
    return at.get("marks", _MARKS, numbers[-1:]).first()["high"] if numbers else None


def daily_counters(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """``(day, entity_type, n, late, open)``: findings in time and late ones, and whether the watermark has not passed the day yet."""
    at = Folder(spark, folder)
    high = F.lit(_highest(at)).cast("timestamp")
    counts = at.get("counts", _COUNTS)
    split = [F.coalesce(F.sum(F.when(F.col("late") == x, F.col("n"))), F.lit(0)).alias(name) for x, name in ((False, "n"), (True, "late"))]
    is_open = F.coalesce(F.col("day") + F.expr("interval 1 day") > high - F.expr(f"interval {delay}"), F.lit(True))
    return counts.groupBy("day", "entity_type").agg(*split).withColumn("open", is_open)


def monthly_counters(daily: DataFrame) -> DataFrame:
    """``(month, entity_type, n, late, open)``: a month is open as long as one of its days is."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    return daily.groupBy(month, "entity_type").agg(F.sum("n").alias("n"), F.sum("late").alias("late"), F.max("open").alias("open"))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, n_rows, n_late)``: rows of every batch and how many of them came late."""
    return Folder(spark, folder).get("marks", _MARKS).select("batch", "n_rows", "n_late")


# --- keyed state machines ---------------------------------------------------------------------------------
@dataclass
class KeyedStream:
    """A stream whose rows go through one state machine per key, in order.

    Every micro-batch is sorted by key and ``order`` and streamed through the machines, each of which begins with the state its key had
    after the batch before (a row in front of its own). A batch writes its results and the states of its own keys; every
    ``compact`` batches the latest states that are still ``live`` - a condition on the state's columns and ``high``, the highest time
    of the stream - become one table, and the others are forgotten. Memory holds one Arrow batch and one state, whatever a key's size.
    """

    stream: DataFrame
    key: str
    order: list[str]
    keep: list[str]
    outputs: str
    state: str
    load: Callable
    save: Callable
    live: str | None = None
    compact: int = 16

    def __post_init__(self):
        fields = self.stream.schema
        names = [self.key, *(c for c in self.keep if c != self.key)]
        self.result = T.StructType([*(fields[c] for c in names), *T.StructType.fromDDL(self.outputs)])
        self.states = T.StructType([T.StructField("k", T.StructType([fields[self.key]])), *T.StructType.fromDDL(self.state), T.StructField("seen", T.LongType())])

    def start(self, folder: str, trigger: dict | None = None):
        at = Folder(self.stream.sparkSession, folder)
        return _start(self.stream, folder, lambda batch, number: self._step(at, batch, number), trigger)

    def results(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = Folder(spark, folder).get("steps", T.StructType([T.StructField("kind", T.StringType()), *self.result, *self.states]))
        return rows.filter("kind = 'row'").select(*self.result.names)

    def latest(self, at: Folder, before: int) -> DataFrame:
        """The state of every key that is remembered, as it was before a batch."""
        whole = [i for i in at.numbers("states") if i < before][-1:]
        since = [i for i in at.numbers("steps") if i < before and (not whole or i > whole[0])]
        changed = at.get("steps", T.StructType([T.StructField("kind", T.StringType()), *self.states]), since).filter("kind = 'state'").drop("kind")
        both = at.get("states", self.states, whole).unionByName(changed)
        columns = [f.name for f in self.states if f.name != "k"]
        return both.groupBy("k").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("k", *(F.col(f"s.{c}").alias(c) for c in columns))

    def _step(self, at: Folder, batch: DataFrame, number: int) -> None:
        held = [f for f in self.states if f.name != "k"]
        rows = batch.withColumn("k", F.struct(self.key))
        columns = [c for c in rows.columns if c != "k"]
        known = self.latest(at, number).join(rows.select("k").distinct(), "k", "left_semi")
        none = lambda fields: [F.lit(None).cast(f.dataType).alias(f"__{f.name}" if f in held else f.name) for f in fields]
        seeds = known.select("k", *none(batch.schema[c] for c in columns), *(F.col(f.name).alias(f"__{f.name}") for f in held), F.lit(0).alias("__row"))
        both = rows.select("k", *columns, *none(held), F.lit(1).alias("__row")).union(seeds)
        done = both.repartition("k").sortWithinPartitions("k", "__row", *self.order).mapInArrow(self._run(columns), T.StructType([T.StructField("kind", T.StringType()), *self.result, *self.states]))
        at.put("steps", number, done)
        if self.compact and (number + 1) % self.compact == 0:
            states = self.latest(at, number + 1)
            if self.live:
                high = states.agg(F.max("seen")).first()[0]
                states = states.withColumn("high", F.lit(high).cast("long")).filter(self.live).drop("high")
            at.put("states", number, states)
            # This batch may run again, so what it began with stays until the next time.
            at.drop("states", [i for i in at.numbers("states") if i < number - self.compact])

    def _run(self, columns: list[str]):
        load, save, key, t = self.load, self.save, self.key, self.order[0]
        result, states = self.result, self.states
        outputs = [(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(self.outputs)]
        kept = [n for n in result.names if n not in {o for o, _ in outputs}]
        held = [f.name for f in states if f.name not in ("k", "seen")]
        kinds = {f.name: to_arrow_type(f.dataType) for f in (*result, *states)}
        names = ["kind", *result.names, *(f.name for f in states)]

        def empty(n, kind):
            return pa.nulls(n, kind)

        def run(batches):
            Row = namedtuple("Row", columns, rename=True)
            now, machine, seen = None, None, None
            closed: list[tuple] = []

            def flush():
                n = len(closed)
                made = {"k": [x[0] for x in closed], "seen": [x[2] for x in closed]} | {c: [x[1][i] for x in closed] for i, c in enumerate(held)}
                out = [pa.array(["state"] * n, pa.string()), *(empty(n, kinds[c]) for c in result.names), *(pa.array(made[f.name], kinds[f.name]) for f in states)]
                closed.clear()
                return pa.RecordBatch.from_arrays(out, names)

            for batch in batches:
                data = [batch.column(c).to_pylist() for c in columns]
                brought = list(zip(*(batch.column(f"__{c}").to_pylist() for c in (*held, "seen")), strict=True))
                results, own = [], []
                for i, (k, row, is_row, old) in enumerate(zip(batch.column("k").to_pylist(), map(Row._make, zip(*data, strict=True)), batch.column("__row").to_pylist(), brought, strict=True)):
                    if now != k or machine is None:
                        if machine is not None:
                            closed.append((now, save(machine), seen))
                        now, machine, seen = k, load(None if is_row else old[:-1]), None if is_row else old[-1]
                    if is_row:
                        results.append(machine.step(row))
                        own.append(i)
                        at = getattr(row, t)
                        seen = at if seen is None or (at is not None and at > seen) else seen
                part = batch.take(pa.array(own, pa.int64()))
                n = len(own)
                made = {name: pa.array([r[i] for r in results], kind) for i, (name, kind) in enumerate(outputs)} | {c: part.column(c) for c in kept}
                yield pa.RecordBatch.from_arrays([pa.array(["row"] * n, pa.string()), *(made[c] for c in result.names), *(empty(n, kinds[f.name]) for f in states)], names)
                if closed:
                    yield flush()
            if machine is not None:
                closed.append((now, save(machine), seen))
                yield flush()

        return run


def rate_limit_stream(requests: DataFrame, limit: int = fixed.RATE_MAX_HITS, window_seconds: int = fixed.RATE_WINDOW_SECONDS) -> KeyedStream:
    """requests: client, event_id, ts. State per client: at most ``limit`` times; forgotten once all are out of the window."""
    timed = requests.select("client", "event_id", F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("t"))
    return KeyedStream(
        timed,
        "client",
        ["t", "event_id"],
        ["event_id", "ts"],
        "accepted boolean",
        "hits array<bigint>",
        lambda s: RateWindow(s[0] if s else (), limit, window_seconds),
        lambda m: (list(m.hits),),
        f"array_max(hits) >= high - {window_seconds * SECOND}",
    )


def login_stream(attempts: DataFrame, max_attempts: int = fixed.MAX_LOGIN_ATTEMPTS, lock_minutes: int = fixed.LOGIN_LOCK_MINUTES) -> KeyedStream:
    """attempts: user_id, event_id, ts, success. State per user: failures so far and the lock's end; a user with neither is forgotten."""
    timed = attempts.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "success", micros("ts").alias("t"))
    return KeyedStream(
        timed,
        "user_id",
        ["t", "event_id"],
        ["event_id", "ts"],
        "action string",
        "fails int, until bigint",
        lambda s: LoginGuard(*(s or (0, None)), max_attempts, lock_minutes),
        lambda m: (m.fails, m.until),
        "fails > 0 or until > high",
    )


def audit_stream(events: DataFrame, chain: str = "user_id") -> KeyedStream:
    """events: id, user_id, action, details, timestamp; one hash chain per value of ``chain``. The last hash of a chain never expires."""
    fields = ["id", "user_id", "action", "details", "timestamp"]
    head = audit_head(*[F.col(c) for c in fields[1:]]).alias("head")
    return KeyedStream(
        events.select(F.col(chain).alias("chain_key"), *fields, head),
        "chain_key",
        ["id"],
        fields,
        "prev_hash string, log_hash string",
        "last_hash string",
        lambda s: ChainLink(s[0] if s else None),
        lambda m: (m.last_hash,),
    )


def stream_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame | KeyedStream, spark: SparkSession, output_mode: str = "append") -> DataFrame:
    """Process what is there now into a parquet folder under the checkpoint folder, and read that back."""
    base = stream_folder(spark)
    if isinstance(stream, KeyedStream):
        stream.start(base).awaitTermination()
        return stream.results(spark, base)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
