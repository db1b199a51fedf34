"""Ordered computations over keyed rows that stay parallel when one key holds most of the data.

Rows are split by (key, bucket), where buckets follow the order. Windows run inside a bucket; one small row per
bucket carries the rest over.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BUCKET = "__bucket"


def neighbours(df: DataFrame, keys: list[str], order: str, value: str, width: int, carried: list[str]) -> DataFrame:
    """Add ``before`` (``value`` of the key's row before, null for its first) and ``seq`` (the row's place among the key's rows, from 0).

    Rows are split by key and by ranges of ``width`` numbers of ``order``, a whole number, so one key runs in many tasks; its rows must
    have different numbers, which bounds a range. A range then passes on its size and its last row, one small row each. ``carried``
    names the columns that whoever uses the result needs anyway: taken for both uses, the rows are read and shuffled once.
    """
    # A struct is never null, so a null key needs no special case.
    key = F.struct(*keys) if keys else F.lit(0)
    # A boxed value tells "no row before" from "the row before holds null".
    placed = df.withColumn("__k", key).withColumn("__v", F.struct(F.col(value).alias("v"))).withColumn(BUCKET, F.expr(f"coalesce(cast(`{order}` as bigint) div {width}, 0)"))
    w = Window.partitionBy("__k", BUCKET).orderBy(order)
    local = placed.withColumn("__prev", F.lag("__v").over(w)).withColumn("__place", F.row_number().over(w))
    # Taken after the window, from the same shuffled rows.
    ends = local.groupBy("__k", BUCKET).agg(F.max("__place").alias("n"), F.max_by(F.struct(*carried, "__v"), "__place").alias("last"))
    over = Window.partitionBy("__k").orderBy(BUCKET)
    done = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = ends.select("__k", BUCKET, F.lag("last.__v").over(over).alias("__tail"), done.alias("__done"))
    joined = local.join(carry, ["__k", BUCKET])
    return joined.select(*df.columns, F.coalesce("__prev", "__tail")["v"].alias("before"), (F.col("__done") + F.col("__place") - 1).cast("long").alias("seq"))


def run_in_order(
    df: DataFrame, keys: list[str], order: list[str], begin: Callable, outputs: str, keep: list[str]
) -> DataFrame:
    """Feed each key's rows in order to its own state object; gives ``keep`` columns plus ``outputs``.

    ``begin(first_row)`` makes the state; ``state.step(row)`` returns one row's output values. A row has the keys and the columns that
    are not only kept; kept columns pass through untouched, so every type and null stays as it is, and null is a key like others. Spark
    partitions and sorts (spilling as needed) and streams Arrow batches, so memory holds one batch and one state no matter how many
    rows a key has.
    """
    kinds = dict(df.dtypes)
    added = T.StructType.fromDDL(outputs)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], outputs])
    seen = [c for c in df.columns if c in keys or c not in keep]
    places = [seen.index(k) for k in keys]
    out_names, out_types = [f.name for f in added], [to_arrow_type(f.dataType) for f in added]

    def run(batches):
        Row = namedtuple("Row", seen, rename=True)
        current, state = None, None
        for batch in batches:
            results = []
            for row in map(Row._make, zip(*(batch.column(c).to_pylist() for c in seen), strict=True)):
                key = tuple(row[i] for i in places)
                if key != current:
                    current, state = key, begin(row)
                results.append(state.step(row))
            new = [pa.array([r[i] for r in results], kind) for i, kind in enumerate(out_types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new], [*keep, *out_names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
