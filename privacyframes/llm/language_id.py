"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .registry import query, table
from .sampling import bounded, held_out, sliced

#: n-gram lengths, hash slots, labelled rows learned from at most, and the count added to each slot.
ORDERS, SLOTS, LEARNED, SMOOTHING = (1, 2, 3), 1 << 15, 20_000, 0.5
UNKNOWN = "und"
#: Characters of the texts whose n-grams are made together, about 125 bytes each.
TOGETHER = 1 << 17


def grams(texts: list[str | None]):
    """Hash slots of all n-grams of some texts and the row of each. Letters only, lower case; other characters count as one blank."""
    rows = [(t or "").lower() for t in texts]
    code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
    plain = (code < 128) & ~((code >= 97) & (code <= 122))
    code = np.where(plain, 32, code).astype(np.uint64)
    at, where = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        inside = row[: len(h)] == row[n - 1 :]
        at.append((h & np.uint64(SLOTS - 1)).astype(np.int64)[inside])
        where.append(row[: len(h)][inside])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(where)


def train(labelled: DataFrame, id_column: str, text_column: str, label_column: str, most: int = LEARNED):
    """Labels in order, and their log-probabilities per slot with the log-prior last (labels x slots + 1).

    Every task adds up its own rows; one row of counts per task and label is shuffled. The matrix is all that reaches the driver.
    """
    sample = bounded(labelled.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()), [id_column, text_column], most)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in sliced(batch, "text", TOGETHER):
                slot, row = grams(part["text"].to_pylist())
                labels = np.array(part["label"].to_pylist(), object)
                for label in set(labels):
                    mine = totals.setdefault(label, np.zeros(SLOTS + 1))
                    mine[:SLOTS] += np.bincount(slot[(labels == label)[row]], minlength=SLOTS)
                    mine[SLOTS] += (labels == label).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["label", "counts"])

    def add(key, rows):
        total = np.sum([np.frombuffer(x) for x in rows["counts"].to_pylist()], axis=0)
        return pa.table({"label": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    each = sample.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("label")).mapInArrow(count, "label string, counts binary")
    summed = sorted(tuple(r) for r in each.groupBy("label").applyInArrow(add, "label string, counts binary").collect())
    if not summed:
        return [], np.zeros((0, SLOTS + 1), np.float32)
    counts = np.array([np.frombuffer(c) for _, c in summed])
    smooth = counts[:, :SLOTS] + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    prior = np.log(counts[:, SLOTS:] / counts[:, SLOTS:].sum())
    return [x for x, _ in summed], np.hstack([logs, prior]).astype(np.float32)


def predict(docs: DataFrame, labels: list[str], logs: np.ndarray, text_column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior of that label); the matrix is broadcast, bounded by labels x slots.

    ``und`` with score 0.0 where the text is null or has no letter, or where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((labels, logs))
    names_kept = docs.columns
    body = docs.withColumn("__letters", F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)))

    def score(batches):
        names, matrix = shared.value
        table = np.ascontiguousarray(matrix[:, :-1].T)
        for batch in batches:
            # Rows go back as they are done, so that neither side holds the texts of a batch a second time.
            for part in sliced(batch, text_column, TOGETHER):
                n = part.num_rows
                slot, row = grams(part.column(text_column).to_pylist())
                total = np.tile(matrix[:, -1].astype(float), (n, 1)) if names else np.zeros((n, 1))
                for k in range(len(names)):
                    total[:, k] += np.bincount(row, weights=table[slot, k], minlength=n)
                top = total.argmax(axis=1)
                sure = (1 / np.exp(total - total[np.arange(n), top][:, None]).sum(axis=1)).tolist()
                known = [bool(names) and x for x in part.column("__letters").to_pylist()]
                lang = [names[k] if x else UNKNOWN for k, x in zip(top.tolist(), known, strict=True)]
                kept = [part.column(c) for c in names_kept]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array([s if x else 0.0 for s, x in zip(sure, known, strict=True)], pa.float64())], [*names_kept, "lang_pred", "score"])

    schema = StructType(docs.schema.fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return body.mapInArrow(score, schema)


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", learned: int = LEARNED) -> DataFrame:
    """Predicted language of every whole text: the id, ``text``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1), one row per row.

    Learns from at most ``learned`` rows (by a hash of the id) that are not held out and have a label and a text; the text is the only
    input of a prediction. Null texts and texts without a letter are ``und`` with score 0.0; so is everything if no label was learned.
    Ties go to the label that sorts first. Null ids are predicted like others and are never learned from. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(label_column).alias("label"))
    labels, logs = train(rows.filter(~held_out("doc_id")), "doc_id", "text", "label", learned)
    found = predict(rows.select("doc_id", "text"), labels, logs)
    return found.withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False))).withColumnRenamed("doc_id", id_column)


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
