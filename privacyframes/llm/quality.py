"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .registry import query, table
from .sampling import bounded, held_out
from .substring_dedup import word_hashes, word_places

#: Hash slots of words, bins of a statistic, rank of the interactions, labelled rows learned from at most, passes over them.
WORD_SLOTS, BINS, RANK, LEARNED, EPOCHS = 1 << 16, 16, 8, 6_000, 6
STATISTICS = ("length", "words", "upper", "punctuation", "digits", "lines", "bars", "repeated", "distinct", "word_length", "marked", "stated_length")
SLOTS = WORD_SLOTS + BINS * len(STATISTICS)


def _bin(share: np.ndarray) -> np.ndarray:
    """Sixteen bins of a share, finer near 0."""
    return np.clip(np.ceil(np.sqrt(np.clip(share, 0, 1)) * (BINS - 1)), 0, BINS - 1).astype(np.int64)


def features(texts: list[bytes | None], stated: list[int | None]):
    """Feature numbers and their rows: each distinct word of a text once, and one bin per statistic. Works on about half a megabyte at once."""
    joined = b"".join(t or b"" for t in texts)
    text = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
    begins = ends - np.diff(ends, prepend=0)
    start, stop = word_places(text, ends)
    first, last = np.searchsorted(start, begins), np.searchsorted(start, ends)
    row = np.repeat(np.arange(len(texts)), last - first)
    words = word_hashes(text, start, stop)

    def count(mask, low=begins, high=ends):
        total = np.append(0, np.cumsum(mask))
        return (total[high] - total[low]).astype(float)

    size, n_words = (ends - begins).astype(float), (last - first).astype(float)
    letter = ((text | 32) >= 97) & ((text | 32) <= 122)
    upper = (text >= 65) & (text <= 90)
    digit = (text >= 48) & (text <= 57)
    sign = (text > 32) & (text < 127) & ~letter & ~digit
    slot = (words % np.uint64(WORD_SLOTS)).astype(np.int64)
    pair = np.unique(row * WORD_SLOTS + slot)
    distinct = np.bincount(pair // WORD_SLOTS, minlength=len(texts)).astype(float)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    ends_in_sign = sign[stop - 1] & sign[np.maximum(stop - 2, 0)] & (stop - start > 1)
    per_byte, per_word = np.maximum(size, 1), np.maximum(n_words, 1)
    told = np.array([np.nan if s is None else float(s) for s in stated])
    shares = {
        "length": np.log2(size + 1) / 24,
        "words": np.log2(n_words + 1) / 20,
        "upper": count(upper) / np.maximum(count(letter), 1),
        "punctuation": count(sign) / per_byte,
        "digits": count(digit) / per_byte,
        "lines": count(text == 10) / per_word,
        "bars": count(text == 124) / per_word,
        "repeated": count(same, first, last) / per_word,
        "distinct": distinct / per_word,
        "word_length": size / per_word / 32,
        "marked": count(ends_in_sign, first, last) / per_word,
        "stated_length": np.log2(np.maximum(np.nan_to_num(told), 0) + 1) / 24,
    }
    at, of = [pair % WORD_SLOTS], [pair // WORD_SLOTS]
    for i, name in enumerate(STATISTICS):
        at.append(WORD_SLOTS + BINS * i + _bin(shares[name]))
        of.append(np.arange(len(texts)))
    at, of = np.concatenate(at), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    # Words share one unit of weight; each statistic has one of its own.
    weight = np.where(at < WORD_SLOTS, 1 / np.sqrt(np.maximum(distinct, 1))[of], 1.0)
    return at, of, weight


def margins(model, at, of, weight, n: int):
    """w0 + sum w x + 1/2 sum over factors of (sum v x)^2 - sum (v x)^2: linear in the number of features."""
    bias, linear, factors = model
    firsts = np.searchsorted(of, np.arange(n))
    x = factors[at] * weight[:, None]
    total = np.add.reduceat(x, firsts, axis=0)
    return bias + np.bincount(of, linear[at] * weight, n) + 0.5 * (total * total - np.add.reduceat(x * x, firsts, axis=0)).sum(1), total, x


def fit(at, of, weight, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.1, decay: float = 1e-5):
    """Adagrad on the logistic loss in a fixed order. The prior of label 1 starts the bias."""
    random = np.random.default_rng(1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, linear, factors = float(np.log(share / (1 - share))), np.zeros(SLOTS), random.normal(0, 0.05, (SLOTS, RANK))
    seen_linear, seen_factors = np.full(SLOTS, 1e-2), np.full((SLOTS, RANK), 1e-2)
    bounds = np.searchsorted(of, np.arange(len(labels) + 1))
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            lengths = bounds[rows + 1] - bounds[rows]
            where = np.repeat(bounds[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            a, w, o = at[where], weight[where], np.repeat(np.arange(len(rows)), lengths)
            margin, total, x = margins((bias, linear, factors), a, o, w, len(rows))
            error = (1 / (1 + np.exp(-margin)) - labels[rows]) / np.sqrt(len(rows))
            step = error[o] * w
            touched, back = np.unique(a, return_inverse=True)
            g = np.bincount(back, step, len(touched)) + decay * linear[touched]
            seen_linear[touched] += g * g
            linear[touched] -= rate * g / np.sqrt(seen_linear[touched])
            pull = step[:, None] * (total[o] - x)
            g = np.stack([np.bincount(back, pull[:, f], len(touched)) for f in range(RANK)], axis=1) + decay * factors[touched]
            seen_factors[touched] += g * g
            factors[touched] -= rate * g / np.sqrt(seen_factors[touched])
            bias -= rate * error.mean()
    return bias, linear.astype(np.float32), factors.astype(np.float32)


def _pieces(texts, most=1 << 19):
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def train(labelled: DataFrame, most: int = LEARNED):
    """Model from rows (doc_id, body, stated, label): features are made where the rows are, and one task fits them (at most ``most`` rows).

    None if there is no labelled row. The model, SLOTS x (1 + RANK) numbers, is all that reaches the driver.
    """

    def extract(batches):
        for batch in batches:
            texts, stated = batch["body"].to_pylist(), batch["stated"].to_pylist()
            for a, b in _pieces(texts):
                at, of, weight = features(texts[a:b], stated[a:b])
                cut = np.searchsorted(of, np.arange(1, b - a))
                blobs = [pack((x.astype(np.int32), w.astype(np.float32))) for x, w in zip(np.split(at, cut), np.split(weight, cut), strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], pa.array(blobs, pa.binary())], ["doc_id", "label", "blob"])

    def learn(rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("blob", "ascending")])
        pairs = [unpack(x) for x in rows["blob"].to_pylist()]
        at, weight = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        of = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
        return pa.table({"model": pa.array([pack(fit(at, of, weight.astype(float), np.array(rows["label"].to_pylist(), float)))], pa.binary())})

    sample = bounded(labelled, ["doc_id", "body"], most).mapInArrow(extract, "doc_id long, label int, blob binary")
    found = sample.withColumn("all_rows", F.lit(0)).groupBy("all_rows").applyInArrow(learn, "model binary").collect()
    return unpack(bytes(found[0]["model"])) if found else None


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stated_column: str = "n_chars", label_column: str = "quality", learned: int = LEARNED) -> DataFrame:
    """Probability of label 1 for every whole text: the id, ``held_out`` and ``score`` (0 to 1), one row per row of ``docs``.

    Inputs of a score are the text and the stated length (null or missing: none). Learns from at most ``learned`` rows that are not held
    out and have a label 0 or 1 (of repeated ids in ``labels``, the least label). Null texts count as empty and are scored by their
    structure; where nothing could be learned every score is 0.5. Null ids are scored and never learned from.
    """
    stated = F.col(stated_column).cast("long") if stated_column in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("body"), stated.alias("stated"))
    marks = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    # At most ``learned`` ids: broadcast, so that no text is shuffled to find its label.
    wanted = bounded(marks.filter(~held_out("doc_id")), ["doc_id"], learned)
    model = train(rows.join(F.broadcast(wanted), "doc_id"), learned)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            texts, told = batch["body"].to_pylist(), batch["stated"].to_pylist()
            scores = []
            for a, b in _pieces(texts):
                at, of, weight = features(texts[a:b], told[a:b])
                margin = margins(shared.value, at, of, weight.astype(np.float32), b - a)[0] if shared.value else np.zeros(b - a)
                scores += (1 / (1 + np.exp(-np.clip(margin, -30, 30)))).tolist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(score, "doc_id long, score double")
    return found.select(F.col("doc_id").alias(id_column), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score")


@query("op10_quality")
def op10_quality(spark, sf_dir):
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
