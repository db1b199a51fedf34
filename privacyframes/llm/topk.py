"""Exact top-k by inner product over integer vectors: pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table

#: Pivots, rows they are chosen from, rows of a candidate block and of a query block, candidate blocks that a task looks at.
PIVOTS, CHOICE, BLOCK, QUERIES, SHARE = 48, 1024, 4096, 512, 8


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(len(column), -1)


def _exact(vectors: np.ndarray):
    """Vectors in a type whose sums of products are exact: floats below 2**53, else Python's integers below their own limit (none)."""
    top = float(np.abs(vectors.astype(float)).max(initial=0))
    return vectors.astype(np.float64) if top * top * max(1, vectors.shape[1]) < 2**52 else vectors.astype(object)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = vectors.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def far_apart(vectors: list[list[int]], n: int) -> list[list[int]]:
    """``n`` of some vectors of one length or several: the first, then always the one farthest from all chosen so far."""
    out = []
    for length in sorted({len(v) for v in vectors}):
        mine = np.array([v for v in vectors if len(v) == length], float)
        near, at = np.full(len(mine), np.inf), 0
        for _ in range(min(n, len(mine))):
            out.append([int(x) for x in mine[at]])
            near = np.minimum(near, ((mine - mine[at]) ** 2).sum(1))
            at = int(near.argmax())
    return out


def best_of_block(queries, query_ids, query_table, vectors, ids, distances, k: int, held=None):
    """Each query's k best of one block and of what it ``held`` before, exactly: a list of (scores, ids), ties to smaller ids.

    |d(q,p) - d(x,p)| over all pivots p gives the largest lower bound of the distance of q and x, hence an upper bound of their inner
    product. Candidates are evaluated in the order of that bound, in steps that double, until it falls under the k-th score found.
    Also returns how many candidates were evaluated.
    """
    exact_q, exact_x = _exact(queries), _exact(vectors)
    if exact_q.dtype != exact_x.dtype:
        exact_q, exact_x = queries.astype(object), vectors.astype(object)
    norm_q = (queries.astype(float) ** 2).sum(1)
    norm_x = (vectors.astype(float) ** 2).sum(1)
    out, evaluated = [], 0
    for i in range(len(queries)):
        lower = np.abs(distances - query_table[i]).max(axis=1) if distances.shape[1] else np.zeros(len(vectors))
        bound = (norm_q[i] + norm_x - lower * lower) / 2
        # Rounding of the distances must not lower a bound.
        bound += 1e-9 * (norm_q[i] + norm_x) + 1e-6 * (1 + lower)
        found_score, found_id = held[i] if held else (np.zeros(0), np.zeros(0, np.int64))
        if len(found_score) == k:
            some = np.flatnonzero(bound >= float(found_score[-1]))
            order = some[np.argsort(-bound[some])]
        else:
            order = np.argsort(-bound)
        order = order[ids[order] != query_ids[i]]
        done, step = 0, 64
        while done < len(order):
            if len(found_score) == k and bound[order[done]] < float(found_score[-1]):
                break
            at = order[done : done + step]
            score = exact_x[at] @ exact_q[i]
            # Floats here are whole numbers below 2**53; with larger ones around, all are Python's integers.
            if score.dtype != found_score.dtype and len(found_score):
                score, found_score = (np.array([int(x) for x in y], object) for y in (score, found_score))
            found_score, found_id = (np.concatenate((found_score, score)) if len(found_score) else score), np.concatenate((found_id, ids[at]))
            top = np.lexsort((found_id, -found_score))[:k]
            found_score, found_id = found_score[top], found_id[top]
            evaluated += len(at)
            done, step = done + step, step * 2
        out.append((found_score, found_id))
    return out, evaluated


def exact_top_k(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """The k rows with the highest integer inner product for every row where ``is_query`` holds: query_id, rank, vec_id, score.

    Components become floor(scale * x) with x as double. Rows whose id or vector is null, and vectors that are empty or hold null or
    non-finite components, take no part; only vectors of the same length are compared. A query's own id is no candidate. Queries with the same id
    count once (the least vector). Ties go to the smaller id; repeated rows are candidates each, except in all columns equal ones. Extra
    columns are ignored; an empty table gives no rows.

    Every block of candidates carries its table of distances to ``pivots`` rows (far apart among some chosen by a hash; broadcast: pivots x
    length numbers). Candidate blocks are dealt into shares of about eight, and every block of queries meets every share once: its best
    scores go on from block to block, and only k rows per query and share leave a task.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall(F.col(vector_column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column), F.coalesce(is_query, F.lit(False)).alias("asked"))
        .filter(F.col("id").isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0) & sound)
        .select("id", "asked", whole.alias("v"), F.size(vector_column).alias("length"))
    )
    sample = rows.orderBy(F.xxhash64("id"), "v").limit(CHOICE).select("v").collect() if pivots else []
    chosen = spark.sparkContext.broadcast(far_apart([r["v"] for r in sample], pivots))

    def blocks(size):
        def build(batches):
            held: dict[int, list] = {}

            def close(length, parts):
                ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                own = np.array([p for p in chosen.value if len(p) == length], np.int64).reshape(-1, length)
                near = _distances(v, own)
                return pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "v": [v.tobytes()], "near": [near.tobytes()]}, schema=kind)

            for batch in batches:
                lengths = np.array(batch["length"].to_pylist())
                for length in np.unique(lengths).tolist():
                    mine = batch.filter(pa.array(lengths == length))
                    for first in range(0, mine.num_rows, size):
                        part = mine.slice(first, size)
                        parts = held.setdefault(length, [])
                        parts.append((np.array(part["id"].to_pylist(), np.int64), _matrix(part["v"])))
                        if sum(len(p[0]) for p in parts) >= size:
                            yield close(length, held.pop(length))
            for length, parts in held.items():
                yield close(length, parts)

        return build

    kind = pa.schema([("length", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("near", pa.binary())])
    ddl = "length int, n int, ids binary, v binary, near binary"
    asked = rows.filter("asked").groupBy("id").agg(F.min(F.struct("length", "v")).alias("x")).select("id", "x.v", "x.length")
    asked = asked.mapInArrow(blocks(QUERIES), ddl).select(*(F.col(c).alias(f"q_{c}") for c in ("length", "n", "ids", "v", "near")))
    held = rows.select("id", "v", "length").mapInArrow(blocks(BLOCK), ddl)
    shares = max(1, -(-rows.count() // (BLOCK * SHARE)))
    dealt = held.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    sent = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumnRenamed("q_length", "length")
    # The queries are the streamed side, so the candidate blocks of a share come one after the other for each block of queries.
    pairs = sent.join(dealt, ["share", "length"])

    def evaluate(batches):
        now, best = None, None

        def rows_of(ids, found):
            out = [(int(q), int(x), int(s)) for q, (scores, own) in zip(ids, found, strict=True) for x, s in zip(own, scores, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                get = lambda name, n, kind, r=r: np.frombuffer(r[name], kind).reshape(n, -1)
                n, m = r["n"], r["q_n"]
                ids = np.frombuffer(r["q_ids"], np.int64)
                if now is not None and now != r["q_ids"]:
                    yield rows_of(np.frombuffer(now, np.int64), best)
                    now = None
                if now is None:
                    now, best = r["q_ids"], None
                best, _ = best_of_block(get("q_v", m, np.int64), ids, get("q_near", m, float) if r["q_near"] else np.zeros((m, 0)), get("v", n, np.int64), np.frombuffer(r["ids"], np.int64), get("near", n, float) if r["near"] else np.zeros((n, 0)), k, best)
        if now is not None:
            yield rows_of(np.frombuffer(now, np.int64), best)

    found = pairs.mapInArrow(evaluate, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


CHECK = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
 where vec_id is not null and embedding is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
 from v q join v c on q.vec_id != c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""


@query("op8_exact_top_k", CHECK)
def op8_exact_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, F.col("vec_id") % 50 == 0)
