"""Clustering around centroids in integers: Walsh-Hadamard progressive search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

#: Rows looked at together, coefficients before the first elimination.
ROWS, FIRST = 4096, 8
#: Components below this in size keep every sum of squares of 64 coefficients within 64 bits; others are Python's integers.
EXACT = 1 << 24


def sequency(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix by the number of their sign changes, the smoothest first."""
    signs = walsh_hadamard(np.eye(size, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The transform of every row, a power of two long, exactly: sums and differences of halves, halved again."""
    out, n, width = rows.copy(), rows.shape[1], 1
    while width < n:
        pairs = out.reshape(len(out), n // (2 * width), 2, width)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), n)
        width *= 2
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every integer vector (ties: the smaller number), its squared distance, and how many coefficients were compared.

    The transform keeps distances up to the factor of its length, so the squared differences of the first coefficients are a lower
    bound. They are added from coarse to fine, in steps that double from 8; after each step a centroid that newly leads is carried to the end,
    and whatever is strictly above the least such distance already is out. What is left at the end is compared on all coefficients.
    """
    size = vectors.shape[1]
    order = sequency(size)
    x, c = walsh_hadamard(vectors)[:, order], walsh_hadamard(centroids)[:, order]
    n, k = len(x), len(c)
    row, at = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, x.dtype)
    best, leader = None, np.full(n, -1)
    done, compared = 0, 0
    while done < size:
        end = min(size, max(FIRST, 2 * done))
        for first in range(0, len(row), 1 << 16):
            some = slice(first, first + (1 << 16))
            apart = x[row[some], done:end] - c[at[some], done:end]
            part[some] += (apart * apart).sum(1)
        compared += len(row) * (end - done)
        done = end
        if done == size or not n:
            break
        # The pairs are in the order of the rows, so the sorted ones have every row's leader at its first place.
        lead = np.lexsort((part, row))[np.flatnonzero(np.append(True, row[1:] != row[:-1]))]
        new = np.flatnonzero(at[lead] != leader)
        whole = part[lead[new]]
        for first in range(0, len(new), 1 << 14):
            some = new[first : first + (1 << 14)]
            rest = x[some, done:] - c[at[lead[some]], done:]
            whole[first : first + (1 << 14)] += (rest * rest).sum(1)
        compared += len(new) * (size - done)
        leader = at[lead]
        if best is None:
            best = whole
        else:
            best[new] = np.minimum(best[new], whole)
        stays = part <= best[row]
        row, at, part = row[stays], at[stays], part[stays]
    lead = np.lexsort((at, part, row))
    lead = lead[np.append(True, row[lead][1:] != row[lead][:-1])] if len(lead) else lead
    return at[lead], part[lead] // size, compared


def integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, in 64 bits or, for components that need it, in Python's integers."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, size)
    if not values.size or np.abs(values).max() < EXACT:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values.tolist()], object).reshape(-1, size)


def centroid_clusters(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of integer vectors after ``rounds`` rounds: (vec_id, cluster, distance, cluster_inertia, inertia), and the centroids.

    Components become floor(scale * x), x as double. Vectors that are null, have not exactly ``size`` (a power of two) components,
    or hold null or non-finite ones take no part. Centroids start as the ``k`` vectors with the smallest sha256 of
    ``<seed>:<id>``; rows without an id come last there, equal hashes in the order of the vectors, and fewer than ``k`` vectors give
    as many centroids. Each round assigns every vector to its nearest centroid (ties: the smaller number) and replaces every centroid
    that has vectors by their floor of the mean. Repeated rows and ids count each; rows without an id are clustered too. Extra columns are
    ignored; an empty table gives no rows. Components of 2**18 and more are exact as well; a distance beyond 64 bits is an error.

    Every pass is narrow: k x size integers go out, at most k rows of sums per task come back.
    """
    spark = vectors.sparkSession
    component = F.col("v")
    sound = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == size) & sound)
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = hashed.orderBy(F.asc_nulls_last("hash"), "v").limit(k).select("v").collect()
    centroids = [[int(np.floor(x * scale)) for x in r["v"]] for r in first]

    def matrix(values):
        top = max((abs(v) for c in values for v in c), default=0)
        return np.array(values, np.int64 if top < EXACT else object).reshape(-1, size)

    def assigned(batch, centres):
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            v = integers(part["v"], size, scale)
            c = centres if v.dtype == centres.dtype else centres.astype(object)
            v = v if v.dtype == c.dtype else v.astype(object)
            yield part, v, *nearest(v, c)[:2]

    def sums(shared):
        def run(batches):
            n, total, spent = {}, {}, {}
            for batch in batches:
                for _, v, cluster, distance in assigned(batch, matrix(shared.value)):
                    for j in np.unique(cluster).tolist():
                        mine = cluster == j
                        n[j] = n.get(j, 0) + int(mine.sum())
                        total[j] = total.get(j, 0) + v[mine].sum(0).astype(object)
                        spent[j] = spent.get(j, 0) + sum(distance[mine].tolist())
            keys = sorted(n)
            # Sums as texts of decimal digits: a task's own are small, the table's may pass 64 bits.
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([n[j] for j in keys], pa.int64()), pa.array([[str(x) for x in (*total[j], spent[j])] for j in keys], pa.list_(pa.string()))],
                ["cluster", "n", "sums"],
            )

        return run

    def gathered(centres):
        """Members, sums of the components and sum of the distances of every cluster."""
        shared = spark.sparkContext.broadcast(centres)
        found = rows.select("v").mapInArrow(sums(shared), "cluster int, n long, sums array<string>")
        summed = F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size + 1)))
        out = {r["cluster"]: (r["n"], [int(x) for x in r["sums"]]) for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), summed.alias("sums")).collect()}
        shared.unpersist()
        return out

    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long").withColumnRenamed("vec_id", id_column), []
    for _ in range(rounds):
        held = gathered(centroids)
        centroids = [[s // held[j][0] for s in held[j][1][:size]] if j in held else c for j, c in enumerate(centroids)]
    held = gathered(centroids)
    inertia = [held[j][1][size] if j in held else 0 for j in range(len(centroids))]
    shared = spark.sparkContext.broadcast(centroids)

    def close(batches):
        for batch in batches:
            for part, _, cluster, distance in assigned(batch, matrix(shared.value)):
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(cluster.tolist(), pa.int32()), pa.array(distance.tolist(), pa.int64()), pa.array([inertia[j] for j in cluster.tolist()], pa.int64())],
                    [id_column, "cluster", "distance", "cluster_inertia"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(close, f"`{id_column}` {kind}, cluster int, distance long, cluster_inertia long").withColumn("inertia", F.lit(sum(inertia)).cast("long")), centroids


def centroid_sha256(centroids: list[list[int]], cluster: str | Column = "cluster") -> Column:
    """Lowercase hex sha256 of the components of a row's centroid, as decimal integers joined by commas."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col(cluster) if isinstance(cluster, str) else cluster
    return F.get(F.array(*map(F.lit, digests)), at) if digests else F.lit(None).cast("string")


def _rounds(last: int) -> str:
    """DuckDB statements of the rounds: a<i> assigns to c<i>, c<i + 1> are the new centroids."""
    out = []
    for i in range(last + 1):
        out.append(f"""d{i} as materialized (select v.row, c.cluster, cast(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as distance from v, c{i} c),
a{i} as materialized (select row, cluster, distance from (select *, row_number() over (partition by row order by distance, cluster) as place from d{i}) where place = 1)""")
        if i < last:
            out.append(f"""s{i} as (select a.cluster, t.i, cast(sum(v.e[t.i]) as bigint) as total, count(*) as n from a{i} a join v using (row), range(1, 65) t(i) group by a.cluster, t.i),
c{i + 1} as materialized (select c.cluster, coalesce(m.e, c.e) as e from c{i} c left join
 (select cluster, list(cast((total - ((total % n) + n) % n) // n as bigint) order by i) as e from s{i} group by cluster) m using (cluster))""")
    return ",\n".join(out)


CHECK = f"""
with v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
 where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select cast(row_number() over (order by h nulls last, e) - 1 as int) as cluster, e from
 (select sha256('1:' || vec_id) as h, e from v order by h nulls last, e limit 16)),
{_rounds(3)}
select v.vec_id, a.cluster, a.distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia,
 sha256(array_to_string(list_transform(c.e, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from a3 a join v using (row) join c3 c using (cluster)"""


@query("op12_centroid_clusters", CHECK)
def op12_centroid_clusters(spark, sf_dir):
    rows, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", centroid_sha256(centroids))
