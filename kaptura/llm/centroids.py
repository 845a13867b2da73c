"""Centroid clustering of integer vectors: Lloyd's rounds with a partial-distance search.

All numbers are integers, so a round gives the same centroids however Spark deals the rows. Squared
differences are added up over the components in order of falling variance, some at a time; a centroid
whose part exceeds the best whole distance so far is abandoned, what survives gets all components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import stored
from kaptura.llm.vectors import by_length, finite, lists

#: Components are below this, so that squared distances of 64 of them stay within 64 bits.
MOST = 1 << 27
#: Components that are added up between two looks at the best distance, and the rows looked at together.
STEPS, ROWS = (8, 8, 16, 32), 2_048


def nearest_centroids(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, differences taken) of every row; ties go to the smaller number.

    ``order``: the components, those of high variance first. The first centroid that a row measures
    in full is the best by the first components; the others stay while their part is not above it.
    """
    n, k = len(x), len(centroids)
    x, centroids = x[:, order], centroids[:, order]
    ends = [min(e, x.shape[1]) for e in np.cumsum(STEPS)]
    ends = [*dict.fromkeys([*ends, x.shape[1]])]
    part = np.zeros((n, k), np.int64)
    for j in range(ends[0]):
        part += (x[:, j : j + 1] - centroids[None, :, j]) ** 2
    taken = n * k * ends[0]
    rows, best_at = np.arange(n), part.argmin(1)
    best = part[rows, best_at] + ((x[:, ends[0] :] - centroids[best_at, ends[0] :]) ** 2).sum(1)
    row, at = np.nonzero(part <= best[:, None])
    sums = part[row, at]
    for a, b in zip(ends, ends[1:], strict=False):
        taken += len(row) * (b - a)
        sums = sums + ((x[row, a:b] - centroids[at, a:b]) ** 2).sum(1)
        stays = sums <= best[row]
        row, at, sums = row[stays], at[stays], sums[stays]
    order = np.lexsort((at, sums, row))
    row, at, sums = row[order], at[order], sums[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return at[first], sums[first], taken


def _assigned(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = [nearest_centroids(x[i : i + ROWS], centroids, order) for i in range(0, len(x), ROWS)]
    return np.concatenate([np.zeros(0, np.int64), *(g[0] for g in got)]), np.concatenate([np.zeros(0, np.int64), *(g[1] for g in got)])


def whole_vectors(vectors: DataFrame, dims: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and ``x``, floor(scale * component), of the vectors that are kept.

    Kept are those of exactly ``dims`` components, none null or non-finite. One that holds a component
    of MOST or more after scaling is left out too: its squared distances would leave 64 bits.
    """
    found = vectors.select(vectors[key].alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    kept = found.filter((F.size("v") == dims) & finite(F.col("v"))).filter(F.forall("v", lambda c: F.abs(c) < MOST / scale))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept.

    Centroids start as the kept vectors of the smallest SHA-256 of ``seed``:id; a null id has none and
    comes last, equal ids go by their components. Fewer than ``k`` vectors give fewer centroids; equal
    centroids leave the later one empty, and an empty one stays where it is. Repeated rows are rows of
    their own. An inertia beyond 64
    bits is null. An empty table gives an empty one; other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, dims, scale, key, vector), "integers")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r.x for r in starts], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spread = rows.agg(*(F.var_pop(F.col("x")[i].cast("double")) for i in range(dims))).first()
    order = np.argsort(-np.array(spread), kind="stable")
    for _ in range(rounds):
        centroids = _moved(rows, centroids, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column(1)):
                at, distance = _assigned(x.astype(np.int64), centroids, order)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    done = stored(rows.mapInArrow(assign, rows.select("vec_id").schema.add("cluster", "integer").add("distance", "long")), "assigned")
    sums = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    long = lambda n: n if n < 1 << 63 else None
    known = spark.createDataFrame([(c, long(s), long(sum(sums.values())), texts[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means: sums of each batch, added up by Spark, k * dims of them."""
    k, dims = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                x = x.astype(np.int64)
                at, _distance = _assigned(x, centroids, order)
                by_cluster = np.argsort(at, kind="stable")
                there, first = np.unique(at[by_cluster], return_index=True)
                sums[there] += np.add.reduceat(x[by_cluster], first, axis=0)
                counts += np.bincount(at, minlength=k)
            if counts.sum() >= MOST:
                yield _partial(sums, counts)
                sums, counts = np.zeros_like(sums), np.zeros_like(counts)
        yield _partial(sums, counts)

    parts = rows.select("x").mapInArrow(add_up, "cluster int, n long, sums array<long>").filter("n > 0")
    long = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    exact = long.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    moved = centroids.copy()
    for r in exact.collect():
        moved[r.cluster, r.i] = int(r.s) // r.n
    return moved


def _partial(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts), lists(sums, pa.int64())], names=["cluster", "n", "sums"])


_ROUND = """d{i} AS (SELECT v.row, v.x, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM kept v, c{i} c),
a{i} AS (SELECT row, any_value(x) AS x, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance FROM d{i} GROUP BY row),
"""
_MOVE = """m{i} AS (SELECT cluster, list_transform(range(1, 65), lambda i: ((list_sum(list_transform(xs, lambda x: x[i])) - (list_sum(list_transform(xs, lambda x: x[i])) % n + n) % n) // n)::BIGINT) AS x FROM (SELECT cluster, list(x) AS xs, count(*) AS n FROM a{i} GROUP BY cluster)),
c{j} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster)),
"""
#: The production parameters' rounds, written out.
ORACLE = (
    """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1)::INTEGER AS cluster, x FROM kept ORDER BY sha256('2:' || vec_id), x LIMIT 40),
"""
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(5))
    + _ROUND.format(i=5).replace("d5 AS (", "d5 AS MATERIALIZED (")
    + """s AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a5 GROUP BY cluster)
SELECT k.vec_id, a.cluster, a.distance::BIGINT AS distance, s.cluster_inertia, (SELECT sum(distance)::BIGINT FROM a5) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a5 a JOIN kept k USING (row) JOIN c5 c USING (cluster) JOIN s USING (cluster)"""
)
