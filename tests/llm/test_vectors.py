"""Nearest neighbours and centroids against brute force, on odd vectors and skewed tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kaptura.llm import centroids, neighbours
from kaptura.llm.common import table

ODD = [(1, None), (2, []), (3, [0.0] * 64), (4, [math.nan] + [1.0] * 63), (5, [math.inf] + [1.0] * 63), (6, [None] + [1.0] * 63)]
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=100, k=10):
    """Every id's smallest distances, by comparing all rows."""
    found = []
    for own, q in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        for i, v in rows:
            if i != own and len(v) == len(q):
                found.append((own, i, float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum()))))
    best = {}
    for own, i, d in found:
        best[own, i] = min(d, best.get((own, i), math.inf))
    out = []
    for own in {o for o, _ in best}:
        near = sorted((d, i) for (o, i), d in best.items() if o == own)[:k]
        out += [(own, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_quantile():
    for p, freedom, value in ((0.95, 2, 5.991465), (0.99, 8, 20.090235), (0.5, 4, 3.356694)):
        assert abs(neighbours.chi_square_quantile(p, freedom) - value) < 1e-5
    for p, freedom in ((0.9, 3), (1.0, 8)):
        with pytest.raises(ValueError):
            neighbours.chi_square_quantile(p, freedom)


def test_tree_gives_points_in_order():
    rng = np.random.default_rng(1)
    points = np.concatenate((rng.standard_normal((500, 8)), np.ones((300, 8)), np.repeat(rng.standard_normal((20, 8)), 10, 0)))
    tree = neighbours.Tree(points)
    for q in (points[0], np.ones(8), rng.standard_normal(8) * 5):
        got, last = [], -1.0
        for rows, away, bound in tree.nearest_first(q):
            assert (np.diff(away) >= 0).all() and (not len(away) or (away[0] >= last and away[-1] <= bound))
            last = bound
            got += away.tolist()
        assert np.allclose(got, np.sort(((points - q) ** 2).sum(1)))
    assert list(neighbours.Tree(np.zeros((0, 8))).nearest_first(np.zeros(8))) == []


def test_equal_vectors_have_equal_projections():
    x = np.random.default_rng(2).standard_normal((1000, 64))
    alone = np.concatenate([neighbours.project(x[i : i + 1], 8, 7) for i in range(0, 1000, 97)])
    assert (alone == neighbours.project(x, 8, 7)[::97]).all()


def clustered(n=3000, seed=3):
    """A third of the rows are copies of one vector, a third is near another, ids repeat here and there."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    x[: n // 3] = x[0]
    x[n // 3 : 2 * n // 3] = x[n // 3] + 0.01 * x[n // 3 : 2 * n // 3]
    order = rng.permutation(n)
    return [(int(i), v.tolist()) for i, v in zip(order, x, strict=True)] + [(int(order[7]), x[7].tolist()), (int(order[-1]), x[5].tolist())]


def test_nearest_equals_brute_force_where_the_test_is_sure(spark):
    rows = clustered()
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), sure=1 - 1e-12, block_rows=128)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = sorted(tuple(r) for r in got.collect()), brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_recall_and_work(spark, sf_dir):
    data = table(spark, sf_dir.replace("0.001", "0.1"), "embeddings")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    want = {r[:3:2] for r in brute(rows)}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(data, block_rows=256).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.97 * len(want)
    x = np.array([v for _, v in clustered()])
    block = neighbours.Block(np.arange(len(x)), x, neighbours.project(x, 8, 7))
    block.search(-1, x[-1], neighbours.project(x[-1:], 8, 7)[0], 10, neighbours.chi_square_quantile(0.99, 8))
    assert block.verified < len(x)
    near = neighbours.Block(np.arange(len(x)), x, neighbours.project(x, 8, 7))
    near.search(-1, x[1500], neighbours.project(x[1500:1501], 8, 7)[0], 10, neighbours.chi_square_quantile(0.99, 8))
    assert near.verified < len(x) / 2


def test_fewer_candidates_odd_vectors_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (100, [1.0, 2.0, 3.0]), (8, [1.0, 0.0])]
    odd = [(None, [1.0, 0.0]), *ODD]
    data = spark.createDataFrame([(*r, "clash") for r in rows + odd], SCHEMA + ", v string").withColumns({c: F.lit(1) for c in ("row", "cell", "block", "p", "score", "kth")})
    assert sorted(tuple(r) for r in neighbours.nearest(data).collect()) == [(0, 1, 8, 0.0), (0, 2, 7, math.sqrt(2))]
    assert neighbours.nearest(data.limit(0)).collect() == []
    assert neighbours.nearest(data.filter("vec_id < 7 and vec_id > 0")).collect() == []


def lloyd(rows, k, rounds):
    """Every round with all differences, in Python's integers."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in starts[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            if own := [x for (_, x), (_, a) in zip(kept, at, strict=True) if a == j]:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    by = [sum(d for d, a in at if a == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), a, d, by[a], sum(by), digest[a]) for (i, _), (d, a) in zip(kept, at, strict=True))


def told(got):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64))
    x[:100] = x[0]
    x[100:120] = x[100]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(3, x[0].tolist()), (3, x[150].tolist()), (None, x[151].tolist())]
    data = spark.createDataFrame(rows + ODD[:2] + ODD[3:] + [(9, [1.0] * 63), (10, [1e30] * 64)], SCHEMA).withColumns({c: F.lit(1) for c in ("x", "cluster", "n", "sums")})
    assert told(centroids.cluster(data.repartition(4), k=12, rounds=3)) == lloyd(rows, 12, 3)
    few = rows[:5]
    assert told(centroids.cluster(spark.createDataFrame(few, SCHEMA), k=12, rounds=2)) == lloyd(few, 12, 2)
    assert centroids.cluster(data.limit(0)).collect() == []
    assert centroids.cluster(data.filter("vec_id = 1").limit(1)).first().distance == 0


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(6)
    scale = np.linspace(300, 1, 64)
    x = (rng.standard_normal((500, 64)) * scale).astype(np.int64)
    c = np.concatenate((x[:20], x[5:8], (rng.standard_normal((17, 64)) * scale).astype(np.int64)))
    at, distance, taken = centroids.nearest_centroids(x, c, np.argsort(-x.var(0)))
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (at == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert taken < 0.6 * whole.size * 64
    far = np.full((1, 64), centroids.MOST - 1)
    assert centroids.nearest_centroids(far, -far, np.arange(64))[1][0] == 64 * (2 * (centroids.MOST - 1)) ** 2
