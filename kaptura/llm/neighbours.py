"""Nearest vectors by stable projections, kd-trees over them and a chi-square test that ends a search.

A vector is projected on a few random directions of normal numbers, so a squared projected distance
is the true one times a chi-square number. Points are verified in the order of projected distance;
once the next one's is beyond the square of the k-th true distance times the quantile ``sure``, a
nearer vector has stayed behind with a probability of at most 1 - sure, and the search ends.

Spark holds the index: the upper levels of a kd-tree, fitted on ``SAMPLE`` rows at most, deal all rows
to cells, and a cell of many rows (copies can't be parted by a cut) to blocks of about ``block_rows``.
A query first searches one block of its own cell, which bounds its k-th distance; then all blocks of
the cells whose box the test doesn't exclude. Within a block a kd-tree gives the points in order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kaptura.llm.common import stored
from kaptura.llm.vectors import by_length, finite, lists

#: Rows that the upper levels of the tree are fitted on at most, and the cells that they can make.
SAMPLE, MOST_CELLS = 16_384, 2_048
#: Points of a leaf of a block's tree.
LEAF = 64
#: Queries that a task gets at once.
ASKED = 4_096
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, freedom: int) -> float:
    """Where the chi-square distribution of an even number of degrees of freedom reaches ``p``."""
    if freedom % 2 or not 0 < p < 1:
        raise ValueError("an even number of degrees and a probability within 0 and 1 are needed")

    def beyond(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return total

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > 1 - p else (low, mid)
    return high


def directions(n: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, n]).standard_normal((n, m))


def project(x: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Projections added up component by component, so that equal vectors have equal ones to the last bit."""
    out = np.zeros((len(x), m))
    for column, weights in zip(x.T, directions(x.shape[1], m, seed), strict=True):
        out += column[:, None] * weights
    return out


class Cuts(NamedTuple):
    """A full binary tree of cuts in heap order; cell of a point: the path it takes."""

    axis: np.ndarray
    at: np.ndarray

    @classmethod
    def fitted(cls, points: np.ndarray, depth: int) -> Cuts:
        """Medians of the widest axis, level by level."""
        axis, at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        cells: dict[int, np.ndarray] = {1: np.arange(len(points))}
        for node in range(1, 1 << depth):
            rows = cells.pop(node)
            if len(rows):
                own = points[rows]
                axis[node] = np.argmax(own.max(0) - own.min(0))
                at[node] = np.median(own[:, axis[node]])
            right = points[rows, axis[node]] > at[node]
            cells[2 * node], cells[2 * node + 1] = rows[~right], rows[right]
        return cls(axis, at)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(int(math.log2(len(self.axis)))):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


class Tree:
    """kd-tree of a block's projected points; gives them in order of their distance to a query."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.below: list[tuple[int, int] | None] = []
        todo = [self._node(0, len(points))] if len(points) else []
        while todo:
            node = todo.pop()
            a, b = self.span[node]
            if b - a > LEAF and (self.high[node] > self.low[node]).any():
                own = self.order[a:b]
                column = points[own, np.argmax(self.high[node] - self.low[node])]
                mid = (b - a) // 2
                self.order[a:b] = own[np.argpartition(column, mid)]
                self.below[node] = (self._node(a, a + mid), self._node(a + mid, b))
                todo += self.below[node]

    def _node(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.span.append((a, b))
        self.below.append(None)
        return len(self.span) - 1

    def _away(self, q: np.ndarray, node: int) -> float:
        off = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return float((off * off).sum())

    def nearest_first(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(points, their squared distances, what all later ones are at least away) in rising order."""
        queue = [(self._away(q, 0), 0)] if self.span else []
        held, away = np.zeros(0, np.int64), np.zeros(0)
        while queue:
            _, node = heapq.heappop(queue)
            if self.below[node]:
                for child in self.below[node]:
                    heapq.heappush(queue, (self._away(q, child), child))
                continue
            a, b = self.span[node]
            new = self.order[a:b]
            held = np.concatenate((held, new))
            away = np.concatenate((away, ((self.points[new] - q) ** 2).sum(1)))
            bound = queue[0][0] if queue else math.inf
            ready = np.flatnonzero(away <= bound)
            ready = ready[np.argsort(away[ready], kind="stable")]
            yield held[ready], away[ready], bound
            rest = away > bound
            held, away = held[rest], away[rest]


class Block:
    """Rows of one length with their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        self.ids, self.vectors, self.tree = ids, vectors, Tree(points)
        self.verified = 0

    def search(self, own: int, q: np.ndarray, p: np.ndarray, k: int, limit: float, kth: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, without the query's own id, an id's nearest row
        only; ``kth``: a bound of the k-th distance that is known already, ``limit``: the quantile."""
        ids, score = np.zeros(0, np.int64), np.zeros(0)
        for rows, away, bound in self.tree.nearest_first(p):
            rows = rows[(away <= limit * kth * kth) & (self.ids[rows] != own)]
            self.verified += len(rows)
            d = np.sqrt(((self.vectors[rows] - q) ** 2).sum(1))
            new = d <= kth
            if new.any():
                ids, score = np.concatenate((ids, self.ids[rows[new]])), np.concatenate((score, d[new]))
                order = np.lexsort((ids, score))
                ids, score = ids[order], score[order]
                first = np.sort(np.unique(ids, return_index=True)[1])[:k]
                ids, score = ids[first], score[first]
                if len(ids) == k:
                    kth = min(kth, float(score[-1]))
            if bound > limit * kth * kth:
                break
        return ids, score


class Index(NamedTuple):
    """Rows with their cells; box and number of blocks of each cell, MOST_CELLS at most."""

    rows: DataFrame
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the block of their cell that their row number falls to."""
        blocks = rows.sparkSession.createDataFrame([(c, int(b)) for c, b in enumerate(self.blocks) if b], "cell int, blocks int")
        return rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("blocks")


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and the components as doubles, of the rows that take part: an id, and a vector that is
    not null, empty, zero or holding null or non-finite components."""
    found = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    return found.filter(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))


def build_index(vectors: DataFrame, m: int, block_rows: int, seed: int) -> Index:
    """All rows of ``usable``, written with their cell."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    parts = [project(x, m, seed) for _, x in by_length(sample.column(0).combine_chunks())] if sample.num_rows else []
    points = np.concatenate(parts) if parts else np.zeros((0, m))
    cells = min(n / block_rows, MOST_CELLS, len(points) / 4)
    cuts = Cuts.fitted(points, max(0, math.ceil(math.log2(max(1, cells)))))
    schema = f"vec_id long, v array<double>, p array<double>, cell int, {', '.join(f'p{i} double' for i in range(m))}"
    names = ["vec_id", "v", "p", "cell", *(f"p{i}" for i in range(m))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, m))
            for rows, x in by_length(batch.column(1)):
                p[rows] = project(x, m, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(p, pa.float64()), pa.array(cuts.cell(p), pa.int32()), *(pa.array(p[:, i]) for i in range(m))], names=names)

    rows = stored(vectors.mapInArrow(place, schema).withColumn("row", F.monotonically_increasing_id()), "vectors")
    ends = [f(f"p{i}") for f in (F.min, F.max) for i in range(m)]
    known = {r[0]: r[1:] for r in rows.groupBy("cell").agg(F.count("*"), *ends).collect()}
    low, high, blocks = np.full((len(cuts.axis), m), np.inf), np.full((len(cuts.axis), m), np.inf), np.zeros(len(cuts.axis), np.int64)
    for cell, (count, *box) in known.items():
        low[cell], high[cell], blocks[cell] = box[:m], box[m:], -(-count // block_rows)
    return Index(rows.select("row", "vec_id", "v", "p", "cell"), low, high, blocks)


def _searched(index: Index, asked: DataFrame, k: int, limit: float, chunks: int) -> DataFrame:
    """row, query_id, vec_id and score of what each (query, block) finds; ``asked``: row, vec_id, v, p, kth, cell, block."""
    data = index.placed(index.rows).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))

    def matrices(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        t = t.combine_chunks()
        v, p = (t.column(c).combine_chunks() for c in ("v", "p"))
        if t.num_rows:
            points = next(by_length(p))[1]
            for rows, x in by_length(v):
                yield rows, np.asarray(t.column("vec_id"))[rows], x, points[rows]

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        if own.num_rows and asking.num_rows:
            made = {x.shape[1]: Block(ids, x, p) for _, ids, x, p in matrices(own)}
            row, kth = np.asarray(asking.column("row")), np.asarray(asking.column("kth"))
            for rows, ids, x, p in matrices(asking):
                if block := made.get(x.shape[1]):
                    out += [(row[r], ids[i], *block.search(ids[i], x[i], p[i], k, limit, kth[r])) for i, r in enumerate(rows)]
        n = [len(x[2]) for x in out]
        columns = [np.repeat(np.array([x[j] for x in out], np.int64), n) for j in (0, 1)]
        columns += [np.concatenate([np.zeros(0, kind), *(x[j] for x in out)]) for j, kind in ((2, np.int64), (3, np.float64))]
        return pa.table(columns, names=["row", "query_id", "vec_id", "score"])

    keys = ("cell", "block", "chunk")
    return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, f"row long, {FOUND}")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, m: int = 8, sure: float = 0.99, block_rows: int = 4_096, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest vectors found for each id divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without an id, which nothing could name. Vectors are compared with those of as many components.
    Several rows of one id count as one, by their smallest distance; equal distances go by the smaller
    id. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    limit = chi_square_quantile(sure, m)
    index = build_index(usable(vectors, key, vector), m, block_rows, seed)
    low, high, blocks = index.low, index.high, index.blocks
    queries = stored(index.rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), "asked")
    chunks = max(1, -(-queries.count() // ASKED))
    first = index.placed(queries).withColumn("kth", F.lit(math.inf))
    near = stored(_searched(index, first, k, limit, chunks), "near")
    bounds = near.groupBy("row").agg(F.when(F.count("*") == k, F.max("score")).otherwise(math.inf).alias("kth"))
    asked = queries.drop("cell").join(bounds, "row", "left").fillna({"kth": math.inf})
    names = ["row", "vec_id", "v", "p", "kth", "cell", "block"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kth, p = np.asarray(batch.column(4)), next(by_length(batch.column(3)))[1]
            for i in range(batch.num_rows):
                off = np.maximum(np.maximum(low - p[i], p[i] - high), 0)
                cells = np.flatnonzero(((off * off).sum(1) <= limit * kth[i] * kth[i]) & (blocks > 0))
                cell = np.repeat(cells, blocks[cells])
                block = np.arange(len(cell)) - np.repeat(np.cumsum(blocks[cells]) - blocks[cells], blocks[cells])
                same = batch.slice(i, 1).take(pa.array(np.zeros(len(cell), np.int64)))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(cell, pa.int32()), pa.array(block, pa.int32())], names=names)

    routed = asked.select("row", "vec_id", "v", "p", "kth").mapInArrow(route, "row long, vec_id long, v array<double>, p array<double>, kth double, cell int, block int")
    found = _searched(index, routed, k, limit, chunks).unionByName(near).repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
