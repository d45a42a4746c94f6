"""Approximate nearest neighbours by inner product: low-dimensional stable projections under a kd-tree.

A vector of length l gets one more component, sqrt(L^2 - l^2) for the greatest length L, and a query a 0:
then the largest inner product is the smallest Euclidean distance. Gaussian (2-stable) projections to DIMS
dimensions turn a distance d into d^2 times a chi-square variable, so a row whose projection is farther from the
query's than d^2 times the variable's CONFIDENCE quantile is as near as d with a probability of at most 1 - CONFIDENCE:
that is the stopping test. It is asked of boxes, which are nearer than their rows, and a box is verified whole, so far
fewer neighbours are missed than that: tests hold the recall to 0.9 or more.

The upper levels of the kd-tree are cut by the medians of a sample of at most 2 SAMPLE_ROWS projected rows, and every
row falls into one of their cells (a cell of too many rows, copies perhaps, is dealt to several blocks). The test
routes queries: with the distance of the k-th neighbour in the sample as d, a query goes only to cells that are not
farther than the test allows. A block builds its own tree once, of all its rows; each query that comes takes the leaves
in the order of their distance and verifies their vectors until the next leaf is too far, with its k-th best so far as d.
Rows are moved once and never copied; a query is copied to the blocks it is routed to, and what leaves a block is k rows a
query. How much the test saves depends on the vectors: see ``Block.visited``.

Equal vectors of a block are one point of the tree, so copies neither crowd a leaf nor lose a tie.

Defined cases: vectors that are null, all zero, or hold a null or a non-finite component, those of
another length than most, and rows without an id take no part; fewer candidates than k give fewer rows; ties go to the
smaller id; of rows with one id and different vectors the smallest vector is the query, each is a candidate for others
(the best counts), and none is a neighbour of that id; repeated rows count once; empty tables give an empty result;
columns other than the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselake.llm.common import Shelf, chi2_quantile, release

DIMS, CONFIDENCE, LEAF = 8, 0.7, 16
#: Rows of a block of the index, and of the sample that its upper levels are cut by.
BLOCK_ROWS, SAMPLE_ROWS = 8_192, 8_192


def valid(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    x = F.col(col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))


class Cells:
    """The upper levels of the tree: medians of the widest dimension of a sample, and the boxes between them."""

    def __init__(self, sample: np.ndarray, cells: int):
        dims = sample.shape[1]
        self.cuts, todo = [], [(sample, np.full(dims, -np.inf), np.full(dims, np.inf))]
        while len(todo) < cells:
            some, low, high = max(todo, key=lambda x: len(x[0]))
            wide = int(np.argmax(some.max(axis=0) - some.min(axis=0))) if len(some) else 0
            at = float(np.median(some[:, wide])) if len(some) else 0.0
            left = some[:, wide] < at
            if not left.any():
                break  # all that is left are copies
            k = next(i for i, x in enumerate(todo) if x[0] is some)
            below, above = high.copy(), low.copy()
            below[wide] = above[wide] = at
            todo[k] = (some[left], low, below)
            self.cuts.append((k, len(todo), wide, at))
            todo.append((some[~left], above, high))
        self.low, self.high = np.array([x[1] for x in todo]), np.array([x[2] for x in todo])

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point: the cuts in the order in which they were made."""
        cell = np.zeros(len(points), np.int32)
        for k, new, wide, at in self.cuts:
            cell[(cell == k) & ~(points[:, wide] < at)] = new
        return cell


def box_distances(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


class Tree:
    """A kd-tree over projected points: cut at the median of the widest dimension down to leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves, todo = [], [np.arange(len(points))]
        while todo:
            some = todo.pop()
            if len(some) <= leaf:
                self.leaves.append(some)
                continue
            p = points[some]
            wide = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            by = some[np.argpartition(p[:, wide], len(some) // 2)]
            todo += [by[: len(some) // 2], by[len(some) // 2 :]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])


def project(vectors: np.ndarray, length2: float | None, projection: np.ndarray) -> np.ndarray:
    """Projections of rows (with the component that makes all as long as the longest), or of queries (with a 0)."""
    more = np.zeros(len(vectors)) if length2 is None else np.sqrt(np.maximum(0, length2 - (vectors**2).sum(axis=1)))
    return np.column_stack([vectors, more]) @ projection


class Block:
    #: Leaves that queries have visited, and those that they could have visited.
    visited = could = 0

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, length2: float, projection: np.ndarray):
        by = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[by], vectors[by]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.first = np.append(np.flatnonzero(new), len(ids))
        self.ids, self.vectors = ids, np.ascontiguousarray(vectors[self.first[:-1]])
        self.length2, self.projection = length2, projection
        self.tree = Tree(project(self.vectors, length2, projection))

    def search(self, queries: np.ndarray, k: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
        """Best k + 1 points of each query (inner products, point numbers): one more, as a point may be the query itself alone."""
        n, keep = len(queries), k + 1
        reach = chi2_quantile(confidence, self.projection.shape[1])
        far = box_distances(self.tree.low, self.tree.high, project(queries, None, self.projection))
        order = np.argsort(far, axis=1)
        own = (queries**2).sum(axis=1)
        best, at = np.full((n, keep), -np.inf), np.full((n, keep), -1)
        live = np.arange(n)
        self.could += far.size
        for step in range(order.shape[1]):
            leaf = order[live, step]
            worst = np.maximum(0, self.length2 + own[live] - 2 * best[live, -1])  # squared distance of the k-th so far
            go = ~(far[live, leaf] > reach * worst)
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            self.visited += len(live)
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.append(True, leaf[by][1:] != leaf[by][:-1]))
            for i, j in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
                q, points = live[by[i:j]], self.tree.leaves[leaf[by[i]]]
                scores = queries[q] @ self.vectors[points].T
                better = scores.max(axis=1) > best[q, -1]
                q, scores = q[better], scores[better]
                if not len(q):
                    continue
                both = np.concatenate([best[q], scores], axis=1)
                names = np.concatenate([at[q], np.broadcast_to(points, scores.shape)], axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :keep]
                best[q], at[q] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        return best, at

    def answers(self, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float = CONFIDENCE) -> list[tuple[int, int, float]]:
        """(query, neighbour, exact inner product): each query's best k rows, ties to the smaller id."""
        _, at = self.search(queries, k, confidence)
        rows = []
        for q, query, points in zip(query_ids.tolist(), queries, at, strict=True):
            found = []
            for p in points[points >= 0].tolist():
                score = math.fsum((query * self.vectors[p]).tolist())
                ids = self.ids[self.first[p] : self.first[p + 1]]
                ids = ids[ids != q][:k]
                found += [(-score, x) for x in ids.tolist()]
            found.sort()
            rows += [(q, x, -s) for s, x in found[:k]]
        return rows


def projection_for(width: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width + 1, dims))


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, confidence: float = CONFIDENCE, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest rows found."""
    spark, shelf = vectors.sparkSession, Shelf(vectors.sparkSession, "neighbours")
    taking_part = lambda df: valid(df, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where("id is not null")
    rows, asked = taking_part(vectors), taking_part(queries)
    sums = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    seen = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(sums).alias("l2")).orderBy(F.desc("n"), "width").first()
    if seen is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, length2, projection = seen["width"], float(seen["l2"]), projection_for(seen["width"])
    rows, asked = rows.where(F.size("x") == width), asked.where(F.size("x") == width).groupBy("id").agg(F.min("x").alias("x"))
    sampled = rows.where(F.pmod(F.xxhash64("id", "x"), F.lit(seen["n"])) < SAMPLE_ROWS).select("x").limit(2 * SAMPLE_ROWS).toArrow()
    sample = np.unique(_matrix(sampled.column("x"), width), axis=0)
    cells = Cells(project(sample, length2, projection), min(-(-seen["n"] // block_rows), max(1, len(sample) // (4 * k))))
    shared = spark.sparkContext.broadcast((cells, sample))

    def place(batches):
        for batch in batches:
            x = batch.column("x")
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[0].of(project(_matrix(x, width), length2, projection))), batch.column("id"), x], names=["cell", "id", "x"])

    placed = shelf.put(rows.mapInArrow(place, "cell int, id long, x array<double>"), "placed")
    # of a cell of too many rows several blocks are made; there are no more cells than sampled rows
    blocks = {r["cell"]: -(-r["n"] // (2 * block_rows)) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.create_map(*(F.lit(v) for pair in blocks.items() for v in pair)), F.col("cell"))
    dealt = placed.select("cell", F.pmod(F.xxhash64("id", "x"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "x")
    reach = chi2_quantile(confidence, DIMS)

    def route(batches):
        cells, sample = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = _matrix(some.column("x"), width)
                near = -np.sort(-(x @ sample.T), axis=1)[:, k] if len(sample) > k else np.full(len(x), -np.inf)  # one more, as one may be the query itself
                worst = np.maximum(0, length2 + (x**2).sum(axis=1) - 2 * near)
                go = ~(box_distances(cells.low, cells.high, project(x, None, projection)) > reach * worst[:, None])
                query, cell = np.nonzero(go)
                known = np.array([blocks.get(c, 0) for c in range(len(cells.low))])
                n = known[cell]
                query, cell, part = np.repeat(query, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(len(cell)), pa.int32()), some.column("id").take(pa.array(query)), some.column("x").take(pa.array(query))], names=["cell", "part", "kind", "id", "x"])

    schema = "cell int, part int, kind int, id long, x array<double>"
    together = dealt.unionByName(asked.mapInArrow(route, schema)).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")

    def search(batches):
        """The rows of a block come first and make its tree; the queries then stream by."""
        release()
        at, ids, xs, block = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "kind")], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for i, j in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                some, key = batch.slice(i, j - i), tuple(keys[i, :2])
                if key != at:
                    at, ids, xs, block = key, [], [], None
                if keys[i, 2] == 0:
                    ids.append(some.column("id").to_numpy())
                    xs.append(_matrix(some.column("x"), width))
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(xs), length2, projection)
                    ids, xs = [], []
                found = block.answers(some.column("id").to_numpy(), _matrix(some.column("x"), width), k, confidence)
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    met = together.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
