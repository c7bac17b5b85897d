"""Exact nearest neighbours.

A single query is a plain expression and a top-k. For a set of queries, which may grow with the corpus, both sides are dealt out:
queries into cells around pivots (a few vectors of the corpus), and cells into blocks of bounded size; the corpus into slices. A pair of
block and slice is one group and one task's work, of bounded size whatever the input. By the triangle inequality a vector need not go to a cell
if it is farther from the pivot than the cell's radius and the distance within which the cell's queries surely have ``k`` neighbours; where
vectors lie in clusters, most go to few cells. Nothing but pivots and one radius and bound a cell is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import score
from tessera.operators.ranking import top_of_each

BLOCK_VECTORS = 4096  # of queries, about; there is a pivot for each so many, as far as MOST_PIVOTS
SLICE_VECTORS = 1 << 17
MOST_PIVOTS = 256
SLACK = 1e-6  # of distances, which are square roots of rounded sums
SENT = "vec_id long, embedding array<float>, cell int, part int"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def nearest(corpus: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, then: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``corpus(vec_id, embedding, ...)`` to one vector, ties by ``vec_id``: columns and ``distance``, ``score``.

    ``where`` filters before the search; ``then`` afterwards, which may leave fewer than ``k`` rows.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    e = F.col("embedding")
    distance = 1 - cosine(e, q) if metric == "cosine" else squared_l2(e, q)
    rows = corpus if where is None else corpus.where(where)
    top = rows.withColumn("distance", distance).orderBy("distance", "vec_id").limit(k).withColumn("score", score(F.col("distance")))
    return top if then is None else top.where(then)


def nearest_to_each(corpus: DataFrame, queries: DataFrame, k: int, block: int = BLOCK_VECTORS, slice_: int = SLICE_VECTORS) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: for each row of ``queries(query_id, embedding)`` its ``k`` most similar other
    rows of ``corpus(vec_id, embedding)`` by cosine, ties by ``vec_id``. Rows without an id, null vectors and vectors with a null part are ignored;
    a vector of zeros has the similarity 0 to all. Vectors are of one length; ids of each side are different."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    known = queries.where(whole & F.col("query_id").isNotNull()).select(F.col("query_id").alias("vec_id"), "embedding")
    rows = corpus.where(whole & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    n_queries, n_rows = known.count(), rows.count()
    if not n_queries or not n_rows:
        return corpus.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    if n_queries < 2 * block:  # one cell, to which all goes
        pivots, sizes, reach = np.eye(1, len(rows.first()["embedding"])), np.array([n_queries]), np.array([np.inf])
    else:
        pivots = _pivots(rows, min(MOST_PIVOTS, n_queries // block, n_rows))
        sizes, reach = _bounds(known, rows, pivots, k)
    parts = np.maximum(1, -(-sizes // block))
    tasks = corpus.sparkSession.sparkContext.defaultParallelism
    slices = max(-(-n_rows // slice_), min(2 * tasks, n_rows // 2048 + 1))
    left = _sent(known, pivots, parts).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = _sent(rows, pivots, parts, np.where(sizes > 0, reach, -np.inf)).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    group = ["cell", "part", "slice"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_best_of_group(k), "query_id long, vec_id long, similarity double")
    return top_of_each(found, "query_id", [F.desc("similarity"), "vec_id"], k)


def _matrix(vectors: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length one; zeros stay zeros."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors of the corpus that are not all zeros, those with the smallest hashes of their ids: any partitioning gives the same."""
    found = rows.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").toArrow()
    return _matrix(found["embedding"]) if found.num_rows else np.eye(1, len(rows.first()["embedding"]))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to the pivots. A vector of zeros has no direction: it counts as far from none of them."""
    found = np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0))
    found[~vectors.any(1)] = -np.inf
    return found


def _bounds(queries: DataFrame, rows: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell: how many queries it has, and how far from its pivot a vector may be that one of them needs."""

    def nearest_pivot(most: int | None):
        """Rows ``cell, n, far`` of a task: with ``most`` the distances of the nearest vectors of a cell, else the number and radius of its queries."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, radius, near = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), [np.zeros(0)] * len(pivots)
            for batch in batches:
                found = _distances(_matrix(batch.column(0)), pivots)
                cell = found.argmin(1)
                far = found[np.arange(len(cell)), cell]
                count += np.bincount(cell, minlength=len(pivots))
                np.maximum.at(radius, cell, np.where(far < 0, np.inf, far))  # a query of zeros needs all
                if most:
                    for c in np.unique(cell[far >= 0]):
                        near[c] = np.sort(np.append(near[c], far[(cell == c) & (far >= 0)]))[:most]
            cells = np.arange(len(pivots))
            got = [(c, 1, x) for c in cells for x in near[c]] if most else list(zip(cells, count, radius))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([g[j] for g in got], t)) for j, t in enumerate((np.int32, np.int64, np.float64))], ["cell", "n", "far"])

        return run

    shape = "cell int, n long, far double"
    of_queries = queries.select("embedding").mapInArrow(nearest_pivot(None), shape).groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()
    of_rows = top_of_each(rows.select("embedding").mapInArrow(nearest_pivot(k + 1), shape), "cell", ["far"], k + 1).collect()
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in of_queries:
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    between = _distances(pivots, pivots)
    near = np.array([[r["cell"], r["far"]] for r in of_rows]).reshape(-1, 2)
    sure = np.sort(between[:, near[:, 0].astype(int)] + near[:, 1], axis=1)[:, k : k + 1]  # one more than k: a query itself may be among them
    within = radius + (sure[:, 0] if sure.shape[1] else np.inf)
    return sizes, radius + within + SLACK


def _sent(vectors: DataFrame, pivots: np.ndarray, parts: np.ndarray, reach: np.ndarray | None = None) -> DataFrame:
    """Queries with their cell and its part (``reach`` None), or vectors once for each part of each cell within whose reach they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                found = _distances(_matrix(piece.column(1)), pivots)
                if reach is None:
                    row, cell = np.arange(len(found)), found.argmin(1)
                    part = piece.column(2).to_numpy() % parts[cell]
                else:
                    row, cell = np.nonzero(found <= reach)
                    times = parts[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                if len(row):
                    kept = piece.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], ["vec_id", "embedding", "cell", "part"])

    return vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.abs(F.xxhash64("vec_id") % (1 << 31)).alias("h")).mapInArrow(run, SENT)


def _best(row: np.ndarray, key: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` candidates of each row with the largest values, ties by key; and each one's rank from 0."""
    order = np.lexsort((key, -value, row))
    row, key, value = row[order], key[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], key[keep], value[keep], rank[keep]


def _best_of_group(k: int):
    """The ``k`` best vectors of a slice for each query of a block."""
    names = ["query_id", "vec_id", "similarity"]

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        query_ids, row, key, value = queries["vec_id"].to_numpy(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if queries.num_rows and vectors.num_rows:
            q = _matrix(queries["embedding"])
            floor = np.full(len(q), -np.inf)  # the k-th best so far
            for at in range(0, vectors.num_rows, 1024):
                piece = vectors.slice(at, 1024)
                keys = piece["vec_id"].to_numpy()
                similar = q @ _matrix(piece["embedding"]).T
                similar[query_ids[:, None] == keys[None, :]] = -np.inf
                n = min(k, similar.shape[1])
                least = np.maximum(floor, np.partition(similar, -n, axis=1)[:, -n])  # ties with the k-th stay, so that ids can break them
                r, c = np.nonzero((similar >= least[:, None]) & (similar > -np.inf))
                if len(r):
                    row, key, value, rank = _best(np.append(row, r), np.append(key, keys[c]), np.append(value, similar[r, c]), k)
                    last = rank == k - 1
                    floor[row[last]] = value[last]
        return pa.Table.from_arrays([pa.array(query_ids[row], pa.int64()), pa.array(key, pa.int64()), pa.array(value, pa.float64())], names)

    return run
