"""Exact top-k inner products with block-at-a-time pruning.

Vectors are dealt over ranges, each sorted by id and cut into blocks. A block knows each dimension's largest and smallest value; a query's
bound for the block sums what each dimension can give at most. A query takes blocks by falling bound, scores them
through their stored vectors, and stops once the next bound is below its k-th score. Queries and vectors meet in cells
of bounded size, a chunk of queries with a range of vectors; the k best of the cells are merged by a ranking window.

Vectors that are null or hold a null or a non-finite component take no part, nor do rows without an id. Shorter and empty
vectors count as padded with zeros. Rows of one id are rows of their own: each is a query and a candidate of the others,
and gets its own ranks. Equal scores of one id are in no set order. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import written

BLOCK = 256
RANGE_ROWS, CHUNK_ROWS = 16_384, 4_096
NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, data, row``: floor(scale * x) of each component as 64-bit numbers, and the row's own number; rows that
    take no part are left out. Write the table down before it is read twice."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.array(vector.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(values).all():
                    ids.append(vec_id)
                    data.append(np.floor(scale * values).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "data"])

    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", F.isnull)
    return rows.filter(whole).select("vec_id", "embedding").mapInArrow(scaled, "vec_id bigint, data binary").withColumn(
        "row", F.monotonically_increasing_id())


def _matrix(data: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(data), width), np.int64)
    for row, d in zip(out, data):
        row[:len(d) // 8] = np.frombuffer(d, "<i8")
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in floating point where no sum can leave its whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_of_blocks(asking_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                   k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Per query the ids and scores of its k best rows but its own (score NONE: fewer), and how many blocks were scored."""
    order = np.argsort(ids, kind="stable")
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    edges = range(0, len(ids), block)
    high = np.array([vectors[a:a + block].max(axis=0) for a in edges]).reshape(-1, queries.shape[1])
    low = np.array([vectors[a:a + block].min(axis=0) for a in edges]).reshape(-1, queries.shape[1])
    bounds = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    turns = np.argsort(-bounds, axis=1, kind="stable")
    top = np.full((len(queries), k), NONE)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    alive, scored = np.arange(len(queries)), 0
    for turn in range(len(edges)):
        chosen = turns[alive, turn]
        alive = alive[bounds[alive, chosen] >= top[alive, -1]]  # an equal score may have a smaller id
        if not len(alive):
            break
        chosen = turns[alive, turn]
        scored += len(alive)
        for b in np.unique(chosen).tolist():
            asking = alive[chosen == b]
            there = ids[b * block:(b + 1) * block]
            scores = _product(queries[asking], vectors[b * block:(b + 1) * block])
            scores[asking_rows[asking][:, None] == rows[b * block:(b + 1) * block][None, :]] = NONE
            both = np.hstack([top[asking], scores])
            names = np.hstack([who[asking], np.broadcast_to(there, scores.shape)])
            names[both == NONE] = np.iinfo(np.int64).max
            best = np.lexsort((names, -np.maximum(both, NONE + 1)), axis=1)[:, :k]
            top[asking], who[asking] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    return who, top, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int, range_rows: int = RANGE_ROWS, chunk_rows: int = CHUNK_ROWS,
          block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` and ``vectors`` (``vec_id, data, row``, written tables)."""
    ranges = max(1, -(-vectors.count() // range_rows))
    chunks = max(1, -(-queries.count() // chunk_rows))
    spread = F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.withColumn("range", spread).select(F.lit(False).alias("asks"), "vec_id", "row", "data", "range",
                                                      all_of(chunks).alias("chunk"))
    asks = queries.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).select(
        F.lit(True).alias("asks"), "vec_id", "row", "data", all_of(ranges).alias("range"), "chunk")

    def cell(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        data = table.column("data").to_pylist()
        matrix = _matrix(data, max(1, max(len(d) for d in data) // 8))
        who, top, _ = best_of_blocks(rows[asks], matrix[asks], rows[~asks], ids[~asks], matrix[~asks], k, block)
        found = top != NONE
        return pa.table({"row": pa.array(np.repeat(rows[asks], found.sum(axis=1)), pa.int64()),
                         "query_id": pa.array(np.repeat(ids[asks], found.sum(axis=1)), pa.int64()),
                         "vec_id": pa.array(who[found], pa.int64()), "score": pa.array(top[found], pa.int64())})

    best = held.unionByName(asks).groupBy("range", "chunk").applyInArrow(
        cell, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The rows whose id is divisible by ``every``, each against all other rows."""
    vectors = written(whole_vectors(rows))
    return top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(every)) == 0), k)
