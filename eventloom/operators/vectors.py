"""Nearest vectors of a stated query set among all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
DIGITS = 9


def nearest_vectors(queries: DataFrame, vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, best_id, similarity): for each query the other vector with the greatest cosine; of equals, to nine digits, the least id.

    queries and vectors: (vec_id, embedding). Queries are sent out in blocks of about block_rows rows, as many
    passes as blocks; per task and block one matrix product, of which only each query's best leaves the
    task. A vector of length zero or null is nobody's best and has none itself.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    out = None
    for k in range(blocks):
        part = [r for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).collect() if r[1]]
        one = _best(vectors, [r[0] for r in part], [r[1] for r in part])
        out = one if out is None else out.unionByName(one)
    return out


def _best(vectors: DataFrame, ids: list[int], rows: list[list[float]]) -> DataFrame:
    q = np.array(rows, np.float64).reshape(len(rows), -1)
    norm = np.linalg.norm(q, axis=1)
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64)[norm > 0], q[norm > 0] / norm[norm > 0, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, m = shared.value
        best_id, best = np.full(len(mine), -1, np.int64), np.full(len(mine), -np.inf)
        for b in batches:
            ids_ = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids_), -1)
            n = np.linalg.norm(v, axis=1)
            order = np.argsort(ids_, kind="stable")
            order = order[n[order] > 0]
            if not len(order) or not len(mine):
                continue
            v, ids_ = v[order] / n[order, None], ids_[order]
            s = np.round(m @ v.T, DIGITS)
            s[mine[:, None] == ids_[None, :]] = -np.inf
            at = s.argmax(1)
            top = s[np.arange(len(mine)), at]
            new = np.isfinite(top) & ((top > best) | ((top == best) & (ids_[at] < best_id)))
            best_id[new], best[new] = ids_[at][new], top[new]
        on = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(mine[on]), pa.array(best_id[on]), pa.array(best[on])], names=["vec_id", "id", "s"])

    found = vectors.where("size(embedding) > 0").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, id long, s double")
    pick = F.max_by(F.struct("id", "s"), F.struct("s", -F.col("id"))).alias("x")
    return found.groupBy("vec_id").agg(pick).select("vec_id", F.col("x.id").alias("best_id"), F.col("x.s").alias("similarity"))
