"""Exact top-k search by columnar branch-and-bound.

Candidates lie in vertical layout, a row for each dimension. Scores are added up for a block of dimensions
at a time; after each block a candidate whose score so far plus the most that the remaining dimensions can
add (the product of the remaining lengths, by Cauchy and Schwarz) stays below a query's k-th best score is
dropped for that query, and only the survivors are carried into the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import task
from lakeops.session import materialised, scratch

EXACT = float(1 << 53)  # integers below are exact as doubles


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(
        F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))), F.lit(True))
    return df.filter(usable).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vec"))


def _scaled(column: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column by length: their places, and a matrix of floor(scale * x)."""
    lengths = np.asarray(pc.list_value_length(column))
    ends = np.cumsum(lengths)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out.append((at, flat[(ends[at] - n)[:, None] + np.arange(n)[None, :]].reshape(len(at), n)))
    return out


class _Best:
    """The best k candidates of one query: higher scores first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.empty(0, np.int64), np.empty(0), -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores are whole numbers, as doubles or (beyond their exact range) as Python integers."""
        if scores.dtype == object or self.scores.dtype == object:
            ids, scores = [*self.ids, *ids], [*map(int, self.scores), *map(int, scores)]
            order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:self.k]
            self.ids, self.scores = np.array([ids[i] for i in order], np.int64), np.array([scores[i] for i in order], object)
            self.least = float(self.scores[-1]) * (1 - 1e-9) - 1 if len(order) == self.k and self.scores[-1] > 0 else -np.inf
            return
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = self.scores[-1]


def search_block(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: list[_Best], dims: int = 16) -> None:
    """Hold every query against a block of candidates; ``rows`` and ``queries`` hold integers as doubles."""
    width = queries.shape[1]
    if width and np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * width >= EXACT:
        for q, (own, b) in enumerate(zip(query_ids, best)):  # beyond doubles: Python's integers, no bounds
            mine = [int(x) for x in queries[q]]
            full = [sum(int(x) * y for x, y in zip(r, mine)) for r in rows]
            if any(abs(v) >= 1 << 63 for v in full):
                raise OverflowError("an inner product does not fit 64 bits")
            b.add(ids[ids != own], np.array([v for v, i in zip(full, ids) if i != own], object))
        return
    columns = np.ascontiguousarray(rows.T)
    cuts = [*range(0, width, dims), width]
    left_rows = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts]
    left_queries = [np.sqrt((queries[:, c:] ** 2).sum(axis=1)) for c in cuts]
    first = queries[:, :dims] @ columns[:dims] if width else np.zeros((len(queries), len(ids)))
    for q, b in enumerate(best):
        alive, score = np.flatnonzero(ids != query_ids[q]), None
        score = first[q, alive]
        for k in range(1, len(cuts)):
            if b.least > -np.inf and cuts[k] < width:
                keep = score + left_queries[k][q] * left_rows[k][alive] * (1 + 1e-9) >= b.least - 0.5
                alive, score = alive[keep], score[keep]
            if cuts[k] < width:
                score = score + queries[q, cuts[k]:cuts[k + 1]] @ columns[cuts[k]:cuts[k + 1]][:, alive]
        keep = score >= b.least
        if keep.any():
            b.add(ids[alive[keep]], score[keep])


def _found(batches, shared, k: int, scale: int, rows: int):
    query_ids, lengths, flat = shared.value
    ends = np.cumsum(lengths)
    by_length = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        by_length[int(n)] = (query_ids[at], flat[(ends[at] - n)[:, None] + np.arange(n)[None, :]].reshape(len(at), n), [_Best(k) for _ in at])
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for at, matrix in _scaled(batch.column("vec"), scale):
            if matrix.shape[1] in by_length:
                own, queries, best = by_length[matrix.shape[1]]
                for low in range(0, len(at), rows):
                    search_block(ids[at[low:low + rows]], matrix[low:low + rows], queries, own, best)
    for own, _, best in by_length.values():
        for q, b in zip(own, best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array([int(q)] * len(b.ids), pa.int64()), pa.array(b.ids, pa.int64()),
                                                  pa.array([int(s) for s in b.scores], pa.int64())], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, query_block: int = 2048, block_rows: int = 2048,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of floor(scale * x) vectors.

    A query is not its own candidate: rows with its id are passed over. Ties go to the smaller id. Vectors that are NULL
    or hold NULL or a non-finite component, and rows without an id, take no part; vectors of another length than the
    query's are no candidates. A repeated candidate counts as often as it occurs; of queries with one id the smallest
    vector is taken.

    Queries go out in blocks of ``query_block``, so what a broadcast holds does not grow with the input. Every task
    returns k rows for each query of the block at most; a query's rows from all tasks are ranked by a window.
    """
    spark = candidates.sparkSession
    rows = _vectors(candidates, id_col, vec_col)
    asked = materialised(_vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    path, last = scratch(spark, "top-k"), None
    while block := (asked if last is None else asked.filter(F.col("id") > last)).orderBy("id").limit(query_block).collect():
        last = block[-1].id
        lengths = np.array([len(r.vec) for r in block], dtype=np.int64)
        flat = np.floor(scale * np.array([x for r in block for x in r.vec], dtype=np.float64))
        shared = spark.sparkContext.broadcast((np.array([r.id for r in block], dtype=np.int64), lengths, flat))
        rows.mapInArrow(task(_found, shared, k, scale, block_rows), "query_id long, vec_id long, score long").write.mode("append").parquet(path)
    if last is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
