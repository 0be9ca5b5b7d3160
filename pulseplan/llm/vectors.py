"""A frame for vector searches: stated queries against all rows, in blocks.

Candidates are dealt into blocks by a hash of their id, and each query goes to every
block. A task reads its block's candidates first, builds what it needs of them, and then
meets the queries as they stream by, so it holds one block and a few queries at a time.
Each block answers with its best k; a window over k answers per block gives the result.

What is sent: each vector once, and each query once per block of ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expected candidates of a block: bounds a task's memory, whatever the table holds.
BLOCK_ROWS = 16_384
QUERY_STEP = 128
_ROWS = "block long, kind int, id long, v array<double>"
# ids and vectors of a block -> a search of queries (ids, vectors) for their k best:
# positions of queries, positions of candidates, scores. Not more than k for each query.
Build = Callable[[np.ndarray, np.ndarray], Callable]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v as doubles; no null id or vector, no null or non-finite component."""
    v = F.col("v")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of rows that all have the same dimension."""
    return pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows equal in ``keys`` (numbers), in pieces of at most `QUERY_STEP` rows."""
    for batch in batches:
        values = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
        for value in values:
            new |= np.diff(value) != 0
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            for at in range(a, b, QUERY_STEP):
                part = batch.slice(at, min(QUERY_STEP, b - at))
                yield tuple(int(v[a]) for v in values), part.take(pa.array(np.arange(part.num_rows)))


def _searching(build: Build, k: int, score_type: pa.DataType):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, search, parts = None, None, []
        for (block, kind), rows in runs(batches, ("block", "kind")):
            if block != here:
                here, search, parts = block, None, []
            ids, vectors = rows.column("id").to_numpy(zero_copy_only=False), matrix(rows)
            if kind == 0:
                parts.append((ids, vectors))
                continue
            if search is None:
                if not parts:
                    continue
                own = np.concatenate([p[0] for p in parts])
                search = build(own, np.concatenate([p[1] for p in parts]))
            q, c, score = search(ids, vectors, k)
            yield pa.record_batch(
                {
                    "query_id": pa.array(ids[q], pa.int64()),
                    "vec_id": pa.array(own[c], pa.int64()),
                    "score": pa.array(score, score_type),
                }
            )

    return mapper


def blocked_search(
    rows: DataFrame, is_query: Column, build: Build, k: int, score: str = "double"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row of ``rows`` (id, v), the best k.

    Higher scores are better, ties go to the smaller id. Only vectors of the same
    dimension meet. Every row is a candidate, however often its id or its vector occurs;
    a query never meets rows of its own id. Queries that share an id share their k best.
    """
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    deal = lambda b: F.xxhash64(F.size("v"), b.cast("long"))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    candidates = rows.select(deal(own).alias("block"), F.lit(0).alias("kind"), "id", "v")
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), deal))
    queries = rows.filter(is_query).select(every.alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = (
        candidates.unionByName(queries)
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "kind", "id", "v")
    )
    kind = pa.int64() if score == "long" else pa.float64()
    found = dealt.mapInArrow(
        _searching(build, k, kind), f"query_id long, vec_id long, score {score}"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of(
    q: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored pairs, the k best of each query, ties to the smaller candidate id."""
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1)) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
    keep = place < k
    return q[keep], c[keep], score[keep]
