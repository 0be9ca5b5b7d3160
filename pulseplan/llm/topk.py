"""Exact top-k by inner product of integer vectors, with multi-resolution statistics.

A vector is cut into segments of equal length, at several resolutions. With mean m and
deviation s of each segment of n components, the distance of two vectors is at least

    sum over segments of n * ((m1 - m2)^2 + (s1 - s2)^2),

and as x.y = (|x|^2 + |y|^2 - distance^2) / 2, the inner product is at most

    sum over segments of n * (m1 * m2 + s1 * s2).

Both are themselves products of short vectors. A block is sifted from coarse to fine:
what cannot reach a query's k-th best product so far goes; exact products, in whole
numbers, are computed for the survivors only. Bounds are widened by what rounding may
take away, so none that belongs in the result is lost.

Vectors null, empty, or with null or non-finite components take no part, nor do those
with a component of 2^40 or more in size, whose products would not fit in a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, blocked_search, usable

# Segments at each resolution, coarse to fine.
LEVELS = (2, 8, 16, 32)
_LARGEST = float(1 << 40)
# Pairs whose vectors are laid side by side at once.
PAIRS = 1 << 16


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of each segment, side by side."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    edges = np.unique(edges)
    sizes = np.diff(edges).astype(float)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / sizes
    centred = vectors - np.repeat(mean, np.diff(edges), axis=1)
    spread = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1))
    return np.concatenate((mean * np.sqrt(sizes), spread), axis=1)


def _paired(a: np.ndarray, q: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of rows ``q`` of ``a`` with rows ``c`` of ``b``."""
    out = np.empty(len(q), dtype=a.dtype)
    for at in range(0, len(q), PAIRS):
        some = slice(at, at + PAIRS)
        np.einsum("ij,ij->i", a[q[some]], b[c[some]], out=out[some])
    return out


def _products(a: np.ndarray, q: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products; through longs where doubles could round."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if limit < 2**53:
        return _paired(a, q, b, c).astype(np.int64)
    return _paired(a.astype(np.int64), q, b.astype(np.int64), c)


def build(ids: np.ndarray, vectors: np.ndarray):
    """The search of one block."""
    dimension = vectors.shape[1]
    levels = [n for n in LEVELS if n < dimension] or [1]
    stats = [segment_statistics(vectors, n) for n in levels]
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))

    def search(query_ids: np.ndarray, queries: np.ndarray, k: int):
        asked = [segment_statistics(queries, n) for n in levels]
        slack = 1 + 1e-9 * np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None] * norms[None, :]
        bound = asked[0] @ stats[0].T + slack
        bound[query_ids[:, None] == ids[None, :]] = -np.inf
        # First best: exact products of those with the highest coarse bounds.
        first = min(8 * k, len(ids))
        top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        rows = np.repeat(np.arange(len(queries)), first)
        seen = np.isfinite(bound[rows, top.ravel()])
        rows, columns = rows[seen], top.ravel()[seen]
        score = _products(queries, rows, vectors, columns)
        floor = _kth(rows, score, len(queries), k)
        bound[rows, columns] = -np.inf
        q, c = np.nonzero((bound >= floor[:, None]) & np.isfinite(bound))
        for asks, has in zip(asked[1:], stats[1:], strict=True):
            fine = _paired(asks, q, has, c) + slack[q, c]
            alive = fine >= floor[q]
            q, c = q[alive], c[alive]
        rest = _products(queries, q, vectors, c)
        q, c = np.concatenate((rows, q)), np.concatenate((columns, c))
        return best_of(q, c, np.concatenate((score, rest)), ids, k)

    return search


def _kth(rows: np.ndarray, score: np.ndarray, queries: int, k: int) -> np.ndarray:
    """The k-th highest score of each query, minus infinity where there are fewer."""
    order = np.lexsort((-score, rows))
    counts = np.bincount(rows, minlength=queries)
    ends = np.cumsum(counts)
    floor = np.full(queries, -np.inf)
    enough = counts >= k
    floor[enough] = score[order][(ends - counts)[enough] + k - 1]
    return floor


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) with v = floor(1024 x), whole numbers held as doubles."""
    rows = usable(vectors, id_col, vector_col)
    whole = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(1024.0)).cast("double")))
    return whole.filter(F.forall("v", lambda x: F.abs(x) < F.lit(_LARGEST)))


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each query (a condition on ``id``), its k highest products with other rows."""
    return blocked_search(scaled(vectors, id_col, vector_col), is_query, build, k, "long")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
