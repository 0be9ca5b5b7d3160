"""Hard negatives: rows of another label that score a little below an anchor's positives.

Vectors are scaled to whole numbers; a score is an exact inner product. For each anchor, the
``positives`` best other rows of its label are its positives, and each positive opens a
window of scores: from ``low`` to ``high`` percent of its own.

Candidates lie in blocks of ``BLOCK_ROWS`` and every anchor visits every block, twice. The
first time a block answers with its best rows of the anchor's label. The second time, the
windows known, it answers with the first rows of other labels in each window; what ranks
behind these in its own block can be no result. All answers meet in a secondary sort:
repartitioned by anchor and sorted within partitions by (anchor, descending score, id),
positives before negatives of the same score. An iterator then reads the stream once: a
positive opens its window, a negative is emitted by each open window that it falls into,
a window that is full or passed is closed. It holds the open windows of one anchor only.

Nulls: rows with a null id, label or vector, or with a null or non-finite component, take no
part, nor do empty vectors and those with a scaled component of ``LARGEST`` or more in
size, whose products might pass a long. Only vectors of the same dimension meet. Other rows
of the anchor's id are not its candidates; rows that repeat each other count as often as
they occur. Anchors that agree in id, label and vector count as one. An anchor without
positives, or positives without rows in their window, give no rows; nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from .vectors import best_of

BLOCK_ROWS = 16_384
STEP = 64  # anchors that meet a block at once
LARGEST = float(1 << 26)
_NONE = np.iinfo(np.int64).min


def scaled(
    vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """(id, label, v) with v = floor(scale * x), whole numbers held as doubles."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.dropna().filter((F.size("v") > 0) & finite)
    small = F.forall("v", lambda x: F.abs(x) < F.lit(LARGEST / scale))
    return rows.filter(small).withColumn(
        "v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of equal block and kind, in pieces of at most `STEP` rows if they are anchors."""
    for batch in batches:
        block, kind = _column(batch, "block"), _column(batch, "kind")
        new = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            wide = STEP if b > a and kind[a] else b - a
            for at in range(a, b, max(1, wide)):
                some = np.arange(at, min(at + wide, b))
                yield int(block[a]), int(kind[a]), batch.take(pa.array(some))


def _scores(asked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact products of all rows of two matrices of whole numbers."""
    largest = float(np.abs(asked).max(initial=0)) * float(np.abs(own).max(initial=0))
    if largest * own.shape[1] < 2**53:  # sums of doubles are exact
        return (asked @ own.T).astype(np.int64)
    return asked.astype(np.int64) @ own.astype(np.int64).T


def _first(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int):
    """Of the pairs that fit, each row's k best: higher scores, then smaller ids."""
    held = np.where(fits, scores, _NONE)
    if held.shape[1] > k:
        least = np.partition(held, -k, axis=1)[:, -k]
        fits = fits & (held >= least[:, None])
    q, c = np.nonzero(fits)
    return best_of(q, c, scores[q, c], ids, k)


class _Block:
    """The candidates of one block."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.ids = np.concatenate([_column(p, "id") for p in parts])
        self.labels = np.concatenate([_column(p, "label") for p in parts])
        self.vectors = np.concatenate([_matrix(p) for p in parts])

    def _meet(self, anchors: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = _scores(_matrix(anchors), self.vectors)
        same = _column(anchors, "label")[:, None] == self.labels[None, :]
        other = _column(anchors, "id")[:, None] != self.ids[None, :]
        return scores, same & other, ~same & other

    def positives(self, anchors: pa.RecordBatch, k: int):
        scores, same, _ = self._meet(anchors)
        return _first(scores, same, self.ids, k)

    def negatives(self, anchors: pa.RecordBatch, k: int, low: int, high: int):
        """The first k of each window, those that several windows share once."""
        scores, _, different = self._meet(anchors)
        opened = anchors.column("opened").to_pylist()
        found = []
        for turn in range(max(map(len, opened))):
            from_, to = np.ones((2, len(opened)), dtype=np.int64)
            to[:] = 0
            for i, own in enumerate(opened):
                if turn < len(own):
                    from_[i], to[i] = -(-low * own[turn] // 100), high * own[turn] // 100
            inside = different & (scores >= from_[:, None]) & (scores <= to[:, None])
            found.append(_first(scores, inside, self.ids, k))
        q, c, score = map(np.concatenate, zip(*found, strict=True))
        once = np.unique(q * len(self.ids) + c, return_index=True)[1]
        return q[once], c[once], score[once]


def _visits(answer):
    """``answer(block, anchors)`` for all anchors that visit the blocks of a task."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block, parts = None, None, []
        for number, kind, rows in _runs(batches):
            if number != here:
                here, block, parts = number, None, []
            if kind == 0:
                parts.append(rows)
                continue
            if block is None:
                if not parts:
                    continue
                block, parts = _Block(parts), []
            q, c, score = answer(block, rows)
            yield pa.record_batch(
                {
                    "anchor": rows.column("id").take(pa.array(q)),
                    "uid": rows.column("uid").take(pa.array(q)),
                    "id": pa.array(block.ids[c], pa.int64()),
                    "score": pa.array(score, pa.int64()),
                }
            )

    return mapper


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Candidates by a hash of their id to one block, anchors behind them to every block."""

    def number(block: Column) -> Column:
        return F.xxhash64(F.size("v"), block.cast("long"))

    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    names = ["kind", "id", "uid", "label", "opened", "v"]
    candidates = rows.select(
        number(own).alias("block"),
        F.lit(0).alias("kind"),
        "id",
        F.lit(0).cast("long").alias("uid"),
        "label",
        F.array().cast("array<long>").alias("opened"),
        "v",
    )
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), number))
    visits = anchors.withColumn("kind", F.lit(1)).select(every.alias("block"), *names)
    # More partitions than blocks, as blocks fall into them by hash.
    dealt = candidates.unionByName(visits).repartition(4 * blocks, "block")
    return dealt.sortWithinPartitions("block", "kind", "id")


_FOUND = "anchor long, uid long, id long, score long"


def _windows(each: int, low: int, high: int):
    """Reads (anchor, descending score, id) in order; emits negatives as they pass."""
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, opened = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("anchor", "uid", "down", "kind", "id")]
            for anchor, uid, down, kind, own in zip(*columns, strict=True):
                if (anchor, uid) != here:
                    here, opened = (anchor, uid), []
                score = -down
                if kind == 0:
                    opened.append([own, score, 0])
                    continue
                passed = False
                for window in opened:
                    if low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((anchor, window[0], window[2], own, window[1], score))
                    passed |= window[2] == each or 100 * score < low * window[1]
                if passed:
                    opened = [w for w in opened if w[2] < each and 100 * score >= low * w[1]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cells = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.record_batch(
                [pa.array(list(c), t) for c, t in zip(cells, types, strict=True)], names=list(names)
            )

    return mapper


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each anchor and positive, the first rows of other labels in the positive's window.

    ``rows``: (id, label, v) as `scaled` gives; ``is_anchor``: a condition on them.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    uid = F.xxhash64("label", "v").alias("uid")
    anchors = rows.filter(is_anchor).distinct().select("*", uid)
    unopened = anchors.withColumn("opened", F.array().cast("array<long>"))
    found = _dealt(rows, unopened, blocks).mapInArrow(
        _visits(lambda block, asked: block.positives(asked, positives)), _FOUND
    )
    best = Window.partitionBy("anchor", "uid").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    found = stored(found.drop("place"), "positives")
    opened = found.groupBy("anchor", "uid").agg(F.array_sort(F.collect_set("score")).alias("opened"))
    asked = anchors.join(opened.withColumnRenamed("anchor", "id"), ["id", "uid"])
    rivals = _dealt(rows, asked, blocks).mapInArrow(
        _visits(lambda block, asked: block.negatives(asked, negatives, low, high)), _FOUND
    )
    # Smaller of two kinds first: a window is open before a negative of the same score.
    pairs = found.withColumn("kind", F.lit(0)).unionByName(rivals.withColumn("kind", F.lit(1)))
    keyed = pairs.select("anchor", "uid", (-F.col("score")).alias("down"), "kind", "id")
    keyed = keyed.repartition("anchor", "uid").sortWithinPartitions(*keyed.columns)
    return keyed.mapInArrow(
        _windows(negatives, low, high),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors`` (vec_id, embedding, label) mined as the query asks.

    Where the id is divisible by 7 the label moves on by one of ten; ids divisible by 50
    are anchors.
    """
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(scaled(vectors).withColumn("label", moved), F.col("id") % 50 == 0)


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT r, id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place FROM scored WHERE same
), ranked AS (
  SELECT n.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.r = n.r
  WHERE p.place <= 5 AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
