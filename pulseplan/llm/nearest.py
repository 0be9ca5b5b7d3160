"""Approximate nearest neighbours by stable projections and a chi-square stopping test.

Unit vectors are projected onto ``PROJECTIONS`` Gaussian directions. The squared
projected distance of two vectors, over their squared distance, then follows the
chi-square law with that many degrees of freedom. A kd-tree over the projections yields a
query's projected neighbours one after the other; each is verified against the original
vectors. When the next one's projected distance d and the k-th best true distance r have
chi2(d^2 / r^2) >= ``CONFIDENCE``, a nearer vector would have shown up by then with that
probability, and the search ends. What is as near as the k-th best but for rounding, such
as equal vectors in many leaves, is always visited.

The tree has two parts. Its top, fitted to a sample of at most ``SAMPLE`` projections,
deals every vector into a cell; a cell of more than ``BLOCK_ROWS`` vectors, such as one of
equal vectors, is split into several blocks by a hash of the row. Each block has a tree of
its own, built by the task that searches it. A query first searches one block of its own
cell; what it found there is the bound with which it is sent on, and only to the cells
that the stopping test does not rule out as a whole.

Nearness is the cosine in double precision. Vectors null, empty, zero, or with null or
non-finite components take no part; only vectors of one dimension meet. Every row is a
candidate, however often its id or its vector occurs, but not for queries of its own id;
queries that share an id share their k best. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from .vectors import matrix, runs, usable

PROJECTIONS = 24
CONFIDENCE = 0.95
LEAF = 32
SEED = 7
# More than rounding takes from a cosine or from the squared distance of unit vectors.
SLACK = 1e-12
# Expected candidates of a block: bounds a task's memory, whatever the table holds.
BLOCK_ROWS = 16_384
# Projections that the cells are fitted to. All rows are dealt into the cells.
SAMPLE = 16_384
# Neighbours verified between two looks at the stopping test: these, or a part of those before.
STEP, PART = 32, 8


def chi_square(x: float, degrees: int) -> float:
    """The chi-square distribution function for an even number of degrees."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**j / math.factorial(j) for j in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


# The search may end where the squared projected distance is above this much of the squared true one.
STOP = chi_square_quantile(CONFIDENCE, PROJECTIONS)


def limits(floors: np.ndarray) -> np.ndarray:
    """Squared projected distances beyond which nothing is expected to beat these cosines."""
    return STOP * (np.maximum(2 - 2 * floors, 0) + SLACK)


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    scaled = vectors / largest
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, PROJECTIONS))


def box_gaps(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(at), len(low)))
    for axis in range(at.shape[1]):
        own = at[:, axis, None]
        out += np.maximum(np.maximum(low[None, :, axis] - own, own - high[None, :, axis]), 0) ** 2
    return out


class Cells(NamedTuple):
    """The top of the tree. A node's children are numbered; a cell is minus its number, minus one."""

    axis: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.full(len(points), 0 if len(self.axis) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            here = node[inner]
            right = points[inner, self.axis[here]] >= self.cut[here]
            node[inner] = self.children[here, right.astype(int)]
        return -node - 1


def fit_cells(points: np.ndarray, cells: int) -> Cells:
    """Halves along the widest side, until a cell has its share of the points or is one point."""
    share = max(1, -(-len(points) // cells))
    axis, cut, children, low, high = [], [], [], [], []
    whole = np.full(PROJECTIONS, np.inf)
    open_ = [(np.arange(len(points)), -whole, whole, None)]
    while open_:
        own, under, over, parent = open_.pop()
        at = points[own]
        widest = int(np.argmax(np.ptp(at, axis=0))) if len(own) else 0
        if len(own) <= share or np.ptp(at[:, widest]) == 0:
            name = -len(low) - 1
            low.append(under)
            high.append(over)
        else:
            name = len(axis)
            side = at[:, widest]
            middle = np.median(side)
            middle = middle if middle > side.min() else side[side > middle].min()
            axis.append(widest)
            cut.append(middle)
            children.append([0, 0])
            left, right = over.copy(), under.copy()
            left[widest] = right[widest] = middle
            open_.append((own[side < middle], under, left, (name, 0)))
            open_.append((own[side >= middle], right, over, (name, 1)))
        if parent:
            children[parent[0]][parent[1]] = name
    nodes = np.array(children, dtype=int).reshape(-1, 2)
    return Cells(np.array(axis, dtype=int), np.array(cut), nodes, np.array(low), np.array(high))


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Positions of the points in each leaf: halves along the widest side, again and again."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        if len(own) <= leaf:
            leaves.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        half = len(own) // 2
        order = np.argpartition(points[own, axis], half)
        open_ += [own[order[:half]], own[order[half:]]]
    return leaves


class Block:
    """The kd-tree of one block. ``verified`` counts the vectors compared with queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.whole = ids, unit(vectors)
        self.directions = directions(vectors.shape[1])
        self.points = self.whole @ self.directions
        self.leaves = kd_leaves(self.points, LEAF)
        self.low = np.array([self.points[own].min(axis=0) for own in self.leaves])
        self.high = np.array([self.points[own].max(axis=0) for own in self.leaves])
        self.verified = 0

    def neighbours(self, at: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, squared projected distances) in ascending order, in pieces.

        Leaves are opened in order of their distance; what is nearer than the next leaf is next.
        """
        order = np.argsort(gaps, kind="stable")
        ends = np.append(gaps[order[1:]], np.inf)  # no unopened point is nearer than this
        waiting, far = np.zeros(0, dtype=int), np.zeros(0)
        opened, more = 0, 1
        while opened < len(order):
            new = np.concatenate([self.leaves[i] for i in order[opened : opened + more]])
            opened = min(opened + more, len(order))
            apart = self.points[new] - at
            waiting = np.concatenate((waiting, new))
            far = np.concatenate((far, np.einsum("ij,ij->i", apart, apart)))
            ready = far <= ends[opened - 1]
            if ready.any():
                own, near = waiting[ready], far[ready]
                by = np.argsort(near, kind="stable")
                yield own[by], near[by]
                waiting, far = waiting[~ready], far[~ready]
            more *= 2

    def nearest(self, query_id: int, asked: np.ndarray, at: np.ndarray, gaps: np.ndarray, k: int, floor: float):
        """Positions and cosines of the k best found, all of them at ``floor`` or above."""
        position, cosine, seen = np.zeros(0, dtype=int), np.zeros(0), 0
        for own, near in self.neighbours(at, gaps):
            done = 0
            while done < len(own):
                if near[done] > limits(floor):
                    return position, cosine
                size = max(STEP, seen // PART)
                c = own[done : done + size]
                c = c[near[done : done + size] <= limits(floor)]
                done, seen = done + size, seen + len(c)
                self.verified += len(c)
                c = c[self.ids[c] != query_id]
                # The same sum for every pair, so that equal vectors score alike.
                score = (asked * self.whole[c]).sum(axis=1)
                position = np.concatenate((position, c[score >= floor]))
                cosine = np.concatenate((cosine, score[score >= floor]))
                if len(position) > k:
                    best = np.lexsort((self.ids[position], -cosine))[:k]
                    position, cosine = position[best], cosine[best]
                if len(position) == k:
                    floor = max(floor, cosine.min())
        return position, cosine

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray):
        """Positions of queries, positions of candidates, and cosines."""
        asked = unit(queries)
        at = asked @ self.directions
        gaps = box_gaps(at, self.low, self.high)
        found = [
            self.nearest(query_ids[i], asked[i], at[i], gaps[i], k, floors[i]) for i in range(len(asked))
        ]
        many = [len(position) for position, _ in found]
        return np.repeat(np.arange(len(asked)), many), *map(np.concatenate, zip(*found, strict=True))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in runs(batches, ("dim",)):
        points = unit(matrix(rows)) @ directions(rows.column("dim")[0].as_py())
        yield pa.record_batch({"p": pa.array(points.tolist(), pa.list_(pa.float64()))})


def sampled_cells(rows: DataFrame, many: int) -> Cells:
    """Cells for blocks of ``BLOCK_ROWS`` rows, as far as the sample tells them apart."""
    cells = min(-(-many // BLOCK_ROWS), SAMPLE // 8)
    if cells <= 1:
        return fit_cells(np.zeros((0, PROJECTIONS)), 1)
    some = rows.select("dim", "v").sample(min(1.0, SAMPLE / many), SEED).limit(SAMPLE)
    points = some.mapInArrow(_projected, "p array<double>").toArrow().column("p").to_pylist()
    return fit_cells(np.array(sorted(points)).reshape(-1, PROJECTIONS), cells)


def _in_cells(cells: Cells):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), rows in runs(batches, ("dim",)):
            cell = cells.of(unit(matrix(rows)) @ directions(dim))
            yield rows.append_column("cell", pa.array(cell, pa.int32()))

    return mapper


def _sent_on(cells: Cells):
    """Each query with the cells that the stopping test leaves, given its ``floor``."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), rows in runs(batches, ("dim",)):
            at = unit(matrix(rows)) @ directions(dim)
            floors = rows.column("floor").to_numpy(zero_copy_only=False)
            q, cell = np.nonzero(box_gaps(at, cells.low, cells.high) <= limits(floors)[:, None])
            for of in np.array_split(np.arange(len(q)), -(-len(q) // rows.num_rows)):
                yield rows.take(pa.array(q[of])).append_column("to", pa.array(cell[of], pa.int32()))

    return mapper


def _searching(k: int):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block, parts = None, None, []
        for (number, kind), rows in runs(batches, ("block", "kind")):
            if number != here:
                here, block, parts = number, None, []
            ids, vectors = rows.column("id").to_numpy(zero_copy_only=False), matrix(rows)
            if kind == 0:
                parts.append((ids, vectors))
                continue
            if block is None:
                if not parts:
                    continue
                block = Block(*map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            floors = rows.column("floor").to_numpy(zero_copy_only=False)
            q, c, score = block.search(ids, vectors, k, floors)
            yield pa.record_batch(
                {
                    "query_id": pa.array(ids[q], pa.int64()),
                    "vec_id": pa.array(block.ids[c], pa.int64()),
                    "score": pa.array(score, pa.float64()),
                }
            )

    return mapper


def _searched(placed: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, vec_id and score: what each query finds in the block it is sent to."""
    candidates = placed.select("block", F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))
    queries = asked.select("block", F.lit(1).alias("kind"), "id", "v", "floor")
    dealt = candidates.unionByName(queries).repartitionById(blocks, "block")
    dealt = dealt.sortWithinPartitions("block", "kind", "id")
    return dealt.mapInArrow(_searching(k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a condition on ``id``), the k nearest found."""
    rows = usable(vectors, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("dim", F.size("v"))
    cells = sampled_cells(rows, rows.count())
    schema = "id long, v array<double>, dim int, cell int"
    # A number of its own for each row, so that equal rows can be told apart from here on.
    dealt = rows.mapInArrow(_in_cells(cells), schema).withColumn("row", F.monotonically_increasing_id())
    dealt = stored(dealt, "cells")
    # One row per cell and dimension: at most SAMPLE / 8 cells.
    splits = dealt.groupBy("dim", "cell").count()
    splits = splits.withColumn("split", F.ceil(F.col("count") / F.lit(BLOCK_ROWS)).cast("int"))
    before = F.sum("split").over(Window.orderBy("dim", "cell")) - F.col("split")
    splits = stored(splits.select("dim", "cell", "split", before.cast("int").alias("first")), "blocks")
    blocks = splits.agg(F.sum("split")).first()[0] or 1
    own = F.col("first") + F.pmod(F.xxhash64("id", "row"), F.col("split")).cast("int")
    placed = dealt.join(splits, ["dim", "cell"]).select("dim", "id", "v", own.alias("block"))

    asked = placed.filter(is_query)
    home = _searched(placed, asked.withColumn("floor", F.lit(-2.0)), blocks, k)
    home = stored(home, "home")
    floors = _ranked(home, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = asked.join(floors, "id", "left").fillna(-2.0, ["floor"])
    sent = bounded.select("id", "v", "dim", "block", "floor").mapInArrow(
        _sent_on(cells), "id long, v array<double>, dim int, block int, floor double, to int"
    )
    to = splits.select("dim", F.col("cell").alias("to"), "first", "split")
    every = F.explode(F.sequence("first", F.col("first") + F.col("split") - 1))
    others = sent.join(to, ["dim", "to"]).withColumn("other", every).filter("other <> block")
    others = others.select("id", "v", F.col("other").alias("block"), "floor")
    found = home.unionByName(_searched(placed, others, blocks, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
