"""Exact medians of groups of any size, without gathering a group.

`exact_median` counts every distinct value once and narrows the middle rank down within the
counts: one lazy plan, which shuffles the distinct values. `median_in_cells` narrows it down
by scanning the rows again: more jobs, but only counts of coarse cells are shuffled, which
is what a table needs whose values are nearly all distinct.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import stored

# A value is narrowed down 20 bits at a time, from the top.
_BITS = 20
_SHIFTS = (2 * _BITS, _BITS, 0)


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(Column.__and__, pairs)


def _cell_of_rank(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cell each rank falls into, and the rank counted from its first value."""
    below = F.col("upto") - F.col("n")
    return cells.filter(
        (F.col("rank") >= below) & (F.col("rank") < F.col("upto"))
    ).select(
        *keys, "side", F.col("cell").alias("parent"), (F.col("rank") - below).alias("rank")
    )


def _named(by: Sequence[str]) -> dict[str, Column]:
    return {"_k0": F.lit(0)} | {f"_k{i + 1}": F.col(c) for i, c in enumerate(by)}


def _keys(by: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(by) + 1)]


def top_cells(df: DataFrame, by: Sequence[str], value: str, *counts: Column) -> DataFrame:
    """Stored: ``n`` rows, and ``counts``, of each group and top cell of ``value``.

    A cell is the value without its last 40 bits, NULL for NULLs. The groups' columns are
    called ``_k1`` and on, behind the constant ``_k0``.
    """
    cell = F.shiftright(F.col(value).cast("bigint"), _SHIFTS[0])
    rows = df.withColumns(_named(by) | {"_cell": cell})
    counted = rows.groupBy(*_keys(by), F.col("_cell").alias("cell")).agg(F.count(F.lit(1)).alias("n"), *counts)
    return stored(counted, "cells")


def median_in_cells(df: DataFrame, by: Sequence[str], value: str, cells: DataFrame) -> DataFrame:
    """``by`` plus ``median`` (double) of the bigint column ``value``; NULLs skipped.

    The built-in exact median keeps every distinct value of a group in one task. Here the
    rows are scanned three times: for the counts of `top_cells`, then for those of the
    cells of 20 bits less inside the one or two that hold the middle ranks, then for those
    of single values inside these. What is shuffled is counts of cells, never the values of
    a group. A window spans the cells below one parent only, at most 2**20 of them (2**24
    at the top, if the values fill all 64 bits). The counts of the first two passes are stored,
    so Spark knows that the cells which the next scan is joined with are few, and broadcasts
    them; with very many groups it shuffles by group and cell instead.
    """
    keys = _keys(by)
    whole = F.col(value).cast("bigint").alias("value")
    named = [c.alias(k) for k, c in _named(by).items()]
    rows = df.filter(F.col(value).isNotNull()).select(*named, whole)
    # The two middle ranks of each group, counted from 0; equal for an odd count.
    group = Window.partitionBy(*keys)
    total = F.sum("n").over(group)
    middle = [F.call_function("div", total - odd, F.lit(2)) for odd in (1, 0)]
    found = _cell_of_rank(
        cells.filter(F.col("cell").isNotNull())
        .withColumn("ranks", F.array(*middle))
        .withColumn("upto", F.sum("n").over(group.orderBy("cell")))
        .select("*", F.posexplode("ranks").alias("side", "rank")),
        keys,
    )
    for shift in _SHIFTS[1:]:
        parents = found.select(*keys, "parent").distinct()
        narrowed = rows.alias("c").join(
            parents.alias("f"),
            _same("c", "f", keys)
            & (F.shiftright(F.col("c.value"), shift + _BITS) == F.col("f.parent")),
        )
        inside = (
            narrowed.select(
                *[F.col(f"c.{k}").alias(k) for k in keys],
                "parent",
                F.shiftright(F.col("c.value"), shift).alias("cell"),
            )
            .groupBy(*keys, "parent", "cell")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        if shift:
            inside = stored(inside, "cells")
        ranked = inside.alias("c").join(
            found.alias("f"),
            _same("c", "f", keys) & (F.col("c.parent") == F.col("f.parent")),
        )
        ordered = Window.partitionBy(*keys, "side").orderBy("cell")
        found = _cell_of_rank(
            ranked.select(
                *[F.col(f"c.{k}").alias(k) for k in keys], "cell", "n", "side", "rank"
            ).withColumn("upto", F.sum("n").over(ordered)),
            keys,
        )
    median = found.groupBy(*keys).agg((F.sum("parent") / 2).alias("median"))
    return median.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys[1:], strict=True)], "median"
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by`` plus ``median`` (double) of the bigint column ``value``; NULLs skipped.

    The built-in exact median keeps every distinct value of a group in one task.
    Here values are counted first, then summed up into cells that share all but
    their last 20 and last 40 bits. Running counts from the coarsest cells down
    find the cell that holds the middle rank. A window spans the cells below one
    parent only, at most 2**20 of them (2**24 at the top, if the values fill all
    64 bits), so one group with most of the rows still spreads over all tasks.
    """
    keys = [f"_k{i}" for i in range(len(by) + 1)]
    named = [F.lit(0).alias(keys[0])]
    named += [F.col(c).alias(k) for c, k in zip(by, keys[1:], strict=True)]
    exact = (
        df.filter(F.col(value).isNotNull())
        .select(*named, F.col(value).cast("bigint").alias("cell"))
        .groupBy(*keys, "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = {0: exact}
    for shift in reversed(_SHIFTS[:-1]):
        levels[shift] = (
            levels[shift - _BITS]
            .groupBy(*keys, F.shiftright("cell", _BITS).alias("cell"))
            .agg(F.sum("n").alias("n"))
        )

    # The two middle ranks of each group, counted from 0; equal for an odd count.
    group = Window.partitionBy(*keys)
    total = F.sum("n").over(group)
    middle = [F.call_function("div", total - odd, F.lit(2)) for odd in (1, 0)]
    found = _cell_of_rank(
        levels[_SHIFTS[0]]
        .withColumn("ranks", F.array(*middle))
        .withColumn("upto", F.sum("n").over(group.orderBy("cell")))
        .select("*", F.posexplode("ranks").alias("side", "rank")),
        keys,
    )
    for shift in _SHIFTS[1:]:
        inside = levels[shift].alias("c").join(
            found.alias("f"),
            # Null-safe throughout: plain equality would add a null filter below
            # the aggregation, and its shuffle could no longer be reused.
            _same("c", "f", keys)
            & F.shiftright("c.cell", _BITS).eqNullSafe(F.col("f.parent")),
        )
        ordered = Window.partitionBy(*keys, "side").orderBy("cell")
        found = _cell_of_rank(
            inside.select(
                *[F.col(f"c.{k}").alias(k) for k in keys], "cell", "n", "side", "rank"
            ).withColumn("upto", F.sum("n").over(ordered)),
            keys,
        )
    median = found.groupBy(*keys).agg((F.sum("parent") / 2).alias("median"))
    return median.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys[1:], strict=True)], "median"
    )
