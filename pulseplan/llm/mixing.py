"""Mixing of sources to target weights.

Token counts are summed per source; weights and the wanted total give each source a
target and so a repetition rate. A document is taken ``floor(rate)`` times, and once
more if a number drawn from its id, its text and a seed falls below the rate's fraction.

The rates are one row per source. They are stored before the join with the documents,
so that Spark knows their size: it broadcasts a small table, and otherwise shuffles and
splits hot sources. A hot source costs nothing in the sums, which combine in each task.

Nulls: a null text has no words; a null source is a source of its own, after all others;
a null document id is a value like any other. Rows equal in id, source and text are
numbered, and each number draws for itself, so that a large group of them meets its
source's rate too; reruns agree but for which of such rows is meant. A source without
words has rate 0 and target 0. An empty table gives no rows. Columns that a document
brings keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from .copies import numbered

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
_DRAW_BITS = 52


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the columns ``keys`` and ``seed`` alone."""
    told = [F.coalesce(F.col(key).cast("string"), F.lit("null")) for key in keys]
    name = F.concat_ws(":", F.lit(str(seed)), *told)
    digits = F.substring(F.md5(name), 1, _DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << _DRAW_BITS))


def source_rates(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    total_ratio: float = 1.5,
    max_rate: float = 2.0,
) -> DataFrame:
    """source, source_size, target and rate, from rows of ``source`` and ``size``.

    The weights repeat over the sources in ascending order, null last. The sources share
    ``total_ratio`` times all sizes by weight; none gets more than ``max_rate`` times
    its own, and what is above is shared by weight among the rest until none is above.

    That ends at one level L with targets ``min(max_rate * size, L * weight)``. Sources
    reach their bound in ascending order of bound / weight, so running sums in that
    order give L: from the first source on that L does not fill.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # From here on one row per source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, map(float, weights))),
        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
    )
    bound = F.lit(float(max_rate)) * F.col("source_size")
    fills = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn("weight", weight).withColumn("bound", bound)
    ranked = ranked.select(
        "*",
        (F.sum("bound").over(fills) - F.col("bound")).alias("filled"),
        F.sum("weight").over(rest).alias("open_weight"),
        F.sum("source_size").over(everything).alias("all_sizes"),
    )
    level = (total_ratio * F.col("all_sizes") - F.col("filled")) / F.col("open_weight")
    fits = F.col("bound") / F.col("weight") >= F.col("level")
    leveled = ranked.withColumn("level", level)
    # Without a source that stays below its bound, every source is at it.
    water = F.min(F.when(fits, F.struct(F.col("bound") / F.col("weight"), "level"))).over(everything)
    target = F.least(
        "bound", F.coalesce(F.col("weight") * water.getField("level"), F.col("bound"))
    )
    return leveled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    )


def text_sum() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5")


def with_copies(rows: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """``rows`` with ``mix_size``, ``mix_target`` and ``mix_copies``: how often each is taken.

    They have doc_id, source, ``text_md5`` and other columns that do not start with ``mix_`` or ``rc_``.
    """
    mine = stored(
        rates.select(
            F.col("source").alias("mix_source"),
            F.col("source_size").alias("mix_size"),
            F.col("target").alias("mix_target"),
            F.col("rate").alias("mix_rate"),
        ),
        "rates",
    )
    told = numbered(rows, ["doc_id", "source", "text_md5"])
    whole = F.floor("mix_rate")
    extra = uniform(["doc_id", "text_md5", "rc_number"], seed) < F.col("mix_rate") - whole
    return told.join(mine, F.col("source").eqNullSafe(F.col("mix_source"))).select(
        *rows.columns, "mix_size", "mix_target", (whole + extra.cast("int")).alias("mix_copies")
    )


def mix(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """``docs`` with each document as often as the mix takes it; columns as they were."""
    rates = source_rates(docs.select("source", word_count().alias("size")), **shares)
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", text_sum())
    times = F.explode(F.array_repeat(F.lit(True), F.col("mix_copies").cast("int")))
    return with_copies(rows, rates, seed).select("doc", times.alias("time")).select("doc.*")


def mixing_plan(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """What the mix takes of each document: sizes, its source's target, words taken.

    The texts are read once; the rest works on the stored narrow table of sizes.
    """
    sizes = docs.select("doc_id", "source", word_count().alias("size"), text_sum())
    sizes = stored(sizes, "sizes")
    taken = with_copies(sizes, source_rates(sizes, **shares), seed)
    return taken.select(
        "doc_id",
        "size",
        F.col("mix_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


MIXING_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
         row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS number,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sizes GROUP BY source
), ranked AS (
  SELECT *, 2.0 * source_size AS bound,
         sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST
           ROWS UNBOUNDED PRECEDING) - 2.0 * source_size AS filled,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER () AS all_sizes
  FROM by_source
), leveled AS (
  SELECT *, (1.5 * all_sizes - filled) / open_weight AS level FROM ranked
), water AS (
  SELECT arg_min(level, bound / weight) AS level FROM leveled WHERE bound / weight >= level
), rates AS (
  SELECT source, source_size,
         least(bound, coalesce(weight * water.level, bound)) AS target
  FROM leveled, water
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, CAST(r.target AS DOUBLE) AS target,
         CASE WHEN r.source_size = 0 THEN 0.0 ELSE r.target / r.source_size END AS rate,
         CAST(CAST('0x' || substr(md5(concat_ws(':', '17',
                coalesce(CAST(d.doc_id AS VARCHAR), 'null'), text_md5, number)), 1, 13)
              AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sizes d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
