"""Numbers for rows that repeat each other.

Where a hash of a row decides something, equal rows would all be decided alike, and a
group of them would stay one group however large it is. Their numbers tell them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored

KEYS = ["rc_key1", "rc_key2"]


def numbered(rows: DataFrame, equal_in: Sequence[str]) -> DataFrame:
    """``rows`` with ``rc_key1`` and ``rc_key2``, 128 bits of the columns ``equal_in``, and ``rc_number``.

    The number is 0 for a row that no other equals in those columns, and 0 to m - 1 for m
    rows that equal each other, in any order. Nulls equal nulls; an empty table gives no rows.

    Equal rows are counted in each task first; each task then numbers its own rows from
    where the tasks before it end, so no window is larger than a part of ``rows`` as it is
    read. The rows are read again for that, so ``rows`` should be a stored table.
    """
    nulls = [F.isnull(c) for c in equal_in]
    keys = [F.xxhash64(F.lit(n), *nulls, *equal_in).alias(k) for n, k in enumerate(KEYS)]
    marked = rows.select("*", *keys, F.spark_partition_id().alias("rc_part"))
    of_key = Window.partitionBy(*KEYS)
    before = of_key.orderBy("rc_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy(*KEYS, "rc_part").count()
    parts = parts.select(
        *KEYS,
        "rc_part",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rc_before"),
        F.sum("count").over(of_key).alias("rc_many"),
    )
    parts = stored(parts.filter("rc_many > 1").drop("rc_many"), "repeated")
    once = marked.withColumn("rc_number", F.lit(0).cast("long")).drop("rc_part")
    if parts.isEmpty():
        return once
    repeated = parts.select(*KEYS).distinct()
    # No sort of the rows: those of a task that equal each other may come in any order.
    mine = Window.partitionBy(*KEYS, "rc_part").orderBy(F.lit(0))
    place = F.coalesce("rc_before", F.lit(0)) + F.row_number().over(mine) - 1
    again = marked.join(repeated, KEYS, "left_semi").join(parts, [*KEYS, "rc_part"], "left")
    again = again.withColumn("rc_number", place.cast("long"))
    return once.join(repeated, KEYS, "left_anti").select(*rows.columns, *KEYS, "rc_number").unionByName(
        again.select(*rows.columns, *KEYS, "rc_number")
    )
