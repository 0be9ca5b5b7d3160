"""A uniform shuffle of documents into shards of exact sizes, by a communication matrix.

Documents lie in blocks (by a hash of the row and, if others equal it, its number). How many of each block's documents go
to each shard is drawn first, from the multivariate hypergeometric law, so that every
shard gets its exact number. Each block is then permuted by itself and cut at these
counts, the parts are exchanged, and every shard is permuted again: in parts of its own,
each put in random order, one after the other.

All work on rows is DataFrame functions; windows run over blocks and parts, never over
a shard. The driver draws the matrix, which has at most ``MAX_BLOCKS`` x shards counts.

Law: `rows`, shard sizes differ by one at most. Nulls: a null text has size 1 and the
checksum 0 of the empty text; a null document id is a value like any other. Rows that
repeat each other are numbered and fall apart into any blocks and shards, so a large group
of equal texts (the contract's groups) is spread like other rows. An empty table gives no
rows. Columns keep their names, but for ``shard`` and ``slot``, which are set.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import stored
from .copies import KEYS, numbered

BLOCK_ROWS = 4096
MAX_BLOCKS = 16_384


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of ``draws`` without return are good: inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    peak = math.exp(
        _log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws)
    )
    left = rng.random() - peak
    down = up = mode
    p_down = p_up = peak
    while left >= 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given sums of rows and columns, as a uniform shuffle would give."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for draws in rows:
        counts, among = [], sum(left)
        for room in left:
            among -= room
            got = hypergeometric(room, among, draws, rng)
            counts.append(got)
            draws -= got
        left = [room - got for room, got in zip(left, counts, strict=True)]
        matrix.append(counts)
    return matrix


def _hashed(seed: int, step: int) -> Column:
    return F.xxhash64(*KEYS, "rc_number", F.lit(seed), F.lit(step))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few values, as text that Spark reads: no Python on executors."""
    text = "\n".join(" ".join(map(str, r)) for r in rows)
    names = [c.split() for c in schema.split(",")]
    parts = F.split("line", " ")
    return (
        spark.range(1)
        .select(F.explode(F.split(F.lit(text), "\n")).alias("line"))
        .filter(F.col("line") != "")
        .select(*[parts[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)])
    )


def shard_uniformly(
    docs: DataFrame, shards: int = 8, seed: int = 29, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``docs`` (narrow rows) with ``shard`` and ``slot``.

    ``docs`` is stored once, since it is counted before it is dealt out.
    """
    spark = docs.sparkSession
    narrow = stored(docs.select(F.struct("*").alias("doc")), "shard-rows")
    rows = numbered(narrow, ["doc"])
    total = narrow.count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // block_rows)))
    placed = rows.withColumn("sh_block", F.pmod(_hashed(seed, 0), F.lit(blocks)))
    counts = dict(map(tuple, placed.groupBy("sh_block").count().collect()))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    keys = sorted(counts)
    matrix = communication_matrix([counts[b] for b in keys], sizes, seed)
    cuts = [
        (b, s, sum(row[:s]), sum(row[: s + 1]))
        for b, row in zip(keys, matrix, strict=True)
        for s in range(shards)
    ]
    # One row per block: its cuts, in order of shard.
    ends = (
        _small(spark, cuts, "sh_block long, sh_shard int, sh_from long, sh_to long")
        .groupBy("sh_block")
        .agg(F.array_sort(F.collect_list("sh_to")).alias("sh_cuts"))
    )
    first = Window.partitionBy("sh_block").orderBy(_hashed(seed, 1), *KEYS)
    local = placed.withColumn("sh_rank", F.row_number().over(first) - 1)
    shard = F.size(F.filter("sh_cuts", lambda cut: cut <= F.col("sh_rank")))
    # At most MAX_BLOCKS rows.
    dealt = local.join(F.broadcast(ends), "sh_block").withColumn("shard", shard)
    dealt = dealt.withColumn("sh_part", F.pmod(_hashed(seed, 2), F.lit(max(1, blocks // shards))))
    dealt = stored(dealt.drop("sh_block", "sh_rank", "sh_cuts"), "shards")
    in_shard = Window.partitionBy("shard").orderBy("sh_part")
    n = F.col("count")
    parts = dealt.groupBy("shard", "sh_part").count()
    parts = parts.select("shard", "sh_part", (F.sum(n).over(in_shard) - n).alias("sh_before"))
    second = Window.partitionBy("shard", "sh_part").orderBy(_hashed(seed, 3), *KEYS)
    # As many parts as blocks at most.
    return (
        dealt.join(F.broadcast(parts), ["shard", "sh_part"])
        .withColumn("slot", F.col("sh_before") + F.row_number().over(second) - 1)
        .select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def document_digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of text, plus 1) and checksum of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 29) -> DataFrame:
    """Every document's shard and slot, under the law that counts are equal."""
    dealt = shard_uniformly(document_digests(docs), shards, seed)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
