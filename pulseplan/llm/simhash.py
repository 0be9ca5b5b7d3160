"""SimHash near-duplicates, compared bit by bit on whole blocks.

Fingerprints of equal value are one from the start. Two that differ in at most
``radius`` of 64 bits agree on all but ``radius`` of ``radius + 3`` parts of their bits,
so each fingerprint is dealt out under every choice of three parts that may agree
(for radius 2: ten keys of about 38 bits), and fingerprints of one key lie together.

A task takes its rows in order of key and compares them in blocks: the block's
fingerprints stand vertically, one bit plane for each of the 64 bits; carry-save
counters add up the differing bits of 64 fingerprints with a few bitwise operations, and
blocks in which all have passed the radius are given up early. Only links that join
what was not yet joined in the block go on, so a group of m fingerprints makes fewer
than m links. A key with more than ``BLOCK`` fingerprints is split: its fingerprints
fall into chunks and every two chunks are compared in a task of their own.

Nulls: a null text is empty; without words the fingerprint is zero and links like any
other. A null document id is a document of its own, and the smallest id of a group only
if the group has no other. Repeated ids and rows link like all others. An empty table
gives no rows. Columns that a document brings keep their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import TEXT_BATCH, stored
from .components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SEED = 42
SHINGLE, RADIUS = 3, 2
BLOCK = 2048
_STEP = 1 << 16  # shingles whose bits are counted at once


def shingles(text: str, size: int) -> list[str]:
    """Runs of ``size`` words, repeats included; of fewer words, all of them as one."""
    words = WORD.findall(text.translate(_LOWER))
    if len(words) <= size:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def fingerprint(text: str, size: int) -> int:
    """A bit is set if it is set in the hashes of over half the shingles."""
    parts = shingles(text, size)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(parts), _STEP):
        some = parts[at : at + _STEP]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in some), dtype="<u8", count=len(some)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` (longs) and ``fp``, the 64 bits as a signed number, for each row."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text")
                found = [fingerprint(t.as_py() or "", size) for t in texts]
                signed = np.array(found, dtype=np.uint64).view(np.int64)
                own = {c: part.column(c) for c in keep}
                yield pa.record_batch(own | {"fp": pa.array(signed, pa.int64())})

    rows = docs.select(*[F.col(c).cast("long") for c in keep], F.col("text").cast("string"))
    return rows.mapInArrow(mapper, ", ".join(f"{c} long" for c in (*keep, "fp")))


def _keys(radius: int) -> Column:
    """One key for each choice of parts on which near fingerprints may agree."""
    parts = radius + 3 if radius else 1
    edges = [64 * p // parts for p in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(masks, parts - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed)), F.lit(n)))
    return F.array(*keys)


def near_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with i < j of a block that differ in at most ``radius`` bits."""
    n = len(fps)
    if n < 2:
        return
    words = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, 64), dtype=np.uint8)
    padded[:n] = bits
    # planes[b, w]: bit b of the fingerprints 64 w to 64 w + 63.
    planes = np.packbits(padded.T.copy(), axis=1, bitorder="little").view("<u8")
    ones = (bits.T.astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)).copy()
    levels = radius.bit_length() + 1
    for top in range(0, n, 512):  # queries of one step
        rows = np.arange(top, min(top + 512, n))
        # Cells: a query and a word of 64 fingerprints, from the query's own word on.
        q, w = np.nonzero(np.arange(words)[None, :] >= (rows // 64)[:, None])
        q = q + top
        counter = [np.zeros(len(q), dtype=np.uint64) for _ in range(levels)]
        over = np.zeros(len(q), dtype=np.uint64)
        for b in range(64):
            carry = planes[b][w] ^ ones[b][q]
            for level in range(levels):  # carry-save: add one bit to 64 counters
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            over |= carry
            if b % 4 == 3:
                over |= _above(counter, radius)
                alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    counter = [c[alive] for c in counter]
                if not len(q):
                    break
        if len(q):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, bit = np.nonzero(near)
            i, j = q[cell], w[cell] * 64 + bit
            real = (j > i) & (j < n)
            yield i[real], j[real]


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Which of the counters, stored bit by bit, are above ``radius``."""
    above = np.zeros_like(counter[0])
    equal = ~above
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counter[level]
        else:
            above |= equal & counter[level]
            equal &= ~counter[level]
    return above


def _joining(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the block's near fingerprints, one less than each group has."""
    parent = list(range(len(fps)))
    a, b = [], []
    for left, right in near_pairs(fps, radius):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            while parent[j] != j:
                parent[j] = parent[parent[j]]
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                a.append(i)
                b.append(j)
    return fps[a], fps[b]


def _links(radius: int):
    """Compares rows (key, chunks, fp), sorted by key and chunks, block by block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = np.zeros(0, dtype=np.int64)
        fp = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
            new = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            fp = np.concatenate((fp, new))
            while len(key) > 4 * BLOCK:
                # Cut where a key begins; a key has 2 * BLOCK rows or so at most.
                starts = np.flatnonzero(np.diff(key[: 4 * BLOCK + 1])) + 1
                cut = int(starts[-1]) if len(starts) else len(key)
                yield key[:cut], fp[:cut]
                key, fp = key[cut:], fp[cut:]
        yield key, fp

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in blocks(batches):
            same = np.zeros(len(key) + 1, dtype=bool)
            same[1:-1] = key[1:] == key[:-1]
            # Any near pair is a link, whichever keys have brought it into the block.
            a, b = _joining(np.unique(fp[same[1:] | same[:-1]]), radius)
            columns = {"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))}
            yield pa.record_batch(columns)

    return mapper


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join all of ``fp`` in ``distinct`` that are near each other."""
    keyed = distinct.select("fp", F.explode(_keys(radius)).alias("key"))
    crowded = keyed.groupBy("key").count().filter(F.col("count") > BLOCK)
    chunks = F.ceil(F.col("count") / (BLOCK // 2)).cast("int")
    crowded = stored(crowded.select("key", chunks.alias("chunks")), "crowded")
    # Of a crowded key, each fingerprint goes to the pairs of chunks that its own is in.
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    pair = F.transform(
        others, lambda c: F.xxhash64("key", F.least(mine, c), F.greatest(mine, c))
    )
    split = keyed.join(crowded, "key").select(F.explode(pair).alias("key"), "fp")
    plain = keyed.join(crowded, "key", "left_anti").select("key", "fp")
    rows = plain.unionByName(split).repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(_links(radius), "a long, b long")


def _labels(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct`` (with ``fp``) with ``label``, the same for all of a group."""
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius))
    joined = distinct.join(groups, F.col("fp") == F.col("node"), "left")
    return joined.withColumn("label", F.coalesce("label", "fp")).drop("node")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` (the smallest id of the group) for each row."""
    marked = stored(fingerprints(docs, size), "fingerprints", TEXT_BATCH)
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    labelled = _labels(distinct, radius)
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = labelled.join(least, "label").select("fp", "component_id")
    return marked.join(of_fp, "fp")


def first_of_groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: that of the smallest id, of a null id only if there is no other.

    Of texts that share that id, one goes by its checksums; of rows that share id and text,
    any one. Documents are told apart by 128 bits of id and text.
    """
    keys = ["key1", "key2"]
    told = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    hashed = [F.xxhash64(F.lit(n), F.isnull(told[0]), *told).alias(k) for n, k in enumerate(keys)]
    narrow = docs.select(told[0].alias("doc_id"), told[1].alias("text"), *hashed)
    marked = stored(fingerprints(narrow, size, ("doc_id", *keys)), "fingerprints", TEXT_BATCH)
    order = F.struct(F.isnull("doc_id"), "doc_id", *keys)
    distinct = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    first = _labels(distinct, radius).groupBy("label").agg(F.min("first").alias("first"))
    # How often the chosen documents occur; most do once, and are not shuffled for it.
    times = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    chosen = first.select(*[f"first.{k}" for k in keys]).join(times, keys)
    chosen = stored(chosen, "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *hashed)
    once = rows.join(chosen.filter("times = 1"), keys).select("doc.*")
    repeated = rows.join(chosen.filter("times > 1"), keys).dropDuplicates(keys).select("doc.*")
    return once.unionByName(repeated)


def digests(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint in hexadecimal digits and component_id."""
    found = near_duplicates(docs, size, radius)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
