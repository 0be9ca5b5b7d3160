"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Every partition packs its own pieces by best fit, longest first. Bins that are nearly
full are done. The others go up a tree as items of their own: each node takes the open
bins of ``FAN_IN`` nodes below and packs them by best fit again.

Two bins over half full never fit together, and two others always do, so a node leaves one
bin at most that is not over half full. Only these look for a place further up: no more than
there are partitions. So a node carries up that many open bins, those with the most room
(``CARRIED`` if that is more); whoever finds no room among them would find none among
the rest, which are done as they are. Memory is bounded, and no sequence is added by it.

Nulls: a null text is an empty one, a document of the end id alone. A null document id
is kept. Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import TEXT_BATCH, stored
from .tokens import encoded_documents

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBERS = ("doc_id", "piece", "start", "length", "ids_crc32")
_BINS = (
    "node long, done boolean, rank int, filled int, sequence_id long, doc_id array<long>, "
    "piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>, "
    "offset array<long>"
)
_NO_ID = -(1 << 63)
FAN_IN = 8
# Open bins that one node carries up, or as many as there are partitions if those are more.
CARRIED = 50_000


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096
) -> DataFrame:
    """The token ids of each document in pieces of ``capacity``; only the last is shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, lengths in encoded_documents(batches, tokenizer, end_id):
            pieces = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            size = np.minimum(lengths[row] - start, capacity)
            at = (np.cumsum(lengths) - lengths)[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, size, strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return whole.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item, longest first, goes where least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r is set if a bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        left = room - size
        by_room[left].append(b)
        used |= 1 << left
    return bins


def _packed(
    level: int, node: int, items: pd.DataFrame, capacity: int, slack: int, last: bool
) -> pd.DataFrame:
    """One node's bins. ``items`` holds lists of members and how many tokens they have.

    ``rank``: the bin's place among the node's bins by room, the emptiest first.
    """
    sizes = items["filled"].to_numpy()
    bins = best_fit(sizes, capacity)
    filled = np.array([sizes[b].sum() for b in bins], dtype=np.int32)
    done = np.full(len(bins), last) | (capacity - filled <= slack)
    rank = np.empty(len(bins), dtype=np.int32)
    rank[np.argsort(filled, kind="stable")] = np.arange(len(bins))
    number = (level << 56) + (node << 28) + np.arange(len(bins))
    out = {"node": node, "done": done, "rank": rank, "filled": filled, "sequence_id": number}
    for c in _MEMBERS:
        lists = items[c].to_numpy()
        out[c] = [np.concatenate([lists[i] for i in b]) for b in bins]
    out["offset"] = [np.cumsum(n) - n for n in out["length"]]
    return pd.DataFrame(out)


def _in_order(items: pd.DataFrame) -> pd.DataFrame:
    """The same order however the rows arrived, so that a lost task packs alike."""
    keys = list(zip(*(map(tuple, items[c]) for c in _MEMBERS), strict=True))
    return items.iloc[sorted(range(len(items)), key=keys.__getitem__)].reset_index(drop=True)


def pack(pieces: DataFrame, capacity: int = 4096, slack: int | None = None) -> DataFrame:
    """``pieces`` (columns of `PIECES`) with ``sequence_id`` and ``offset``.

    ``slack``: a bin with no more room than this is done at once; 1/256 of the capacity
    if not given.
    """
    slack = capacity // 256 if slack is None else slack

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [f for f in frames if len(f)]
        if found:
            rows = pd.concat(found).sort_values(list(_MEMBERS), ignore_index=True)
            items = pd.DataFrame({"filled": rows["length"].to_numpy()})
            for c in _MEMBERS:
                items[c] = list(rows[c].to_numpy()[:, None])
            node = TaskContext.get().partitionId()
            yield _packed(0, node, items, capacity, slack, False)

    def merged(level: int, last: bool):
        def merge(key, items: pd.DataFrame) -> pd.DataFrame:
            return _packed(level, int(key[0]), _in_order(items), capacity, slack, last)

        return merge

    # A null document id would turn the column into floating point.
    whole = pieces.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), *_MEMBERS[1:])
    bins = stored(whole.mapInPandas(leaf, _BINS), "packing")
    nodes = (bins.agg(F.max("node")).first()[0] or 0) + 1
    goes_up = ~F.col("done") & (F.col("rank") < max(CARRIED, nodes))
    full, level = bins.filter(~goes_up), 0
    while nodes > 1 or not level:
        level, nodes = level + 1, -(-nodes // FAN_IN)
        above = bins.filter(goes_up).withColumn("node", F.floor(F.col("node") / FAN_IN))
        merge = merged(level, last=nodes == 1)
        bins = stored(above.groupBy("node").applyInPandas(merge, _BINS), "packing")
        full = full.unionByName(bins.filter(~goes_up))
    members = F.explode(F.arrays_zip(*_MEMBERS, "offset")).alias("m")
    return full.select("sequence_id", members).select(
        F.nullif("m.doc_id", F.lit(_NO_ID)).alias("doc_id"),
        *[F.col(f"m.{c}").alias(c) for c in _MEMBERS[1:]],
        "sequence_id",
        "m.offset",
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096
) -> DataFrame:
    """Every document of ``docs`` as token pieces, each with its place in a sequence.

    Texts are encoded once: the narrow table of pieces is stored before it is packed.
    """
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces", TEXT_BATCH)
    return pack(pieces, capacity)
