"""Token ids of documents in files of Simple-8b words, in ascending order of id.

The files are written by Spark's own committer, so that a lost executor leaves no half
file: parquet rows are frames of consecutive documents, each with the ids of all of them
as Simple-8b words (`simple8b`), the first word of each block of 1,024 ids, and the
documents' ids and lengths. Frames of one writing task are numbered, and tasks follow
each other in ascending document id.

Nulls: a null text is an empty one, a document of the end id alone; null document ids
come first. Repeated document ids follow each other, ordered by text. An empty table
gives an empty folder, which reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared_folder
from . import simple8b
from .tokens import encoded_documents

_FRAMES = (
    "task int, frame int, start long, n_ids long, doc_ids array<long>, "
    "lengths array<long>, blocks array<int>, words binary"
)
_DIGESTS = "task int, doc_id long, start long, n_tokens long, ids_crc32 long"
_TOKENS = "doc_id long, start long, ids array<long>"


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None
) -> str:
    """Encodes ``docs`` (doc_id, text) into ``folder``, a new shared one if not given.

    The texts are dealt out by ranges of document id once, before they are encoded.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, frame, start = TaskContext.get().partitionId(), 0, 0
        for part, ids, lengths in encoded_documents(batches, tokenizer, end_id):
            words, blocks = simple8b.encode(ids)
            yield pa.record_batch(
                {
                    "task": pa.array([task], pa.int32()),
                    "frame": pa.array([frame], pa.int32()),
                    "start": pa.array([start], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "blocks": pa.array([blocks.astype(np.int32)], pa.list_(pa.int32())),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                }
            )
            frame, start = frame + 1, start + len(ids)

    folder = folder or shared_folder(docs.sparkSession, "tokens")
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(frames, _FRAMES).write.parquet(folder)
    return folder


def _decoded(frame: dict) -> np.ndarray:
    words = np.frombuffer(frame["words"], dtype="<u8")
    return simple8b.decode(words, frame["n_ids"], np.array(frame["blocks"], dtype=np.int64))


def _read(spark: SparkSession, folder: str, mapper, schema: str) -> DataFrame:
    """Documents of the files, with ``start`` counted from the first document of all."""
    frames = spark.read.schema(_FRAMES).parquet(folder)
    # One row for each task that wrote: bounded by the partitions of one shuffle.
    tasks = frames.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("task")) - F.col("n")
    tasks = tasks.select("task", before.alias("before"))
    return (
        frames.mapInArrow(mapper, schema)
        .join(F.broadcast(tasks), "task")
        .withColumn("start", F.col("start") + F.col("before"))
        .drop("task", "before")
    )


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """For each document of the files: its place, length and checksum of its ids."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame in batch.to_pylist():
                ids = _decoded(frame).astype("<u4")
                lengths = np.array(frame["lengths"], dtype=np.int64)
                at = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, lengths, strict=True)]
                yield pa.record_batch(
                    {
                        "task": pa.array(np.full(len(at), frame["task"]), pa.int32()),
                        "doc_id": pa.array(frame["doc_ids"], pa.int64()),
                        "start": pa.array(at + frame["start"], pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return _read(spark, folder, digests, _DIGESTS)


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """For each document of the files: its place and its ids."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame in batch.to_pylist():
                lengths = np.array(frame["lengths"], dtype=np.int64)
                at = np.cumsum(lengths) - lengths
                parts = np.split(_decoded(frame).astype(np.int64), at[1:])
                yield pa.record_batch(
                    {
                        "task": pa.array(np.full(len(at), frame["task"]), pa.int32()),
                        "doc_id": pa.array(frame["doc_ids"], pa.int64()),
                        "start": pa.array(at + frame["start"], pa.int64()),
                        "ids": pa.array(parts, pa.list_(pa.int64())),
                    }
                )

    return _read(spark, folder, tokens, "task int, " + _TOKENS)
