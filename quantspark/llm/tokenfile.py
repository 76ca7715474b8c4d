"""Writing documents as token-id files in ascending doc_id order, and reading them back.

A table of token files has the columns ``shard, frame, kind, n_ids, data``: each row is one frame of the binary format
of :mod:`coder` (an index of documents, or a block of ids), and frames of a shard follow one another by number.  Spark's
own writer commits the files, so a lost executor or a repeated task leaves no half-written frame, and any store that
Spark can write to will do.  Shards are ranges of doc_id: range partitioning sorts the documents, so the order needs no
single task.

Defined results: null or empty text is one end id; null doc_ids come last; rows that repeat a doc_id stand next to each
other, by their texts; an empty table writes no frames and reads as an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import coder, kernel
from .storage import materialise, new_path, small_batches
from .tokens import Encoder

FRAMES = "shard int, frame long, kind int, n_ids long, data binary"
#: Plan size of the input, in bytes, that one shard takes at most.
SHARD_BYTES = 64 << 20


def _write(path: str, end_id: int):
    names = ["shard", "frame", "kind", "n_ids", "data"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(path, spaces=False)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            doc_ids, missing, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            frames = [coder.encode_index(doc_ids, missing, counts), *coder.encode_blocks(ids)]
            kinds = [coder.INDEX] + [coder.BLOCK] * (len(frames) - 1)
            sizes = [int(counts.sum())] + [0] * (len(frames) - 1)
            columns = [[shard] * len(frames), list(range(number, number + len(frames))), kinds, sizes, frames]
            number += len(frames)
            held.clear()
            size = 0
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for whole in batches:
            for batch in kernel.slices(whole, limit=1 << 20):
                ids, counts = encoder.encode(batch.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                doc_id = batch.column("doc_id")
                held.append((doc_id.fill_null(0).to_numpy(), np.asarray(doc_id.is_null()), counts + 1, ids))
                size += len(ids)
                if size >= coder.BLOCK_IDS * 3 // 4:
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into token files under ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // SHARD_BYTES, 1 << 20))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc("text")]
    placed = text.repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
    placed.mapInArrow(_write(tokenizer, end_id), FRAMES).write.option("compression", "uncompressed").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, at, index, blocks, left = None, 0, None, [], 0

    def group() -> pa.RecordBatch:
        nonlocal at
        doc_ids, missing, counts = index
        ids = coder.decode_blocks(blocks)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts * 4), pa.py_buffer(ids)])
        out = pa.record_batch(
            [pa.array([shard] * len(counts), pa.int32()), pa.array(doc_ids, mask=missing), pa.array(at + cuts[:-1]), pa.array(counts), parts.cast(pa.binary())],
            ["shard", "doc_id", "local", "n_tokens", "ids"],
        )
        at += int(cuts[-1])
        return out

    for batch in batches:
        for number, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if number != shard:
                shard, at = number, 0
            kind, count, _, _ = coder.unframe(data)
            if kind == coder.INDEX:
                index, blocks = coder.decode_index(data), []
                left = int(index[2].sum())
            else:
                blocks.append(data)
                left -= count
            if left == 0 and index is not None:
                yield group()
                index = None


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit little-endian) from the files."""
    small_batches(spark)
    frames = spark.read.schema(FRAMES).parquet(path)
    sizes = frames.where(F.col("kind") == coder.INDEX).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # a row per shard: as many as there are files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-bases")
    shards = (base.agg(F.max("shard")).first()[0] or 0) + 1
    ordered = frames.repartitionById(shards, "shard").sortWithinPartitions("shard", "frame")
    docs = ordered.select("shard", "data").mapInArrow(_read, "shard int, doc_id long, local long, n_tokens long, ids binary")
    joined = docs.join(base, "shard")
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    path = path or new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
