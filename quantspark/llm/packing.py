"""Packing documents into fixed windows by minimum bin slack.

Every document is tokenised and ends with an end id.  Whole windows are cut off a document's front; the remainders,
shorter than a window, are dealt to shards of about ``shard_docs`` documents by a hash, which pack independently.  A
shard opens a window with its longest remaining piece and finds, by subset-sum dynamic programming over a bitset of
reachable fills, the multiset of remaining lengths that fills the window closest to its capacity; the counts are
backtracked through the saved bitsets.  A found multiset is used as often as the remaining counts allow.  Where no
multiset fits exactly, the shortest remaining piece is cut to fill the slack, so at most the last window of a shard is
padded.

Only lengths and positions go through the packing; ids meet their places in one join, a row per document.

Defined results: null or empty text is one end id; rows that repeat a doc_id, or have none, are packed as documents of
their own; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, small_batches
from . import kernel
from .tokens import Encoder

WINDOW = 2048
PIECE = "key long, start long, length long, sequence_id long, offset long"


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Multiset {length: count} within ``counts`` (index = length) whose sum is closest to ``capacity`` from below.

    The longest length is in it.  Lengths are offered from long to short in power-of-two batches; each batch shifts the
    bitset of reachable sums once.  The search ends as soon as the capacity itself can be reached.
    """
    lengths = np.flatnonzero(counts[: capacity + 1])[::-1].tolist()
    if not lengths:
        return {}
    first = lengths[0]
    mask, target = (1 << (capacity + 1)) - 1, 1 << capacity
    bits = 1 << first
    steps: list[tuple[int, int, int]] = []  # (length, how many, bitset before)
    for length in lengths:
        left = min(int(counts[length]) - (length == first), (capacity - first) // length)
        batch = 1
        while left > 0 and not bits & target:
            batch = min(batch, left)
            steps.append((length, batch, bits))
            bits |= (bits << (length * batch)) & mask
            left -= batch
            batch *= 2
        if bits & target:
            break
    total = bits.bit_length() - 1
    chosen = {first: 1}
    for length, batch, before in reversed(steps):
        if not before >> total & 1:
            total -= length * batch
            chosen[length] = chosen.get(length, 0) + batch
    return chosen


def pack_lengths(lengths: list[tuple[int, int, int]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, start, length, window, offset) for pieces (key, start, length), all at most ``capacity`` long."""
    piles: dict[int, list[tuple[int, int]]] = {}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for key, start, length in sorted(lengths, reverse=True):
        piles.setdefault(length, []).append((key, start))
        counts[length] += 1
    window = 0
    while chosen := best_fill(counts, capacity):
        fill = sum(length * n for length, n in chosen.items())
        times = min(int(counts[length]) // n for length, n in chosen.items()) if fill == capacity else 1
        for _ in range(times):
            offset = 0
            for length, n in chosen.items():
                for _ in range(n):
                    key, start = piles[length].pop()
                    yield key, start, length, window, offset
                    offset += length
            window += 1
        for length, n in chosen.items():
            counts[length] -= n * times
        if fill < capacity and counts.any():
            # nothing that is left fits the slack, so every remaining piece is longer than it: cut one
            slack, shortest = capacity - fill, int(np.flatnonzero(counts)[0])
            key, start = piles[shortest].pop()
            counts[shortest] -= 1
            yield key, start, slack, window - 1, fill
            piles.setdefault(shortest - slack, []).append((key, start + slack))
            counts[shortest - slack] += 1


def _tokenise(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, spaces=True)
        for whole in batches:
            for batch in kernel.slices(whole, limit=1 << 20):
                ids, counts = encoder.encode(batch.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
                cuts = np.concatenate([[0], np.cumsum(counts + 1)])
                parts = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(counts + 1), pa.array(parts, pa.binary())], ["key", "doc_id", "n", "ids"])

    return run


def _pack(window: int):
    def run(table: pa.Table) -> pa.Table:
        keys, sizes, shard = table.column("key").to_pylist(), table.column("n").to_pylist(), table.column("shard")[0].as_py()
        base, made, rest, number = shard << 32, [], [], 0
        for key, n in sorted(zip(keys, sizes, strict=True)):
            whole = n // window
            for i in range(whole):
                made.append((key, i * window, window, base + number, 0))
                number += 1
            if n % window:
                rest.append((key, whole * window, n % window))
        made += [(key, start, length, base + number + w, offset) for key, start, length, w, offset in pack_lengths(rest, window)]
        columns = list(zip(*made, strict=True)) or [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "length", "sequence_id", "offset"])

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                pieces = batch.column("pieces")
                row = np.repeat(np.arange(batch.num_rows), pieces.value_lengths().to_numpy())
                flat = pieces.flatten()
                ids = [np.frombuffer(x.as_buffer(), f"<u{width}") for x in batch.column("ids")]
                start, length = flat.field("start").to_pylist(), flat.field("length").to_pylist()
                parts = [ids[r][s : s + n].astype("<u4").tobytes() for r, s, n in zip(row.tolist(), start, length, strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), flat.field("start"), flat.field("length"), pa.array(parts, pa.binary()), batch.column("n").take(take), flat.field("sequence_id"), flat.field("offset")],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, shard_docs: int = 8192) -> DataFrame:
    """doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset of every piece."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    # ids of small vocabularies take two bytes on their way
    width = 2 if max(Encoder.of(tokenizer, spaces=True).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    tokens = materialise(keyed.mapInArrow(_tokenise(tokenizer, end_id, width), "key long, doc_id long, n long, ids binary"), "pack-tokens")
    shards = max(1, tokens.count() // shard_docs)
    sized = tokens.select("key", "n", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    pieces = materialise(sized.groupBy("shard").applyInArrow(_pack(window), PIECE), "pack-pieces")
    places = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = tokens.join(places, "key").select("doc_id", "n", "ids", "pieces")
    return joined.mapInArrow(_cut(width), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
