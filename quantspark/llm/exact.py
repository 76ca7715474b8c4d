r"""Exact deduplication with an extendible-hash index on shared files.

1. Scan: texts are normalised (white-space runs become one space) and hashed.  Each task folds its equal texts into one
   entry (smallest doc_id, count), so a text that a third of all rows hold reaches its owner once per task and flush.
   The entries are written as segment files to the shared folder.
2. Directory: starting from one bucket, every bucket with more than ``bucket_rows`` entries is split by one more bit of
   the key; where its local depth equals the global depth, the directory doubles.  It is built from counts per key
   prefix, whose number follows the number of buckets, not of documents.
3. Owners: each owner task gets a contiguous range of buckets, sorts its entries by key and walks over them.  Entries of
   one key form a chain: a text is compared byte by byte with the chain's texts and joins one or extends the chain.
   An owner streams, so a bucket that cannot be split (one key, or the depth limit) is processed exactly all the same.
4. The index (key, SHA-256, smallest doc_id, size) is written next to the segments and joined back to the documents.

Defined results: null text is empty; a null doc_id sorts after every other, and a group without any id has a null
keep_id; of rows that repeat the keeper's doc_id all stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dispose, materialise, small_batches

NO_ID = 9223372036854775807
FLUSH_BYTES = 16 << 20
ENTRY = "key long, sha binary, text string, first long, n long"
GROUP = "key long, chain int, sha binary, first long, n long"


def normalised(text: Column) -> Column:
    """One space for each run of space or U+0009..U+000D; single spaces need no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one task: equal texts, by SHA-256 and then by their bytes, are folded until the buffer is flushed."""
    schema = pa.schema([("key", pa.int64()), ("sha", pa.binary()), ("text", pa.string()), ("first", pa.int64()), ("n", pa.int64())])
    held: dict[tuple, list[int]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(sha, text, key, first, n) for (sha, text), (key, first, n) in held.items()]
        arrays = [[r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
        return pa.record_batch([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    for batch in batches:
        rids, texts = batch.column("rid").to_pylist(), batch.column("text")
        for i, rid in enumerate(rids):
            text = texts[i].as_py()
            data = text.encode()
            sha = hashlib.sha256(data).digest()
            entry = held.get((sha, text))
            if entry is None:
                # the first 63 bits of the hash are the key, as a number that is not negative
                held[sha, text] = [int.from_bytes(sha[:8], "big") >> 1, rid, 1]
                size += len(data) + 200
                if size > FLUSH_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
            else:
                entry[1] = min(entry[1], rid)
                entry[2] += 1
    if held:
        yield flush()


def build_directory(counts: dict[int, int], depth: int, bucket_rows: int) -> tuple[int, list[int]]:
    """(global depth, bucket of every prefix): buckets are split and the directory doubled until none is overfull.

    ``counts`` has the entries per ``depth``-bit prefix.  Buckets are numbered in key order.
    """
    prefix = [0] * ((1 << depth) + 1)
    for p in range(1 << depth):
        prefix[p + 1] = prefix[p] + counts.get(p, 0)
    held = lambda low, bits: prefix[(low + 1) << (depth - bits)] - prefix[low << (depth - bits)]
    global_depth, directory = 0, [(0, 0)]  # slot -> (prefix, local depth) of its bucket
    while True:
        overfull = {b for b in directory if b[1] < depth and held(*b) > bucket_rows}
        if not overfull:
            break
        if any(local == global_depth for _, local in overfull):
            directory = [b for b in directory for _ in range(2)]
            global_depth += 1
        for slot, (low, local) in enumerate(directory):
            if (low, local) in overfull:
                directory[slot] = (slot >> (global_depth - local - 1), local + 1)
    number = {b: i for i, b in enumerate(dict.fromkeys(directory))}
    return global_depth, [number[b] for b in directory]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk over entries sorted by key; one row for each text of a key's chain."""
    schema = pa.schema([("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("first", pa.int64()), ("n", pa.int64())])
    done: list[tuple] = []
    chain: list[list] = []
    current = None

    def close() -> None:
        done.extend((current, i, sha, first, n) for i, (_, sha, first, n) in enumerate(chain))
        chain.clear()

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        keys, firsts, ns = (batch.column(c).to_pylist() for c in ("key", "first", "n"))
        shas, texts = batch.column("sha"), batch.column("text")
        for i, key in enumerate(keys):
            if key != current:
                close()
                current = key
            data = texts[i].as_buffer()
            for link in chain:
                if link[0].equals(data):
                    link[2] = min(link[2], firsts[i])
                    link[3] += ns[i]
                    break
            else:
                chain.append([data, shas[i].as_py(), firsts[i], ns[i]])
        if len(done) > 50_000:
            yield out()
            done.clear()
        for link in chain:  # keep a copy, not the whole batch
            link[0] = pa.py_buffer(link[0].to_pybytes())
    close()
    if done:
        yield out()


def build_index(docs: DataFrame, bucket_rows: int = 4096, max_depth: int = 20) -> DataFrame:
    """The index of ``docs`` (doc_id, text): key, chain, sha, first, n of every distinct normalised text."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), normalised(F.col("text")).alias("text"))
    segments = materialise(slim.mapInArrow(_fold, ENTRY), "exact-segments")
    total = segments.count()
    depth = min(max_depth, max(1, (4 * total // bucket_rows).bit_length()))
    found = segments.groupBy(F.shiftright("key", 63 - depth).alias("p")).agg(F.count("*").alias("n"))
    global_depth, directory = build_directory({r["p"]: r["n"] for r in found.collect()}, depth, bucket_rows)
    buckets = directory[-1] + 1
    owners = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 * bucket_rows)))
    slots = spark.createDataFrame([(i, b * owners // buckets) for i, b in enumerate(directory)], "slot long, owner int")
    # the directory has at most 2**max_depth slots of a few bytes, whatever the number of documents
    placed = segments.withColumn("slot", F.shiftright("key", 63 - global_depth)).join(F.broadcast(slots), "slot").drop("slot")
    owned = placed.repartitionById(owners, "owner").sortWithinPartitions("key").drop("owner")
    index = materialise(owned.mapInArrow(_own, GROUP), "exact-index")
    dispose(segments)
    return index


def exact_dedup(docs: DataFrame, bucket_rows: int = 4096, max_depth: int = 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    index = build_index(docs, bucket_rows, max_depth)
    shas = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"))
    joined = shas.join(index.select("sha", "first", "n"), "sha")
    keep = F.when(F.col("first") != NO_ID, F.col("first"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
