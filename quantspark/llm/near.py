r"""Near-duplicate detection with SetSketch registers.

1. One scan gives every document its distinct shingle hashes, a 128-bit digest of that set and ``m`` SetSketch
   registers: the minimum of m exponential hash values over the set, kept as the exponent floor(1 - log_b(min)), cut to
   16 bits.  Registers merge by maximum and agree with a probability close to the Jaccard similarity.
2. Documents with equal sets form a class; only classes are compared, so copies are never expanded into pairs.
3. Bands of ``rows`` registers are hashed; classes that share a band key are candidates.  Inside a bucket the class with
   the smallest document is the pivot, and all others are paired with it: as many pairs as rows.
4. The similarity of a pair is estimated jointly from both sketches by maximum likelihood (with the known set sizes);
   a pair goes on unless the likelihood of every similarity at the threshold or above is lower by ``slack`` nats.
5. Pairs that go on are verified on their full sets.  Verified links are closed into components.
6. Buckets that still hold several components may hide links that no pivot saw.  Classes with too many shingles of
   their own are ruled out, and so are pairs, by exact bounds from the first pivot's shingles; second pivots, different in every bucket, join most others, again with as
   many pairs as rows.  All pairs that then remain between different components of a bucket are tried as well (exact
   size bounds and one bit per register are compared inside the join, so only plausible pairs leave it), and the
   components are closed again.  No cap is set on buckets or partners.

With 32 bands of 5 registers a pair at similarity 0.8 misses all buckets with a probability of 3e-6.

Defined results: texts without words have an empty set and are linked with nothing; texts with fewer words than a
shingle have the whole word sequence as their only shingle; null doc_ids sort after every other; rows that repeat a doc_id
are compared like any others, each gets the class of its own text, and all of them whose id is the smallest of their class
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .storage import dispose, materialise, small_batches

NO_ID = 9223372036854775807
BANDS, ROWS = 32, 5
M = BANDS * ROWS
BASE, RATE = 1.001, 20.0
#: Partners of a pivot that are compared in one part.
PART_PAIRS = 1000
SLACK = 14.0
#: One bit per register: at similarity 0.8 about 16 of 160 bits differ, with a standard deviation of 3.8.
MOST_BITS = 40


def _register_seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    odd = rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, M, dtype=np.uint64)


_SEEDS = _register_seeds()


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = kernel.words_of(column)
    hashes = words.hashes(lower=True)
    grams, rows, _ = kernel.windows(hashes, words.ptr, k)
    cut = np.searchsorted(rows, np.arange(len(column) + 1))
    sets = []
    for i, n in enumerate(words.counts):
        if 0 < n < k:
            part = hashes[words.ptr[i] : words.ptr[i + 1]]
            sets.append(kernel.windows(part, np.array([0, n]), int(n))[0])
        else:
            sets.append(np.unique(grams[cut[i] : cut[i + 1]]))
    return sets


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes: exponents of exponentially distributed minima, cut to 16 bits."""
    odd, shift = _SEEDS
    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024, None] * odd[None, :]
        part += shift[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, 65535).astype(np.uint16)


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketch(k: int):
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole):
                sets = shingle_sets(batch.column("text"), k)
                nodes = [digest(s) if len(s) else None for s in sets]
                sketches = [registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch([batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())], schema=schema)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = batch.num_rows
        if not count:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(count, BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (count, BANDS)).copy()
        for r in range(ROWS):
            key = kernel.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, r].astype(np.uint64))
        take = pa.array(np.repeat(np.arange(count), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *(batch.column(c).take(take) for c in ("rep", "node", "n"))], ["key", "rep", "node", "n"])


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(goes on, estimated similarity) of pairs of register rows, by joint maximum likelihood."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    # the threshold itself is on the grid
    at = np.minimum(percent / 100, top)[:, None]
    grid = np.concatenate([grid, at], axis=1)
    plus, minus = _share(np.maximum(u[:, None] - v[:, None] * grid, 0)), _share(np.maximum(v[:, None] - u[:, None] * grid, 0))
    tiny = 1e-12
    like = up[:, None] * np.log(plus + tiny) + down[:, None] * np.log(minus + tiny) + same[:, None] * np.log(np.maximum(1 - plus - minus, 0) + tiny)
    high = np.where(grid >= at - 1e-12, like, -np.inf).max(axis=1)
    sizes_fit = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return sizes_fit & (high >= like.max(axis=1) - slack), grid[np.arange(len(grid)), like.argmax(axis=1)]


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("a_sketch", "b_sketch"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
            on, _ = plausible(a, b, na, nb, percent)
            yield batch.select(["a", "a_rep", "b", "b_rep"]).filter(pa.array(on))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole):
                sets = shingle_sets(batch.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), kernel.pack(sets)], ["node", "values"])

    return run


CHECKED = "a binary, b binary, linked boolean, inside array<long>"


def _verify(percent: int):
    """Whether a partner is linked with its pivot, and which of the pivot's shingles, in their order, it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            out = []
            for a, b, values in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("values"), strict=True):
                got = np.frombuffer(values.as_buffer(), np.uint64)
                if b is None:
                    current, held = a, got.copy()
                    continue
                assert current == a, "the pivot's set comes first"
                has = np.isin(held, got, assume_unique=True)
                common = int(has.sum())
                bits = np.packbits(np.pad(has, (0, -len(has) % 64))).view(np.int64)
                out.append((a, b, 100 * common >= percent * (len(held) + len(got) - common), bits))
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["a", "b", "linked", "inside"])

    return run


def checked_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that their sketches leave plausible, with ``linked`` and ``inside`` from their full sets.

    A pivot's set is sent once to each part that holds a partner, of as many as the most frequent pivot needs, and compared with the partners there, so
    that neither a frequent pivot's partners nor their sets meet in one task.
    """
    left = classes.select(F.col("node").alias("a"), F.col("rep").alias("a_rep"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    right = classes.select(F.col("node").alias("b"), F.col("rep").alias("b_rep"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    both = pairs.join(right, "b").join(left, "a")
    going = materialise(both.mapInArrow(_estimate(percent), "a binary, a_rep long, b binary, b_rep long"), "near-pairs")
    need = going.select(F.col("a_rep").alias("rid")).union(going.select("b_rep")).distinct()
    texts = docs.join(need, "rid", "left_semi").select("text")
    sets = materialise(texts.mapInArrow(_sets(k), "node binary, values binary"), "near-sets", "lz4")
    most = going.groupBy("a").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0  # of the most frequent pivot
    salted = going.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(-(-most // PART_PAIRS) or 1)).alias("salt"))
    partners = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "values")
    pivots = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    pivots = pivots.select("a", "salt", F.lit(None).cast("binary").alias("b"), "values")
    placed = pivots.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    checked = materialise(placed.select("a", "b", "values").mapInArrow(_verify(percent), CHECKED), "near-checked")
    dispose(going, sets)
    return checked


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of the links; equal labels mean connected.

    Every round takes the smallest label among a node and its neighbours and then the label of that label (pointer
    jumping), so chains shorten by a factor in each round.  Rounds are written to the shared folder.
    """
    edges = materialise(links.union(links.select("b", "a")).distinct().toDF("node", "other"), "near-edges")
    labels = materialise(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "near-labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), "label")
        near = edges.join(seen, "other").groupBy("node").agg(F.min("label").alias("low"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        moved = materialise(moved, "near-labels")
        dispose(labels)
        if not moved.where("label <> old").limit(1).count():
            dispose(edges)
            return moved.select("node", "label")
        labels = moved.select("node", "label")
        labels._quantspark_path = moved._quantspark_path  # noqa: SLF001


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    if not 80 <= percent <= 100:
        raise ValueError("the bands are laid out for similarities of 80 % and more")
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "text")
    sketched = materialise(slim.mapInArrow(_sketch(k), "rid long, n long, node binary, sketch binary"), "near-sketches")
    grouped = sketched.where("n > 0").groupBy("node")
    classes = materialise(grouped.agg(F.min("rid").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-classes")
    # the last step needs no sketches
    slim_rows = materialise(sketched.select("rid", "n", "node"), "near-rows")
    dispose(sketched)
    bands = classes.mapInArrow(_bands, "key long, rep long, node binary, n long")
    shared = materialise(bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-keys")
    members = materialise(bands.join(shared, "key"), "near-members")
    pivots = members.groupBy("key").agg(F.min(F.struct("rep", "node", "n")).alias("pivot"))
    fits = f"100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)"
    star = members.join(pivots, "key").where("node <> pivot.node").where(fits)
    star = star.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()
    checked = checked_pairs(star, classes, slim, k, percent)
    links = checked.where("linked").select("a", "b")
    labels = components(links)
    open_rows = open_buckets(members, pivots, labels, classes, checked)
    if open_rows.limit(1).count():
        unique = unique_shingles(open_rows, classes, slim, k)
        open_rows = promising(open_rows, unique, percent)
        pairs = pivot_pairs(open_rows, percent)
        if pairs.limit(1).count():
            links = links.union(checked_pairs(pairs, classes, slim, k, percent).where("linked").select("a", "b"))
            labels = components(links)
            open_rows = promising(open_buckets(members, pivots, labels, classes, checked), unique, percent)
        rest = hidden_pairs(open_rows, percent)
        if rest.limit(1).count():
            labels = components(links.union(checked_pairs(rest, classes, slim, k, percent).where("linked").select("a", "b")))
        dispose(pairs, rest, unique)
    dispose(open_rows, members, shared)
    lowest = labels.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("low"))
    found = labels.join(lowest, "label").select(F.col("node").alias("linked"), "low")
    known = classes.select("node", "rep").join(found, F.col("node") == F.col("linked"), "left")
    known = materialise(known.select("node", F.coalesce("low", "rep").alias("low")), "near-components")
    dispose(classes)
    rows = slim_rows.join(known, "node", "left")
    rows = rows.withColumn("doc_id", F.when(F.col("rid") != NO_ID, F.col("rid")))
    low = F.coalesce("low", "rid")
    component = F.when(low != NO_ID, low)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def open_buckets(members: DataFrame, pivots: DataFrame, labels: DataFrame, classes: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows, other than the first pivot, of buckets with several components.

    key, node, n, label, register bits, ``ref`` (the first pivot) and ``inside`` (which of its shingles the class has, if
    that pair was checked).
    """
    tagged = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = tagged.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"))
    several = several.where("x <> y AND c > 2").select("key")
    rows = tagged.join(several, "key").join(pivots, "key").where("node <> pivot.node").select("key", "node", "n", "label", F.col("pivot.node").alias("ref"))
    rows = rows.join(checked.select(F.col("a").alias("ref"), F.col("b").alias("node"), "inside"), ["ref", "node"], "left")
    bits = classes.select("node", "sketch").mapInArrow(_low_bits, "node binary, w0 long, w1 long, w2 long")
    return materialise(rows.join(bits, "node"), "near-open")


def _explode(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole):
                sets = shingle_sets(batch.column("text"), k)
                nodes = pa.array([digest(s) for s in sets], pa.binary())
                row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), nodes.take(pa.array(row))], ["shingle", "node"])

    return run


def unique_shingles(open_rows: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, u: how many shingles of an open class no other open class and no first pivot has."""
    reps = open_rows.select("node").union(open_rows.select("ref")).distinct().join(classes, "node").select(F.col("rep").alias("rid"))
    texts = docs.join(reps, "rid", "left_semi").select("text")
    seen = texts.mapInArrow(_explode(k), "shingle long, node binary").groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    return materialise(seen.where("c = 1").groupBy("node").agg(F.count("*").alias("u")), "near-unique")


def promising(open_rows: DataFrame, unique: DataFrame, percent: int) -> DataFrame:
    """Open rows, with ``own`` = n - u, that can still link: what a class has for itself it shares with no partner.

    A pair's intersection is at most the smaller ``own``; so a class with more unique shingles than the threshold allows
    can be left out without losing a link.  Copies with many changes end here, in time linear in their texts.
    """
    rows = open_rows.join(unique, "node", "left").withColumn("own", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    had = F.aggregate(F.transform("inside", lambda w: F.bit_count(w)), F.lit(0), lambda s, x: s + x)
    rows = rows.where(f"100 * own >= {percent} * n").withColumn("outside", F.col("own") - had)
    several = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    out = materialise(rows.join(several, "key", "left_semi"), "near-open")
    dispose(open_rows)
    return out


FIELDS = ("node", "n", "own", "label", "w0", "w1", "w2", "inside", "outside")


def _could_link(percent: int) -> str:
    """Condition on a pair of open rows of one bucket, the first with the prefix a_: all bounds but the bits are exact.

    Two classes share of their pivot's shingles what both have; outside, at most what the one with less has besides its
    unique shingles.  For copies of one source this bound almost is their intersection.
    """
    differ = " + ".join(f"bit_count(a_w{i} ^ w{i})" for i in range(3))
    most = f"100 * least(a_own, own) >= {percent} * (a_n + n - least(a_own, own))"
    both = "aggregate(zip_with(a_inside, inside, (p, q) -> bit_count(p & q)), 0, (s, x) -> s + x) + least(a_outside, outside)"
    shared = f"a_inside IS NULL OR inside IS NULL OR {100 + percent} * ({both}) >= {percent} * (a_n + n)"
    return f"a_label <> label AND {most} AND 100 * least(a_n, n) >= {percent} * greatest(a_n, n) AND {differ} <= {MOST_BITS} AND ({shared})"


def pivot_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of every row with one other pivot of its bucket, drawn by a hash of the bucket and the class.

    Near copies of one source, about equally far from each other, share many buckets and so meet many different
    pivots: this joins almost all of them, with as many pairs as rows.
    """
    fields = [F.col(c).alias(f"a_{c}") for c in FIELDS]
    drawn = open_rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), *fields)).alias("p"))
    pairs = open_rows.join(drawn.select(F.col("key").alias("k"), "p.*"), (F.col("key") == F.col("k")) & F.expr(_could_link(percent)))
    return materialise(pairs.select(F.col("a_node").alias("a"), F.col("node").alias("b")).distinct(), "near-turn")


def hidden_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components that no pivot stood for."""
    left = open_rows.select("key", *(F.col(c).alias(f"a_{c}") for c in FIELDS))
    fits = f"a_node < node AND {_could_link(percent)}"
    pairs = left.join(open_rows.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.expr(fits))
    return materialise(pairs.select(F.col("a_node").alias("a"), F.col("node").alias("b")).distinct(), "near-rest")


def _low_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, M)
        bits = np.zeros((len(sketch), 192), dtype=np.uint8)
        bits[:, :M] = sketch & 1
        words = np.packbits(bits, axis=1).view(np.int64).reshape(len(sketch), 3)
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(3))], ["node", "w0", "w1", "w2"])
