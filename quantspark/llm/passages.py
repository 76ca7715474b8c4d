r"""Substring deduplication with repeated-phrase automata.

A window is ``width`` consecutive words.  A word goes if a window that covers it also starts in a document with a smaller
doc_id.

1. Seeds: the seed of a window is the smallest hash among its ``gram``-word phrases, so equal windows have equal seeds
   and a document has about 2 / (width - gram + 2) seeds per word.  Seeds found in two documents mark the texts that can
   hold a recurring window; the others are not looked at again until the last step.
2. Confirming: in those texts the windows with a recurring seed are hashed whole; a window found in two documents is
   confirmed, with the smallest document that holds it, its origin.
3. Automata: the confirmed windows of an origin, in lots of at most ``LOT_WINDOWS``, are cut out of its text as passages.  Lots are
   dealt to shards, and every shard compiles its windows into an Aho-Corasick automaton over word numbers.  A shard has about
   ``SHARD_WINDOWS`` windows, however long an origin is.
4. Streaming: a document streams through the automata of those shards that hold a window of it, and through no others, as it
   cannot match there; sending every document to every shard would cost documents times shards.  The automata find where
   the windows stand.  A shard that many documents need is split into parts with the same automaton.
5. The words of all occurrences from origins with a smaller doc_id are removed.

Hashes only choose what is looked at: every removal rests on equal words.  A window is lost only if its 64-bit hash
collides with that of another window, in an even smaller document.

Defined results: null text has no words; null doc_ids come after every other and are not smaller than each other; rows
that repeat a doc_id are not compared with one another, and each loses the words that its own text shares with smaller
documents; such rows, and those without an id, are told apart by ``th``, a hash of their text; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .storage import dispose, materialise, small_batches

NO_ID = 9223372036854775807
WIDTH, GRAM = 13, 5
#: Letters are limited to 12,288 of each alphabet, so a shard may have 1.5e8 different words.
SHARD_WINDOWS, LOT_WINDOWS = 40_000, 10_000
PART_DOCS = 4000
#: Up to so many repeated ids are broadcast (8 bytes each).
MOST_IDS = 1_000_000


def _lowest(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For every word, the smallest hash among the phrases of ``gram`` words inside the ``width`` words from there."""
    low, _, _ = kernel.windows(hashes, np.array([0, len(hashes)]), gram)
    span, reach = width - gram + 1, 1
    while reach < span:  # minimum over ever longer runs of phrases
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return low


def window_seeds(column: pa.Array, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, kernel.Words, np.ndarray]:
    """(window hash, seed, row, words, first word) of every window of every text."""
    words = kernel.words_of(column)
    hashes = words.hashes()
    found, rows, at = kernel.windows(hashes, words.ptr, width)
    seeds = _lowest(hashes, width, gram)[at] if len(found) else found
    return found, seeds, rows, words, at


def text_seeds(column: pa.Array, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, row) of every window; of equal seeds one after another only the first."""
    words = kernel.words_of(column)
    hashes = words.hashes()
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    seeds = _lowest(hashes, width, gram)
    rows = words.row()[: len(seeds)]
    keep = np.arange(len(seeds)) + width <= words.ptr[1:][rows]
    keep[1:] &= (seeds[1:] != seeds[:-1]) | (rows[1:] != rows[:-1])
    return seeds[keep], rows[keep]


def _seeds(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole):
                seeds, rows = text_seeds(batch.column("text"), width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), *(batch.column(c).take(pa.array(rows)) for c in ("rid", "th"))], ["seed", "rid", "th"])

    return run


def _candidates(width: int, gram: int):
    """Hashes of the windows whose seed recurs, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole, limit=4 << 20):
                found, seeds, rows, _, _ = window_seeds(batch.column("text"), width, gram)
                cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                parts = []
                for i, wanted in enumerate(batch.column("seeds")):
                    mine = slice(cut[i], cut[i + 1])
                    hit = np.isin(seeds[mine], wanted.values.to_numpy().view(np.uint64))
                    parts.append(np.unique(found[mine][hit]))
                sizes = [len(p) for p in parts]
                values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
                take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(batch.column(c).take(take) for c in ("rid", "th"))], ["window", "rid", "th"])

    return run


def _passages(width: int, gram: int):
    """The passages of a lot of an origin's windows: a line of words for each run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole, limit=4 << 20):
                found, _, rows, words, at = window_seeds(batch.column("text"), width, gram)
                cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                texts = []
                for i, wanted in enumerate(batch.column("own")):
                    first = at[cut[i] : cut[i + 1]][np.isin(found[cut[i] : cut[i + 1]], wanted.values.to_numpy().view(np.uint64))]
                    edges = np.flatnonzero(np.diff(first) != 1) + 1
                    lines = []
                    for run_ in np.split(first, edges) if len(first) else []:
                        a, b = int(run_[0]), int(run_[-1]) + width
                        lines.append(b" ".join(words.data[words.start[a] : words.end[b - 1]].tobytes().split()))
                    texts.append(b"\n".join(lines).decode())
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("shard"), pa.array(texts, pa.string())], ["rid", "shard", "text"])

    return run


class PhraseAutomaton:
    """Aho-Corasick automaton whose patterns are the windows of many passages.

    Words are numbered, and a number is written with two letters from different alphabets of about the root of the count
    of words: a node then has few children, which the library searches one by one, and no match starts inside a word.
    """

    def __init__(self, passages: list[tuple[int, bytes]], width: int) -> None:
        import ahocorasick

        self.width = width
        lines = [(origin, line.split()) for origin, text in passages for line in text.split(b"\n")]
        known = list(dict.fromkeys(w for _, line in lines for w in line))
        base = math.isqrt(len(known)) + 1
        self.letters = {w: chr(0x3000 + i // base) + chr(0x6000 + i % base) for i, w in enumerate(known)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for origin, line in lines:
            text = "".join([self.letters[w] for w in line])
            for a in range(0, len(text) - 2 * width + 1, 2):
                self.automaton.add_word(text[a : a + 2 * width], origin)
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()

    def occurrences(self, rid: int, text: bytes) -> list[tuple[int, int]]:
        """Word ranges of ``text`` covered by windows from documents before ``rid``, overlapping ones merged."""
        out: list[tuple[int, int]] = []
        if not self.ready:
            return out
        get = self.letters.get
        low = high = -1
        for last, origin in self.automaton.iter("".join([get(w, "  ") for w in text.split()])):
            if origin < rid:
                end = last >> 1
                if end - self.width >= high:
                    if high >= 0:
                        out.append((low, high))
                    low = end - self.width + 1
                high = end + 1
        if high >= 0:
            out.append((low, high))
        return out


def _stream(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, passages, automaton = None, [], None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("shard", "part", "kind", "rid", "th")]
            for shard, salt, kind, rid, th, text in zip(*columns, batch.column("text"), strict=True):
                if (shard, salt) != part:
                    part, passages, automaton = (shard, salt), [], None
                data = text.as_buffer().to_pybytes()
                if kind == 0:
                    passages.append((rid, data))
                    continue
                if automaton is None:
                    automaton = PhraseAutomaton(passages, width)
                    passages = []
                out += [(rid, th, low, high) for low, high in automaton.occurrences(rid, data)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["rid", "th", "low", "high"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in kernel.slices(whole):
            texts, totals, removed = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                totals.append(len(words))
                if ranges.is_valid:
                    gone = np.zeros(len(words) + 1, np.int64)
                    flat = ranges.values
                    np.add.at(gone, flat.field("low").to_numpy(), 1)
                    np.add.at(gone, flat.field("high").to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                removed.append(totals[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def occurrences(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """rid, th, low, high: word ranges of ``docs`` (rid, th, text) that repeat a passage of a smaller document."""
    seeds = materialise(docs.mapInArrow(_seeds(width, gram), "seed long, rid long, th long"), "phrase-all-seeds")
    recurring = seeds.groupBy("seed").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).where("x < y").select("seed")
    recurring = materialise(recurring, "phrase-seeds")
    hits = seeds.join(recurring, "seed").groupBy("rid", "th").agg(F.collect_set("seed").alias("seeds"))
    texts = materialise(docs.join(hits, ["rid", "th"]), "phrase-texts")
    dispose(seeds, recurring)
    windows = materialise(texts.mapInArrow(_candidates(width, gram), "window long, rid long, th long"), "phrase-windows")
    confirmed = windows.groupBy("window").agg(F.min("rid").alias("origin"), F.max("rid").alias("y")).where("origin < y").select("window", "origin")
    confirmed = materialise(confirmed, "phrase-confirmed")
    long = confirmed.groupBy("origin").agg(F.ceil(F.count("*") / LOT_WINDOWS).alias("lots")).where("lots > 1")
    lot = F.coalesce(F.pmod("window", "lots"), F.lit(0))
    shard = F.pmod(F.xxhash64(F.lit(3), "origin", lot), F.lit(int(confirmed.count() // SHARD_WINDOWS + 1)))
    homes = materialise(confirmed.join(materialise(long, "phrase-long"), "origin", "left").select("window", "origin", shard.alias("shard")), "phrase-homes")
    # a row for each document and lot it needs; the origin's own row has the windows of the lot
    own = F.collect_set(F.when(F.col("rid") == F.col("origin"), F.col("window")))
    met = materialise(windows.join(homes, "window").groupBy("origin", "shard", "rid", "th").agg(own.alias("own")), "phrase-met")
    dispose(windows, confirmed, homes)
    passages = met.where("rid = origin").select("rid", "th", "shard", "own").join(texts.select("rid", "th", "text"), ["rid", "th"])
    passages = materialise(passages.mapInArrow(_passages(width, gram), "rid long, shard long, text string"), "phrase-passages")
    routes = materialise(met.where("rid > origin").select("rid", "th", "shard").distinct(), "phrase-routes")
    loads = routes.groupBy("shard").agg(F.ceil(F.count("*") / PART_DOCS).cast("int").alias("parts"))
    automata = passages.where("text <> ''").join(loads, "shard")
    automata = automata.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "rid", F.lit(0).cast("long").alias("th"), "text")
    readers = texts.select("rid", "th", "text").join(routes.join(loads, "shard"), ["rid", "th"])
    readers = readers.select("shard", F.pmod(F.xxhash64("rid", "th"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "rid", "th", "text")
    placed = automata.unionByName(readers).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = materialise(placed.mapInArrow(_stream(width), "rid long, th long, low long, high long"), "phrase-found")
    dispose(texts, met, routes, passages)
    return found


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, rid, th, text: ``th`` is a hash of the text where a doc_id repeats or is missing, else 0, which costs nothing to carry."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), text.alias("text"))
    again = materialise(slim.groupBy("rid").agg(F.count("*").alias("c")).where("c > 1").select("rid", F.lit(True).alias("again")), "phrase-ids")
    count = again.count()
    if not count:
        return slim.withColumn("th", F.lit(0).cast("long"))
    known = slim.join(F.broadcast(again) if count <= MOST_IDS else again, "rid", "left")
    return known.select("doc_id", "rid", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("th"), "text")


def dedup_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    slim = identified(docs)
    found = occurrences(slim.select("rid", "th", "text"), width, gram)
    ranges = found.groupBy("rid", "th").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    joined = slim.join(ranges, ["rid", "th"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_remove, "doc_id long, text string, n_words long, n_removed long")
