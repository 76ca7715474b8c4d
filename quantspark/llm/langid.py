r"""Language identification with spans of mixed-language text.

Training: per language, at most ``per_lang`` labelled documents (those with the smallest hash of their id, so the sample
is the same everywhere) give counts of byte n-grams of words, which executors count; the n-grams are hashed into a table of
smoothed log-probabilities, ``2**BITS`` rows however large the corpus.  The scripts that make up a language's letters are kept.

Prediction: the scripts of a word's letters narrow its candidate languages.  Every word gets a score per candidate, the
mean n-gram log-likelihood ratio times a confidence that grows with its length.  Viterbi over the words, with a penalty
for each switch, labels spans.  A word's evidence for its label is its letters times how far its posterior is above an even
guess, so words that any language could have count for nothing; the language with the most evidence is the document's,
and ``score`` is its share of all evidence.

``coverage`` says how much of a document is language at all: the share of its letters, those of unfit words included, that
stand in words some fitting language is likely to have made.  A word is likely if the mean log-probability of the n-grams that end in its letters is nearer to
that of the language's own training texts than to that of the same texts with their letters shuffled.

All words of a batch are scored at once by numpy; Viterbi runs in lockstep over texts.  Texts longer than ``CHUNK`` words are
labelled in chunks, together with ``OVERLAP`` words around each, so that one very long text does not become one very long loop.

Defined results: null texts and texts without letters are ``und`` with score and coverage 0; words without letters score 0 for
every language and take the label of their neighbours; if no learned language fits the scripts of any word, the most
frequent learned language is returned with score 0; ties go to the language that sorts first; null doc_ids never train, and of
training rows that repeat an id one counts; input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .storage import dispose, materialise, reserve, small_batches

BITS = 16
ORDERS = (1, 2, 3, 4)
SWITCH = 6.0
CHUNK = 1024
PER_LANG = 1500
#: Training texts of each language, as they are and with their letters shuffled, that tell likely words from noise.
NOISE_TEXTS = 100
#: With more languages, a row for each is not broadcast.
MOST_LANGS = 10_000
#: Words on both sides of a chunk that its labels are found with.
OVERLAP = 64
#: First and last code point of the letter blocks of common scripts; other letters are one more script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("han", 0x20000, 0x2FA1F),
)


@lru_cache(maxsize=1)
def script_bits() -> np.ndarray:
    """For every code point 0 if it is no letter, else the bit of its script."""
    names = list(dict.fromkeys(s[0] for s in SCRIPTS))
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    bits = np.full(0x110000, 1 << len(names), dtype=np.uint32)
    for name, low, high in SCRIPTS:
        bits[low : high + 1] = 1 << names.index(name)
    bits[~letter] = 0
    return bits


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # (2**BITS, languages + 1) log-probability ratios, and the mean log-probability they are ratios to
    scripts: np.ndarray  # per language, bits of its scripts
    prior: int  # the most frequent language
    least: np.ndarray  # per language, the mean log-probability from which a word is likely


def _byte_classes() -> np.ndarray:
    """Bytes with A-Z lower-cased and white space as 0, plus 1."""
    lower = np.arange(256, dtype=np.uint32) + 1
    lower[65:91] = lower[97:123]
    lower[kernel.SPACE] = 0
    return lower


_LOWER = _byte_classes()
#: 1 for the bytes that letters are made of, so that symbols around a word do not make it unlikely.
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], dtype=np.float32)


def _gram_slots(data: np.ndarray, words: kernel.Words) -> Iterator[np.ndarray]:
    """For each order, the table slot of the n-gram that ends at each byte (with one byte before the word as its edge).

    Bytes of white space have the n-grams that end a word, which belong to the word before them.  A text begins as if white
    space were before it, whatever text the batch holds there.
    """
    codes = _LOWER[data].astype(np.uint32)
    rolled = codes.copy()
    for n in ORDERS:
        if n > 1:
            before = np.concatenate([np.zeros(n - 1, np.uint32), codes[: len(codes) - n + 1]])[: len(codes)]
            for k in range(n - 1):
                at = words.offsets[:-1] + k
                before[at[at < len(codes)]] = 0
            rolled = rolled * np.uint32(0x01000193) + before
        mixed = (rolled + np.uint32(n)) * np.uint32(0x9E3779B1)
        yield mixed >> np.uint32(32 - BITS)


def _letters(data: np.ndarray, words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(letters, script bits) of every word."""
    if not len(words.start):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bits = script_bits()[points]
    # place of a byte among the code points
    place = np.cumsum((data & 0xC0) != 0x80) - 1
    start = place[words.start]
    stop = place[words.end - 1] + 1
    counts = np.concatenate([[0], np.cumsum(bits != 0)])
    edges = np.stack([start, np.minimum(stop, len(points) - 1)], axis=1).reshape(-1)
    union = np.bitwise_or.reduceat(bits, edges)[::2]
    last = stop - 1  # reduceat gives a single element where start equals stop
    union = union | bits[start] | bits[last]
    return counts[stop] - counts[start], union


def _word_means(words: kernel.Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and language, summed over the orders: mean ratio of its bytes, mean log-probability of its letters' bytes."""
    k = table.shape[1] - 1
    if not len(words.start):
        return np.zeros((0, k), dtype=np.float32), np.zeros((0, k), dtype=np.float32)
    total = np.zeros((len(words.data) + 1, k + 1), dtype=np.float32)
    for slots in _gram_slots(words.data, words):
        total[:-1] += table[slots]
    edges = np.stack([words.start, words.end], axis=1).reshape(-1)
    ratio = np.add.reduceat(total[:, :-1], edges, axis=0)[::2] / (words.end - words.start).astype(np.float32)[:, None]
    own = np.append(_LETTER[words.data], np.float32(0))
    size = np.maximum(np.add.reduceat(own, edges)[::2], 1)
    logs = np.stack([np.add.reduceat((total[:, j] + total[:, -1]) * own, edges)[::2] / size for j in range(k)], axis=1)
    return ratio, logs


def _judge_words(column: pa.Array, model: Model) -> tuple[kernel.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, all letters of each word, those of words that fit, those of likely words, scores of each word and language)."""
    words = kernel.words_of(column)
    letters, scripts = _letters(words.data, words)
    ratio, logs = _word_means(words, model.table)
    size = (words.end - words.start).astype(np.float32)[:, None]
    fits = (scripts[:, None] & model.scripts[None, :]) != 0
    likely = (fits & (logs >= model.least)).any(axis=1)
    scores = np.clip(ratio, -4, 4) * np.minimum(size, 8) / 4
    scores = np.where(fits, scores, np.float32(-30))
    scores[~fits.any(axis=1)] = 0
    return words, letters, np.where(fits.any(axis=1), letters, 0), np.where(likely, letters, 0), scores


def word_scores(column: pa.Array, model: Model) -> tuple[kernel.Words, np.ndarray, np.ndarray]:
    """(words, letters of each word, scores of each word and language)."""
    words, _, letters, _, scores = _judge_words(column, model)
    return words, letters, scores


def viterbi(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; sequence i has the words begin[i] : begin[i] + size[i]."""
    labels = np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # sequences longer than t
    k = scores.shape[1]
    back = np.zeros((len(scores), k), dtype=np.int16)
    best = np.zeros((len(size), k), dtype=np.float64)
    for t, n in enumerate(live.tolist()):
        at = begin[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            other = now[np.arange(n), top] - switch
            stay = now >= other[:, None]
            back[at] = np.where(stay, np.arange(k)[None, :], top[:, None])
            now = np.where(stay, now, other[:, None])
        best[:n] = now + scores[at]
    state = best.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def predict(column: pa.Array, model: Model) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, spans) of every text; a span is (from_word, n_words, lang)."""
    pred, score, _, spans = judge(column, model)
    return pred, score, spans


def judge(column: pa.Array, model: Model) -> tuple[list[str], list[float], list[float], list[list[dict]]]:
    """(language, score, coverage, spans) of every text."""
    words, raw, letters, likely, scores = _judge_words(column, model)
    langs, counts = len(model.langs), words.counts
    parts = -(-counts // CHUNK)
    row = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = words.ptr[:-1][row] + nth * CHUNK
    size = np.minimum(CHUNK, words.ptr[1:][row] - begin)
    # a chunk of a long text is labelled with the words around it, which then keep the labels of their own chunks
    low, high = np.maximum(begin - OVERLAP, words.ptr[:-1][row]), np.minimum(begin + size + OVERLAP, words.ptr[1:][row])
    wide = high - low
    first = np.cumsum(wide) - wide
    if len(row) and int(wide.sum()) > len(scores):
        at = np.repeat(low - first, wide) + np.arange(int(wide.sum()))
        found = viterbi(scores[at], first, wide)
        inside = (at >= np.repeat(begin, wide)) & (at < np.repeat(begin + size, wide))
        labels = found[inside]
    else:
        labels = viterbi(scores, begin, size)
    shift = scores - scores.max(axis=1, keepdims=True) if len(scores) else scores
    posterior = np.exp(shift) / np.exp(shift).sum(axis=1, keepdims=True) if len(scores) else scores
    owner = words.row()
    weight = np.zeros((len(counts), langs))
    trust = np.zeros((len(counts), langs))
    np.add.at(weight, (owner, labels), letters)
    if len(labels):
        even = 1 / langs
        sure = posterior[np.arange(len(labels)), labels]
        sure = np.maximum((sure - even) / (1 - even), 0) if langs > 1 else sure
        np.add.at(trust, (owner, labels), letters * sure)
    all_letters = np.bincount(owner, raw, len(counts))
    coverage = np.bincount(owner, likely, len(counts)) / np.maximum(all_letters, 1)
    best = np.where(trust.any(axis=1), trust.argmax(axis=1), weight.argmax(axis=1))
    each = np.arange(len(counts))
    pred, score, spans = [], [], []
    for i in each.tolist():
        if not all_letters[i]:
            pred.append("und")
            score.append(0.0)
        elif not weight[i].any():
            pred.append(model.langs[model.prior])
            score.append(0.0)
        else:
            pred.append(model.langs[best[i]])
            score.append(float(trust[i, best[i]] / max(trust[i].sum(), 1e-9)))
        mine = labels[words.ptr[i] : words.ptr[i + 1]]
        cuts = np.flatnonzero(np.diff(mine)) + 1
        edges = [0, *cuts.tolist(), len(mine)] if len(mine) and all_letters[i] else []
        spans.append([{"from_word": a, "n_words": b - a, "lang": model.langs[mine[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return pred, score, coverage.tolist(), spans


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another order; everything else stays in its place."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    at = np.flatnonzero(script_bits()[points])
    points[at] = points[rng.permutation(at)]
    return points.tobytes().decode("utf-32-le")


def count_grams(texts: pa.Array) -> np.ndarray:
    """How often each of the 2**BITS n-gram slots occurs in the texts and, behind them, the letters of words in each script."""
    words = kernel.words_of(texts)
    out = np.zeros((1 << BITS) + 32, np.int64)
    for slots in _gram_slots(words.data, words):
        out[: 1 << BITS] += np.bincount(slots, minlength=1 << BITS)
    letters, bits = _letters(words.data, words)
    for bit in range(32):
        out[(1 << BITS) + bit] = letters[(bits >> np.uint32(bit)) & np.uint32(1) == 1].sum()
    return out


def noise_sums(text: str, table: np.ndarray) -> tuple[float, float, int, int]:
    """Log-probabilities, weighted by letters, of a text and of its shuffled letters under one language; both weights."""
    out = []
    for one in (text, _shuffled(text, np.random.default_rng(zlib.crc32(text.encode())))):
        words = kernel.words_of(pa.array([one], pa.string()))
        letters, _ = _letters(words.data, words)
        _, logs = _word_means(words, table)
        out.append((float((logs[:, 0] * letters).sum()), int(letters.sum())))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def _table(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities, a column for each language, as ratios to their mean, which is the last column."""
    share = (counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * len(counts))
    logs = np.log(share)
    mean = logs.mean(axis=1, keepdims=True)
    return np.concatenate([logs - mean, mean], axis=1).astype(np.float32)


def _scripts(letters: np.ndarray) -> int:
    """Bits of the scripts that hold a fifth of a language's letters."""
    return sum(1 << bit for bit in range(32) if letters.sum() and letters[bit] >= 0.2 * letters.sum())


def model_of(langs: tuple[str, ...], known: list[int], counts: np.ndarray) -> Model:
    """Model of languages in rising order from their texts' counts (:func:`count_grams`, a column each); ``least`` is still 0."""
    scripts = np.array([_scripts(counts[1 << BITS :, j]) for j in range(len(langs))], np.uint32)
    return Model(langs, _table(counts[: 1 << BITS]), scripts, int(np.argmax(known)) if known else 0, np.zeros(len(langs), np.float32))


def _with_least(model: Model, sums: dict[str, tuple[float, float, int, int]]) -> Model:
    """``least``: the middle between the mean log-probabilities of the texts and of their shuffled letters."""
    least = [sum(x / max(n, 1) for x, n in zip(sums[lang][:2], sums[lang][2:], strict=True)) / 2 for lang in model.langs]
    return replace(model, least=np.array(least, np.float32))


def train(rows: list[tuple[str, str]]) -> Model:
    """Model of (lang, text) rows in memory; :func:`fit` does the same on executors."""
    langs = tuple(sorted({lang for lang, _ in rows}))
    texts = {lang: sorted(t for other, t in rows if other == lang) for lang in langs}
    if not langs:
        return Model((), np.zeros((1 << BITS, 1), np.float32), np.zeros(0, np.uint32), 0, np.zeros(0, np.float32))
    counts = np.stack([count_grams(pa.array(texts[lang], pa.string())) for lang in langs], axis=1)
    model = model_of(langs, [len(texts[lang]) for lang in langs], counts)
    sums = {lang: tuple(map(sum, zip(*(noise_sums(t, model.table[:, [j, -1]]) for t in texts[lang][:NOISE_TEXTS]), strict=True))) for j, lang in enumerate(langs)}
    return _with_least(model, sums)


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, n (rank), text: at most ``per_lang`` labelled rows of each language whose fold is not 1, by smallest id hash.

    Of rows that repeat a doc_id and a language one is taken, so that the bound holds for rows, whatever the ids.
    """
    h = F.xxhash64("doc_id")
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 1)).select("lang", h.alias("h"), "text")
    # a hash threshold per language first, at four times what is needed: only a bounded number of rows is shuffled and ranked
    counts = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("c"))
    share = materialise(counts.select("lang", (F.lit(4.0 * per_lang) / F.col("c")).alias("share")), "lang-shares")
    # a row per language; of more, a join by language sends no more than each language's threshold lets through
    share = F.broadcast(share) if share.count() <= MOST_LANGS else share
    place = (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) + 1) / float(1 << 20)
    near = own.join(share, "lang").where(place <= F.col("share"))
    ids = near.select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    return near.groupBy("lang", "h").agg(F.min("text").alias("text")).join(ids, ["lang", "h"]).select("lang", "n", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the counts of a task's texts that are not zero."""
    held: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in kernel.slices(whole, limit=1 << 20):
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                texts = batch.column("text").filter(pa.array([x == lang for x in langs]))
                held[lang] = held.get(lang, 0) + count_grams(texts)
    for lang, counts in held.items():
        slots = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(slots), pa.string()), pa.array(slots), pa.array(counts[slots])], ["lang", "slot", "n"])


def _noise(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            rows = [noise_sums(t, model.table[:, [model.langs.index(lang), -1]]) for lang, t in zip(langs, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int64())))], ["lang", "a", "b", "m", "n"])

    return run


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """The model of the labelled documents outside fold 1; without any it knows no language.

    Texts stay on the executors: the driver gets the languages' counts of 2**BITS slots.
    """
    small_batches(docs.sparkSession)
    rows = materialise(training_rows(docs, per_lang), "lang-rows")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(known))
    if not langs:
        return train([])
    counts = np.zeros(((1 << BITS) + 32, len(langs)), np.int64)
    found = rows.select("lang", "text").mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    column = np.array([langs.index(x) for x in found.column("lang").to_pylist()], np.int64)
    counts[found.column("slot").to_numpy(), column] = found.column("n").to_numpy()
    model = model_of(langs, [known[lang] for lang in langs], counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tried = rows.where(F.col("n") <= NOISE_TEXTS).select("lang", "text").mapInArrow(_noise(shared), "lang string, a double, b double, m long, n long")
    sums = {r["lang"]: tuple(r)[1:] for r in tried.groupBy("lang").agg(*(F.sum(c).alias(c) for c in "abmn")).collect()}
    dispose(rows)
    return _with_least(model, sums)


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("from_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
        for whole in batches:
            for batch in kernel.slices(whole, limit=2 << 20):
                pred, score, coverage, spans = judge(batch.column("text"), model)
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "qs_lang", "qs_score", "qs_coverage", "qs_spans"])

    return run


SPANS = "array<struct<from_word:int,n_words:int,lang:string>>"


def identify(docs: DataFrame, per_lang: int = PER_LANG, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` with qs_lang, qs_score, qs_coverage and qs_spans; the model is trained on ``docs`` unless given."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = reserve(docs, "qs_lang", "qs_score", "qs_coverage", "qs_spans")
    model = model or fit(docs, per_lang)
    if not model.langs:
        return docs.select("*", F.lit("und").alias("qs_lang"), F.lit(0.0).alias("qs_score"), F.lit(0.0).alias("qs_coverage"), F.lit(None).cast(SPANS).alias("qs_spans"))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"qs_lang string, qs_score double, qs_coverage double, qs_spans {SPANS}").fields])  # noqa: SLF001
    return docs.mapInArrow(_label(spark.sparkContext.broadcast(model)), schema)
