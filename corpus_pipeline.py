"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing over the whole table of documents.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each result as Parquet
and rereads it as the next stage's documents.  All stages but the last return the columns of ``documents``.

Defined results: documents without a letter, without evidence for a language, or with less than half of their letters in likely
words of learned languages (other scripts, gibberish) are rejected; cleaned texts get a new n_chars;
rows that repeat a doc_id share its fate, and documents without an id cannot be told apart: if one of them stays, all
stay; an empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm import langid, lines, mixing, near, packing
from quantspark.llm.queries import documents, tokenizer_file
from quantspark.llm.storage import materialise, scope, shelter, sweep

#: A document is rejected unless this share of all its letters stands in likely words of learned languages: the larger part of
#: it must be language.  Languages mixed in one document, and words that several have, do not count against it.
LEAST_COVERAGE = 0.5

SCOPE = "corpus pipeline"


def _stage(f: Callable) -> Callable:
    """A stage begins when its predecessor's result has been written, so that one's intermediate tables can go.

    Columns of the documents whose names operators use inside are out of their way meanwhile.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(SCOPE)
        docs, back = shelter(docs)
        with scope(SCOPE):
            return f(spark, docs, sf_dir).withColumnsRenamed(back)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in learned languages; a missing lang is filled with the prediction.

    Where nothing is labelled, no language can be learned and none is rejected: documents with a letter pass as they are.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model=model).where((F.col("qs_lang") != "und") & (F.col("qs_score") > 0) & (F.col("qs_coverage") >= LEAST_COVERAGE))
    return found.withColumn("lang", F.coalesce("lang", "qs_lang")).select(docs.columns)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("qs_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


@_stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    kept = near.near_duplicates(docs, k=5, percent=80).where("kept").select(F.col("doc_id").alias("qs_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("qs_kept")), "left_semi").select(docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: once per epoch that takes at least half of its words."""
    pieces = mixing.mix(docs).pieces
    epochs = pieces.groupBy("doc_id", "s", "begin", "size", "epoch").agg(F.sum("n_words").alias("n"))
    copies = epochs.where("2 * n >= size").groupBy("doc_id", "s", "begin").agg(F.count("*").cast("int").alias("copies"))
    copies = materialise(copies.groupBy(F.col("doc_id").alias("qs_id")).agg(F.max("copies").alias("qs_copies")), "mix-copies")
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("qs_id")))
    taken = taken.withColumn("qs_copy", F.explode(F.sequence(F.lit(1), F.col("qs_copies"))))
    return taken.select(docs.columns)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL has neither the language model, the tokenizer nor the schedule; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
