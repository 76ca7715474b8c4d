"""Line deduplication: lines that several documents share stay only in the first document that holds them.

Normalised lines are exploded with their positions and hashed (128 bits of MD5 over the whole key, so that collisions
are out of reach even for 1e13 lines); a partial aggregation counts documents per hash before anything is shuffled; the
dropped positions are collected per document and text (128 bits of MD5 again) and the kept lines put together again by position.  Frequent lines are
rows of a join whose skewed partitions the planner splits; no group is ever gathered.

Defined results: null or empty text is one empty line; rows with a null doc_id count together as one document that
comes after all others; rows that repeat a doc_id count as one document, too; in both cases every row loses the shared lines
of its own text only; an empty table gives none; input columns called qs_n_lines and qs_n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, shelter

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 9223372036854775807


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def text_hash() -> Column:
    """Tells the texts of rows with one doc_id, or with none, apart."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """rid, th and ``gone``, the 0-based positions of the lines that a document's text with the hash ``th`` loses."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), text_hash().alias("th"), "text")
    lines = texts.select("rid", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("rid", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("rid", "th", "pos", F.unhex(F.md5("key")).alias("hash"))
    if min_docs <= 2:
        # two different documents hold a line exactly when its smallest and largest document differ
        shared = lines.groupBy("hash").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last")
    else:
        each = lines.select("hash", "rid").distinct()
        shared = each.groupBy("hash").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = materialise(shared.select("hash", "first"), "shared-lines")
    gone = lines.join(shared, "hash").where("rid > first").select("rid", "th", "pos").distinct()
    return gone.groupBy("rid", "th").agg(F.collect_list("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with the cleaned text, and ``qs_n_lines`` and ``qs_n_dropped``."""
    docs, back = shelter(docs, "qs_n_lines", "qs_n_dropped")
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = dropped_lines(slim, min_chars, min_docs).select(F.col("rid").alias("qs_rid"), F.col("th").alias("qs_th"), F.col("gone").alias("qs_gone"))
    own = docs.withColumn("qs_own", text_hash())
    out = own.join(gone, (F.coalesce(own["doc_id"], F.lit(NO_ID)) == gone["qs_rid"]) & (own["qs_own"] == gone["qs_th"]), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    out = out.withColumn("qs_lines", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("qs_lines") - 1), F.col("qs_gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get("qs_lines", i)), "\n")
    out = out.withColumn("qs_n_lines", F.size("qs_lines").cast("long"))
    out = out.withColumn("qs_n_dropped", F.coalesce(F.size("qs_gone"), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col("qs_gone").isNull(), F.col("text")).otherwise(text))
    return out.drop("qs_rid", "qs_th", "qs_own", "qs_gone", "qs_lines").withColumnsRenamed(back)
