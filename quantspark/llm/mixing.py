"""Mixing sources to target weights with a low-discrepancy schedule (native).

1. Targets: source weights share ``share`` times all words; a target stops at ``max_epochs`` times its source's size and
   the excess is reshared by weight (water filling in closed form over the table of sources).
2. Blocks: a source's documents are put in a hashed order and its word stream is cut into blocks of ``block_words``; each
   epoch takes the blocks in another order (a step that is prime to their number, from a hashed start).
   Stream positions are prefix sums in two levels (hash buckets, then inside a bucket), so no task orders a whole source.
3. Schedule: point i of the golden-ratio sequence is mapped through the cumulative slot shares to a source; slots are
   ranked per source, again in two levels (runs of slots, then inside a run).  Rank r takes the next block of
   its epoch, so a source is repeated only after all its blocks have been taken once.
4. The sequence gives every source its share up to its discrepancy, a few slots.  The tail corrects these: surplus
   slots of a source are left out, missing ones follow at the end, and its last slot is cut to meet the target.

Defined results: null text has size 0; sizes of 0 take nothing; null source is a source of its own, ordered last; rows
that repeat a doc_id are separate rows; an empty table gives an empty result.  Reruns agree: every order is total.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Fractional part of the golden ratio, and of 2**20 times it (so that large i keep their precision).
PHI = 0.6180339887498949
PHI20 = (PHI * 2**20) % 1.0
RUN = 1 << 14
#: A source has about as many buckets as rows in a bucket, but not less rows than this.
LEAST_ROWS = 1000
#: Primes beyond any number of blocks; one that does not divide the blocks numbers them anew.
PRIMES = (2147483647, 2147483629)


@dataclass(frozen=True)
class Mixture:
    """``rows``: a row per document of the input; ``pieces``: what each slot of the schedule takes of which document."""

    rows: DataFrame
    pieces: DataFrame


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """source, s (rank by code point, null last, from 0), total, weight, target of every source."""
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n_docs"))
    ranked = ranked.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod("s", F.lit(len(weights))))).withColumn("cap", F.col("total") * float(max_epochs))
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    by_level, rest = Window.orderBy("level", "s").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("level", "s").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("total").over(whole) * share - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))
    ranked = ranked.withColumn("rate", left / F.sum("weight").over(rest))
    open_rate = F.max(F.when(F.col("rate") < F.col("level"), F.col("rate"))).over(whole)
    ranked = ranked.withColumn("open_rate", open_rate)
    target = F.coalesce(F.least("cap", F.col("open_rate") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "s", "n_docs", "total", "weight", target.alias("target"))


def _positions(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with s and ``begin``, the position of the document's first word in its source's stream.

    Rows are told apart by id, text and, where all of that repeats, by their number among their equals, so that neither
    rows without an id nor repeated ones meet in one bucket.
    """
    bits = F.ceil(F.log2(F.greatest(F.col("n_docs") / F.greatest(F.lit(float(LEAST_ROWS)), F.sqrt("n_docs")), F.lit(1.0)))).cast("int")
    own = sources.select("source", "s", bits.alias("bits"))
    keyed = sizes.join(own, sizes["source"].eqNullSafe(own["source"]), "inner").drop("source")
    equals = keyed.groupBy("doc_id", "size", "th", "s", "bits").agg(F.count("*").cast("int").alias("copies"))
    keyed = equals.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("h", F.xxhash64(F.lit(20), "doc_id", "th", "copy"))
    keyed = keyed.withColumn("bucket", F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")))
    summed = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = summed.select(F.col("s").alias("s_"), F.col("bucket").alias("bucket_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", F.asc_nulls_last("doc_id"), "th", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = keyed.join(base, (F.col("s") == F.col("s_")) & (F.col("bucket") == F.col("bucket_")))
    return joined.select("doc_id", "size", "s", (F.col("base") + F.col("inside")).alias("begin"))


def _plan(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots, blocks and the interval of the unit line of every source that takes words."""
    b = F.lit(block_words)
    plan = sources.withColumn("want", F.round("target").cast("long")).where("want > 0")
    plan = plan.withColumn("blocks", F.ceil(F.col("total") / b).cast("long"))
    plan = plan.withColumn("epochs", F.expr("want div total"))
    tail = F.ceil((F.col("want") - F.col("epochs") * F.col("total")) / b).cast("long")
    plan = plan.withColumn("slots", F.col("epochs") * F.col("blocks") + tail)
    upto, whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    plan = plan.withColumn("m", F.sum("slots").over(whole)).withColumn("c", F.sum("slots").over(upto))
    return plan.select("s", "total", "want", "blocks", "slots", "m", ((F.col("c") - F.col("slots")) / F.col("m")).alias("lo"), (F.col("c") / F.col("m")).alias("hi"))


def schedule(plan: DataFrame) -> DataFrame:
    """slot, s, r: the r-th slot of source s stands at ``slot`` of the mixture."""
    spark = plan.sparkSession
    m, n = plan.agg(F.max("m"), F.count("*")).first()
    cells = 1 << max(6, int(n).bit_length() + 2)
    points = spark.range(0, int(m or 0)).withColumnRenamed("id", "slot")
    high, low = F.shiftright("slot", 20), F.col("slot").bitwiseAND(F.lit((1 << 20) - 1))
    x = F.pmod(F.pmod(high * PHI20, F.lit(1.0)) + low * PHI + 0.5, F.lit(1.0))
    points = points.withColumn("x", x).withColumn("cell", F.floor(F.col("x") * cells)).withColumn("run", F.expr(f"slot div {RUN}"))
    spans = F.sequence(F.floor(F.col("lo") * cells), F.greatest(F.floor(F.col("lo") * cells), F.ceil(F.col("hi") * cells) - 1))
    lines = plan.select("s", "lo", "hi", F.explode(spans).alias("cell"))
    chosen = points.join(lines, "cell").where("x >= lo AND x < hi").select("slot", "run", "s")
    counts = chosen.groupBy("s", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("s").alias("s_"), F.col("run").alias("run_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1
    ranked = chosen.withColumn("inside", inside).join(base, (F.col("s") == F.col("s_")) & (F.col("run") == F.col("run_")))
    ranked = ranked.select("slot", "s", (F.col("base") + F.col("inside")).alias("r"))
    due = plan.select("s", "slots", "m")
    body = ranked.join(due, "s").where("r < slots").select("slot", "s", "r")
    got = counts.groupBy("s").agg(F.sum("n").alias("got"))
    short = due.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    short = short.select("s", "m", "got", F.explode(F.expr("sequence(got, slots - 1)")).alias("r"))
    tail = short.select((F.col("m") + (F.col("r") - F.col("got")) * int(n) + F.col("s")).alias("slot"), "s", "r")
    return body.unionByName(tail)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, block_words: int = 256) -> Mixture:
    """Mix ``docs`` (doc_id, text, source).

    ``rows``: doc_id, size, source_size, target, taken.  ``pieces``: slot, epoch, s, begin, doc_id, size, from_word, n_words.
    """
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th")), "mix-sizes")
    sources = materialise(targets(sizes, weights, share, max_epochs), "mix-sources")
    placed = materialise(_positions(sizes, sources), "mix-positions")
    plan = materialise(_plan(sources, block_words), "mix-plan")
    b = F.lit(block_words)
    slots = schedule(plan).join(plan.select("s", "total", "want", "blocks"), "s")
    slots = slots.withColumn("epoch", F.expr("r div blocks"))
    # every epoch takes its blocks in another order; the last one only has those before its end
    of = slots.withColumn("of", F.when(F.col("epoch") < F.expr("want div total"), F.col("blocks")).otherwise(F.ceil((F.col("want") - F.col("epoch") * F.col("total")) / b)))
    step = F.when(F.col("of") % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1]))
    turn = F.pmod(F.xxhash64("s", "epoch"), "of")
    # (step mod of) times the rank stays below the square of the blocks
    slots = of.withColumn("block", F.pmod((step % F.col("of")) * F.expr("r % blocks") + turn, "of").cast("long"))
    until = F.least(F.col("block") * b + b, F.col("total"), F.col("want") - F.col("epoch") * F.col("total"))
    slots = slots.select("slot", "epoch", "s", "block", until.alias("until"))
    parts = placed.where("size > 0").withColumn("end", F.col("begin") + F.col("size"))
    parts = parts.withColumn("block", F.explode(F.expr(f"sequence(begin div {block_words}, (end - 1) div {block_words})")))
    joined = slots.join(parts, ["s", "block"])
    first = F.greatest(F.col("begin"), F.col("block") * b)
    joined = joined.withColumn("first", first).withColumn("n_words", F.least(F.col("end"), F.col("block") * b + b, F.col("until")) - F.col("first"))
    pieces = joined.where("n_words > 0").select("slot", "epoch", "s", "begin", "doc_id", "size", (F.col("first") - F.col("begin")).alias("from_word"), "n_words")
    taken = pieces.groupBy("s", "begin").agg(F.sum("n_words").alias("taken"))
    # documents of size 0 share their position with the next document, and take nothing
    rows = placed.withColumn("at", F.when(F.col("size") > 0, F.col("begin")))
    rows = rows.join(taken.select(F.col("s").alias("s_"), F.col("begin").alias("at_"), "taken"), (F.col("s") == F.col("s_")) & (F.col("at") == F.col("at_")), "left")
    rows = rows.join(sources.select("s", F.col("total").alias("source_size"), "target"), "s")
    return Mixture(rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), pieces)
