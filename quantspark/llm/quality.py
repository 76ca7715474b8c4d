"""Quality rules as a short-circuit cascade (native).

Every rule is an expression that is true when a document is rejected.  On a bounded sample each rule's cost and selectivity are
estimated, and the cascade evaluates the rules by falling rejection per cost: a document that one rule rejects is never
shown to the later ones.  The order changes the cost and the reported ``rejected_by``, never the verdict.

* Selectivity: one job gives every rule's verdict on the sample's documents that pass the base rule, which come first in any case.  The
  order is greedy: the next rule is the one that rejects most of what the rules before it leave, per cost.
* Cost: a rule is evaluated on some documents within one task, once and then so many times over that the difference, which
  holds no job's overhead, is clear of noise.  Costs count in powers of ``STEP`` above ``LEAST_COST``, so that noise does not
  reorder rules that cost about the same.

Defined results: a null or empty text has no words and fails the base rule; ties and repeated rows are judged one by one;
an empty table gives an empty result; null ``doc_id`` is passed through; a sample without rows keeps the given order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dispose, materialise

WORD = r"[^\x20\x09-\x0D]+"
SAMPLE_ROWS = 1000
#: Documents that costs are measured on, seconds that tell a cost from noise, and the most repetitions of a document.
COST_ROWS, CLEAR, MOST = 50, 0.4, 1000
#: Seconds a document below which costs do not differ, and the ratio of one class of costs to the next.
LEAST_COST, STEP = 1e-5, 8.0


@dataclass(frozen=True)
class Rule:
    """``reject`` is an expression over the columns of :func:`with_base` (``text`` among them)."""

    name: str
    reject: str


#: Thresholds are lenient: each one only catches text that no prose looks like.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("symbol_ratio", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("letters", r"2 * length(regexp_replace(text, '\\P{L}+', '')) < word_chars"),
    Rule("bullet_lines", r"n_lines >= 3 AND 10 * size(filter(lines, x -> x RLIKE '^[\\x20\\x09-\\x0D]*[-*•]')) > 9 * n_lines"),
    Rule("ellipsis_lines", r"10 * size(filter(lines, x -> x RLIKE '([.][.][.]|…)[\\x20\\x09-\\x0D]*$')) > 3 * n_lines"),
    Rule("long_word", "exists(words, w -> length(w) > 1000)"),
    # sorted words, moved by three tenths of their number, meet themselves where one word is more frequent than that
    Rule("top_word", """array_contains(zip_with(
        slice(sort_array(words), 1, cast(n_words - 30 * n_words div 100 as int)),
        slice(sort_array(words), cast(30 * n_words div 100 + 1 as int), size(words)), (a, b) -> a <=> b), true)"""),
)
BASE_RULE = Rule("base", "n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Words in three-word windows that the text holds twice or more.

    Window hashes are sorted together with their positions; equal neighbours are the repeated windows.  Texts whose
    window hashes are all distinct, the common case, never reach the sort.
    """
    windows = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    hashes = F.transform(windows, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    docs = docs.withColumn("grams", hashes)
    ordered = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    docs = docs.withColumn("ordered", F.when(some, ordered))
    again = F.filter(
        "ordered",
        lambda x, i: (x["h"] == F.get("ordered", i - 1)["h"]) | (x["h"] == F.get("ordered", i + 1)["h"]),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    count = F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))
    return docs.withColumn("n_repeat_words", count.cast("long")).drop("grams", "ordered")


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), its words and lines with a word, and the base counts of every whole text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    text = text.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    text = _repeat_words(text)
    return text.select(
        "doc_id",
        "text",
        "words",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("text", F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def cost_class(seconds: float) -> float:
    """A cost as the nearest power of ``STEP`` times ``LEAST_COST``."""
    return LEAST_COST * STEP ** max(0, round(math.log(max(seconds, LEAST_COST) / LEAST_COST, STEP)))


def rule_cost(some: DataFrame, rule: Rule, rows: int) -> float:
    """Seconds a document; ``some`` is one partition, whose rows are read once and then repeated.

    The long run is made longer until it takes ``CLEAR`` seconds more than the short one, or its repetitions reach ``MOST``.
    """

    def run(n: int) -> float:
        again = some.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(n))))
        began = time.perf_counter()
        again.agg(F.count_if(F.expr(rule.reject))).first()
        return time.perf_counter() - began

    run(1)  # compiles the expression
    short, n, more = run(1), 1, 0.0
    while more < CLEAR and n < MOST:
        n = min(n * 10, MOST)
        more = run(n) - short
    return max(more, 0.0) / (rows * (n - 1))


def greedy(rules: Sequence[Rule], costs: Sequence[float], verdicts: Sequence[Sequence[bool]]) -> list[tuple[Rule, float, float]]:
    """(rule, share it rejects of what is left, cost) by falling rejection per cost; ties and useless rules go by cost and name."""
    out, left, open_ = [], list(verdicts), list(range(len(rules)))
    while open_:
        hits = {i: sum(row[i] for row in left) for i in open_}
        best = min(open_, key=lambda i: (-hits[i] / costs[i], costs[i], rules[i].name))
        out.append((rules[best], hits[best] / max(len(left), 1), costs[best]))
        left = [row for row in left if not row[best]]
        open_.remove(best)
    return out


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share of what reaches it, cost class) in the cascade's order, from at most ``2 * sample_rows`` documents.

    The sample only decides the order; the verdicts are computed over all documents.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    share = min(1.0, sample_rows / total)
    # written first: a filter on top would be pushed down with the counts inlined and so evaluate them over and over
    whole = materialise(with_base(docs.sample(share, seed=7).limit(2 * sample_rows)), "quality-sample")
    sample = whole.where(f"NOT ({BASE_RULE.reject})")
    # a few bytes of each of at most 2 * sample_rows documents
    verdicts = [tuple(bool(x) for x in r) for r in sample.select(*[F.expr(r.reject).alias(f"r{i}") for i, r in enumerate(rules)]).collect()]
    if not verdicts:
        dispose(whole)
        return [(r, 0.0, 0.0) for r in rules]
    some = materialise(sample.limit(COST_ROWS).coalesce(1), "quality-some")
    costs = [cost_class(rule_cost(some.coalesce(1), r, min(COST_ROWS, len(verdicts)))) for r in rules]
    dispose(whole, some)
    return greedy(rules, costs, verdicts)


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null; CASE evaluates its branches one after another and stops."""
    verdict = None
    for rule in rules:
        verdict = (F.when if verdict is None else verdict.when)(F.expr(rule.reject), F.lit(rule.name))
    return F.lit(None).cast("string") if verdict is None else verdict.otherwise(F.lit(None))


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, ``base_failed``, ``rejected_by`` (first rule of the measured order) and ``kept`` of every document."""
    ordered = [m[0] for m in order_rules(docs, rules, sample_rows)]
    counted = with_base(docs).withColumn("base_failed", F.expr(BASE_RULE.reject))
    verdict = F.when(F.col("base_failed"), F.lit(BASE_RULE.name)).otherwise(cascade(ordered))
    return counted.withColumn("rejected_by", verdict).drop("words", "lines").withColumn("kept", F.col("rejected_by").isNull())
