r"""Chat formatting with a grammar round trip (native).

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<|turn|>" level role "\n" body "<|end|>"
    level        := "0" | "1" | "2"

No control string may stand inside a role or a body.  Level 0 holds texts as they are.  Level 1 escapes the body: every
backslash is doubled and a backslash is put after the first character of every control string.  Level 2 also writes the
role in hexadecimal.  Each turn is rendered at the lowest level, reparsed by the deterministic parser and compared with
its source; while it differs, the next level is tried.  Levels 1 and 2 are reversible by construction, so the loop ends.

Defined results: null texts and roles count as empty; turns are ordered by (turn, role, text), null turns first, so
ties and repeated rows have one order; rows with a null conv_id belong to no other row and are conversations of one turn
each, so that they never meet in one group; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this grammar and those of common chat templates, which a model may know as special tokens.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEVELS = (0, 1, 2)
#: Turns whose lengths are summed at once.
BLOCK = 256


def has_control(text: Column) -> Column:
    found = F.lit(False)
    for mark in CONTROL:
        found = found | F.contains(text, F.lit(mark))
    return found


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, level: int) -> Column:
    head = role if level < 2 else F.hex(F.encode(role, "UTF-8"))
    return F.concat(F.lit(f"{TURN}{level}"), head, F.lit("\n"), text if level == 0 else escape(text), F.lit(END))


def decode_body(body: Column, level: Column) -> Column:
    return F.when(level == "0", body).otherwise(unescape(body))


def _chunks(formatted: Column) -> Column:
    return F.split(formatted, r"<\|end\|>", -1)


def _turn(chunk: Column, before: Column, ends_well: Column) -> Column:
    """One turn of the grammar from its text without the end mark; ``before``: code points that stand before it."""
    head = len(TURN)
    level, rest = F.substring(chunk, head + 1, 1), F.substr(chunk, F.lit(head + 2))
    cut = F.instr(rest, "\n")
    raw, body = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut + 1)
    role = F.when(level == "2", F.decode(F.unhex(raw), "UTF-8")).otherwise(raw)
    valid = ends_well & chunk.startswith(TURN) & level.isin("0", "1", "2") & (cut > 0) & ~has_control(raw) & ~has_control(body)
    return F.struct(
        role.alias("role"),
        decode_body(body, level).alias("text"),
        level.alias("level"),
        (before + head + 1 + cut + 1).cast("int").alias("start"),
        F.length(body).alias("length"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parse(rows: DataFrame, formatted: str = "formatted") -> DataFrame:
    """``rows`` with ``turns``: the turns of a formatted text with the 1-based position and length, in code points, of each body.

    A text that the grammar rejects gives at least one turn whose ``valid`` is false.  Every step is a column of its own, so
    that nothing is split twice; positions are sums of whole blocks of turns and of the turns of one block, so that a
    long conversation costs its number of turns times a few hundred, not its square.
    """
    rows = rows.withColumn("qs_chunks", _chunks(F.col(formatted))).withColumn("qs_ends", F.element_at("qs_chunks", -1) == "")
    rows = rows.withColumn("qs_chunks", F.slice("qs_chunks", F.lit(1), F.size("qs_chunks") - 1))
    rows = rows.withColumn("qs_lengths", F.transform("qs_chunks", lambda c: F.length(c).cast("long") + len(END)))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + x)
    blocks = F.sequence(F.lit(0), F.expr(f"size(qs_lengths) div {BLOCK}"))
    rows = rows.withColumn("qs_sums", F.transform(blocks, lambda b: total(F.slice("qs_lengths", (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))))

    def one(chunk: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = total(F.slice("qs_sums", F.lit(1), block)) + total(F.slice("qs_lengths", block * BLOCK + 1, i - block * BLOCK))
        return _turn(chunk, before, F.col("qs_ends"))

    return rows.withColumn("turns", F.transform("qs_chunks", one)).drop("qs_chunks", "qs_ends", "qs_lengths", "qs_sums")


def _recovers(formatted: Column, role: Column, text: Column) -> Column:
    """Whether the parser reads one turn back identically: one end mark, at the end, and the same role and text before it."""
    alone = F.length(formatted) - len(END)
    got = _turn(F.substr(formatted, F.lit(1), alone), F.lit(0), F.instr(formatted, END) == alone + 1)
    return got["valid"] & (got["role"] == role) & (got["text"] == text)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the turn's rendering at the lowest level that the parser reads back identically."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    best = render(role, text, LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        tried = render(role, text, level)
        best = F.when(_recovers(tried, role, text), tried).otherwise(best)
    return rows.withColumn("rendered", best)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation.

    conv_id; ``formatted``; ``turns``, the parse of the formatted text; ``loss_spans``, the 1-based start and length of
    every assistant body with its escape level; ``identical``, whether the recovered turns equal the source.
    """
    turn = F.struct("turn", "role", "text", "rendered")
    made = format_turns(rows)
    grouped = made.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))
    grouped = grouped.unionByName(made.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("source")))
    grouped = grouped.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["rendered"]), ""))
    grouped = parse(grouped)
    same = F.transform("turns", lambda t: F.struct(t["role"], t["text"])) == F.transform("source", lambda t: F.struct(t["role"], t["text"]))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["level"].alias("level")),
    )
    return grouped.select(
        "conv_id", "formatted", "turns", spans.alias("loss_spans"),
        (same & F.forall("turns", lambda t: t["valid"])).alias("identical"),
    )


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, cut out of the formatted text and unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: decode_body(F.substring(F.col(formatted), s["start"], s["length"]), s["level"])), ""
    )
