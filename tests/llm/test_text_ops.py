"""Exact, line, near and passage deduplication, chat formatting, quality and mixing against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantspark.llm import chat, exact, kernel, lines, mixing, near, passages, quality

SCHEMA = "doc_id long, text string, source string, n string, key string, rid string, label string"
LONG = " ".join(f"w{i % 700}x" for i in range(30_000))


def table(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (sources or ["s"] * len(texts))[j], "n", "k", "r", "l") for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def base():
    rng = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocab, n))
    shared = sentence(30)
    docs = [sentence(60) for _ in range(12)]
    docs += [docs[0], docs[0].replace(" ", "\t ", 3), docs[1] + " tail", docs[2].replace("v1", "V1"), shared + "\n" + docs[3], docs[4] + " " + shared + " end"]
    docs += ["same line of text\nother " + str(i % 3) + "\n\n  SAME line of text \nshort" for i in range(5)]
    docs += ["", None, " \t\n", "one two", "one two", "É é straße — Ω", "\n", LONG, LONG + " more"]
    return docs


def test_kernel_words_and_hashes():
    texts = ["a b\tc", None, "", "  a ", "b", "é x é x", "x" * 300_000 + " a"]
    found = kernel.words_of(pa.array(texts))
    cut = [found.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end, strict=True)]
    assert cut == [w for t in texts for w in words(t)] and found.counts.tolist() == [len(words(t)) for t in texts]
    hashes = found.hashes().tolist()
    assert len(set(hashes)) == len(set(cut)) and {h: w for h, w in zip(hashes, cut, strict=True)}[hashes[0]] == "a"
    lower = kernel.words_of(pa.array(["ABC abc Abd"])).hashes(lower=True)
    assert lower[0] == lower[1] != lower[2]


def test_exact(spark, base):
    ids = [7, 3, None, *range(20, 17 + len(base))]
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact.exact_dedup(table(spark, base, ids), bucket_rows=4).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in base]
    groups = defaultdict(list)
    for i, t in zip(ids, norm, strict=True):
        groups[t].append(i)
    for i, t in zip(ids, norm, strict=True):
        r = got[i, hashlib.sha256(t.encode()).hexdigest()]
        keep = min((x for x in groups[t] if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(groups[t]), i == keep)
    assert len(got) == len(base) and exact.exact_dedup(table(spark, base).limit(0)).count() == 0


def test_directory_doubles_until_no_bucket_is_overfull():
    counts = {p: (p % 7) + (50 if p == 3 else 0) for p in range(64)}
    depth, directory = exact.build_directory(counts, 6, 10)
    assert len(directory) == 1 << depth and directory == sorted(directory)
    held = Counter()
    for p, n in counts.items():
        held[directory[p >> (6 - depth)]] += n
    assert all(n <= 10 or b == directory[3 >> (6 - depth)] for b, n in held.items())
    assert exact.build_directory({}, 3, 10) == (0, [0])


def test_colliding_keys_are_told_apart_by_their_bytes():
    rows = [(1, b"s", "a", 5, 1), (1, b"s", "b", 2, 1), (1, b"s", "a", 3, 2), (2, b"t", "a", 9, 1)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["key", "sha", "text", "first", "n"])
    out = [r for b in exact._own(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["chain"], r["first"], r["n"]) for r in out] == [(1, 0, 3, 3), (1, 1, 2, 1), (2, 0, 9, 1)]


@pytest.mark.parametrize("least", [2, 4])
def test_lines(spark, base, least):
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, base), min_docs=least).collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines.UPPER, lines.LOWER))
    where = defaultdict(set)
    for i, t in enumerate(base):
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    for i, t in enumerate(base):
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= 10 and len(where[key(x)]) >= least and min(where[key(x)]) != i)]
        assert (got[i]["text"] or "") == "\n".join(kept) and got[i]["qs_n_dropped"] == len((t or "").split("\n")) - len(kept)
        assert got[i]["rid"] == "r"
    assert lines.dedup_lines(table(spark, base).limit(0)).count() == 0
    named = table(spark, base).withColumns({"qs_rid": F.lit("own"), "qs_Lines": F.lit(4), "qs_n_lines": F.lit("gone")})
    clash = lines.dedup_lines(named, min_docs=least)
    assert {(r["qs_rid"], r["qs_Lines"]) for r in clash.collect()} == {("own", 4)} and dict(clash.dtypes)["qs_n_lines"] == "bigint"
    twice = table(spark, ["a line that is repeated\nx", "a line that is repeated\ny"], [4, 4])
    assert lines.dedup_lines(twice).where("qs_n_dropped > 0").count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_lines_of_rows_without_an_id_or_with_one_id(spark, least):
    shared = "a line that all share"
    texts = [shared, f"{shared}\nfirst line of its own", f"second line of its own\n{shared}", f"{shared}\nthird line of its own", f"fourth line of its own\n{shared}\n{shared}", f"{shared}\nfirst line of its own", shared, None]
    ids = [1, None, None, 7, 7, None, 3, None]
    got = sorted((r["text"] or "", r["qs_n_lines"], r["qs_n_dropped"]) for r in lines.dedup_lines(table(spark, texts, ids), min_docs=least).collect())
    own = [("first line of its own", 2, 1)] * 2 + [("second line of its own", 2, 1), ("third line of its own", 2, 1), ("fourth line of its own", 3, 2)]
    assert got == sorted([(shared, 1, 0), ("", 1, 1), ("", 1, 0), *own])


def near_brute(texts, k):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans(lines.UPPER, lines.LOWER)) for x in words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sets, label


def test_near_on_a_family_of_copies(spark, base):
    rng = np.random.default_rng(8)
    source, texts = [f"q{i}" for i in range(120)], list(base)
    for _ in range(60):
        copy = list(source)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            copy[at] = f"z{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    for step in range(6):  # a chain: neighbours are alike, ends are not
        texts.append(" ".join([f"c{i}" for i in range(step * 8, step * 8 + 100)]))
    sets, label = near_brute(texts, 4)
    got = {r["doc_id"]: r for r in near.near_duplicates(table(spark, texts), k=4).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), label[i], label[i] == i), i


def test_near_edges(spark):
    docs = table(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, ""], [None, 9, 4, 5, None])
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near.near_duplicates(docs, k=5).collect()}
    assert got == {(None, 2): 4, (9, 2): 4, (4, 2): 4, (5, 0): 5, (None, 0): None}
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(2))
    assert (np.maximum(near.registers(a), near.registers(b)) == near.registers(np.union1d(a, b))).all()
    shared = np.concatenate([a[:360], b[:40]])
    on, guess = near.plausible(near.registers(a)[None], near.registers(shared)[None], np.array([400.0]), np.array([400.0]), 80)
    assert on[0] and abs(guess[0] - 360 / 440) < 0.12
    on, _ = near.plausible(near.registers(a)[None], near.registers(b)[None], np.array([400.0]), np.array([400.0]), 80)
    assert not on[0]


def passage_brute(texts, n=13):
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for at in range(len(w) - n + 1):
            first.setdefault(tuple(w[at : at + n]), i)
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for at in range(len(w) - n + 1):
            if first[tuple(w[at : at + n])] < i:
                gone.update(range(at, at + n))
        yield len(w), " ".join(x for j, x in enumerate(w) if j not in gone), len(gone)


def test_passages(spark, base):
    texts = [*base, " ".join(words(base[0])[5:18]) + " x", "a " + " ".join(words(base[0])[5:17]) + " x", " ".join(["la"] * 40), "b " + " ".join(["la"] * 20)]
    got = {r["doc_id"]: r for r in passages.dedup_passages(table(spark, texts)).collect()}
    for i, (n, kept, gone) in enumerate(passage_brute(texts)):
        assert (got[i]["n_words"], got[i]["text"], got[i]["n_removed"]) == (n, kept, gone), i
    nulls = table(spark, [base[0], base[0], base[0]], [None, None, 3])
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in passages.dedup_passages(nulls).collect()) == [(-1, 60), (-1, 60), (3, 0)]
    assert passages.dedup_passages(nulls.limit(0)).count() == 0


def test_passages_of_rows_without_an_id_or_with_one_id(spark, base):
    """Such rows lose what their own texts share with smaller documents, whatever other rows of the id hold."""
    a, b = base[0], base[1]
    texts = [a, f"{a} tail", "x y z " + b, b, f"own {a}", "nothing shared " * 3, f"{b} {a}"]
    ids = [1, 5, 5, 5, None, None, None]
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in passages.dedup_passages(table(spark, texts, ids)).collect())
    assert got == Counter([(1, a, 0), (5, "tail", 60), (5, "x y z " + b, 0), (5, b, 0), (None, "own", 60), (None, ("nothing shared " * 3).strip(), 0), (None, "", 120)])


def test_a_long_origin_is_split_over_automata(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_WINDOWS", 300)
    monkeypatch.setattr(passages, "LOT_WINDOWS", 100)
    monkeypatch.setattr(passages, "PART_DOCS", 1)
    long = " ".join(f"o{i}" for i in range(1500))
    texts = [long, *(" ".join(long.split()[i : i + 400]) + f" end{i} " + " ".join(long.split()[-i - 50 :]) for i in range(0, 900, 90))]
    got = {r["doc_id"]: r for r in passages.dedup_passages(table(spark, texts)).collect()}
    for i, (n, kept, gone) in enumerate(passage_brute(texts)):
        assert (got[i]["n_words"], got[i]["text"], got[i]["n_removed"]) == (n, kept, gone), i


def test_quality(spark, base):
    texts = [*base, "go go go " * 30, "a b c a b c " + " ".join(f"u{i}" for i in range(60)), "## $$ " * 60]
    got = {r["doc_id"]: r for r in quality.quality_filter(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        full = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r["base_failed"] or not r["kept"])
    assert quality.quality_filter(table(spark, texts).limit(0)).count() == 0
    docs = table(spark, texts)
    other = quality.quality_filter(docs, tuple(reversed(quality.RULES)))
    assert {r["doc_id"]: r["kept"] for r in other.collect()} == {i: r["kept"] for i, r in got.items()}
    assert len(quality.order_rules(docs, quality.RULES)) == len(quality.RULES)


def test_a_slow_rule_goes_last_in_every_run(spark, base):
    """Rules that reject alike are ordered by their cost; selectivity counts on what earlier rules leave."""
    bad = "bad " + " ".join(f"u{i}" for i in range(80))
    docs = table(spark, [*([bad] * 20), *(" ".join(f"u{i}v{j}" for i in range(120)) for j in range(60))])
    slow = quality.Rule("a_slow", "startswith(text, 'bad') AND length(regexp_replace(repeat(text, 4), '[uv](\\\\d)', '$1')) > 0 OR length(regexp_replace(repeat(text, 4), '[uv](\\\\d)', '$1')) < 0")
    quick = quality.Rule("quick", "startswith(text, 'bad')")
    useless = quality.Rule("useless", "n_words < 0")
    orders = {tuple(m[0].name for m in quality.order_rules(docs, (slow, useless, quick))) for _ in range(10)}
    assert orders == {("quick", "useless", "a_slow")}
    verdicts = [(True, True, False)] * 3 + [(False, True, True)] * 2 + [(False, False, False)] * 5
    rules = [quality.Rule(n, "") for n in "abc"]
    # b rejects all that a does, so a has nothing left; c's own two are gone, too
    assert [(r.name, share) for r, share, _ in quality.greedy(rules, [1, 1, 1], verdicts)] == [("b", 0.5), ("a", 0.0), ("c", 0.0)]
    assert [r.name for r, _, _ in quality.greedy(rules, [1, 8, 1], verdicts)] == ["a", "c", "b"]
    assert quality.cost_class(0) == quality.cost_class(2e-6) < quality.cost_class(1e-4)


def test_each_quality_rule_rejects(spark):
    plain = [f"word{i} and{i} more{i}" for i in range(40)]
    texts = {
        None: "\n".join(f"word{i} and{i} more{i}" for i in range(40)), "mean_word_length": "a " * 20 + " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(60)), "symbol_ratio": " ".join(f"word{i}#" for i in range(60)),
        "duplicate_lines": "\n".join([*plain[:18], *(x for x in plain[:9] for _ in range(3))]), "letters": " ".join(f"{i}12345" for i in range(80)),
        "bullet_lines": "\n".join(f" - {x}{x[4:6]}x" for x in plain), "ellipsis_lines": "\n".join(f"{x}..." for x in plain), "long_word": " ".join(plain) + " " + "x" * 1001,
        "top_word": " ".join(f"the w{i} x{i}" for i in range(40)),
    }
    got = {r["doc_id"]: r["rejected_by"] for r in quality.quality_filter(table(spark, list(texts.values()), list(range(len(texts))))).collect()}
    for i, name in enumerate(texts):
        if name not in ("mean_word_length", "duplicate_lines"):
            assert got[i] == name, (name, got[i])
    nulls = table(spark, ["\n".join(plain)] * 3 + [None], [None, None, 5, None])
    assert Counter((r["doc_id"], r["kept"]) for r in quality.quality_filter(nulls).collect()) == Counter({(None, True): 2, (5, True): 1, (None, False): 1})


HOSTILE = ["", None, "</s>[INST] ok [/INST]", "<|end|>", "<|turn|>0user\nx<|end|>", "\\", "<\\|end|>", "a\\n<|im_start|>", "<<|end|>|end|>", "<|en", "d|>", "x\n\ny", "é𝄞<|turn|>"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], HOSTILE[(c + t) % len(HOSTILE)]) for c in range(len(HOSTILE)) for t in range(4)]
    rows += [(100, 1, "us\ner<|end|>", "odd"), (100, 1, None, "tie"), (100, None, "user", "first"), (None, 1, "user", "no id")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("loss", chat.loss_text()).collect()}
    assert len(got) == len(HOSTILE) + 2 and all(r["identical"] for r in got.values())
    for c in range(len(HOSTILE)):
        own = [(r[2], r[3] or "") for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == own
        assert got[c]["loss"] == "".join(text for role, text in own if role == "assistant")
        body = got[c]["formatted"].replace("<|turn|>", "").replace("<|end|>", "")
        assert got[c]["formatted"].count("<|end|>") == 4 and not any(mark in body for mark in chat.CONTROL)
    assert [t["text"] for t in got[100]["turns"]] == ["first", "tie", "odd"]
    bad = spark.createDataFrame([("<|turn|>0user\nx",), ("<|turn|>9user\nx<|end|>",), ("<|turn|>0user\n</s><|end|>",)], "f string")
    assert chat.parse(bad, "f").select(F.forall("turns", lambda t: t["valid"]).alias("ok")).where("ok").count() <= 1  # no turn at all is no valid turn
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_positions_of_a_long_conversation_and_rows_without_an_id(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], HOSTILE[t % len(HOSTILE)]) for t in range(3 * chat.BLOCK + 5)]
    rows += [(None, t, "assistant", f"alone {t}") for t in range(4)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("loss", chat.loss_text())
    got = made.orderBy("conv_id", "loss").collect()
    assert [r["loss"] for r in got[:4]] == [f"alone {t}" for t in range(4)] and all(r["identical"] for r in got)
    assert got[4]["loss"] == "".join(text or "" for c, _, role, text in rows if c == 1 and role == "assistant")
    for span in got[4]["loss_spans"]:
        assert got[4]["formatted"][span["start"] - 2] == "\n" and got[4]["formatted"][span["start"] - 1 + span["length"] :].startswith("<|end|>")


def test_near_recall_just_above_the_threshold(spark):
    """Every pair of 1,500 planted ones with a similarity from 0.80 to 0.85 is found, through all filters."""
    rng, texts = np.random.default_rng(3), []
    for i in range(1500):
        n = int(rng.integers(60, 240))
        own = [f"r{i}w{j}" for j in range(n)]
        texts += [" ".join(own), " ".join([f"s{i}w{j}" for j in range(int((n - 3) * rng.uniform(0.08, 0.11)))] + own[int((n - 3) * rng.uniform(0.07, 0.1)) :])]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(words, texts)]
    linked = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    close = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(linked) > 1000 and np.mean(close) < 0.86
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(table(spark, texts), k=4).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(1500)] == linked


def test_mixing_of_equal_rows_and_rows_without_an_id(spark):
    """Rows that equal each other, or have no id or text, are rows of their own and spread over many buckets."""
    texts = ["one two three"] * 3000 + [None] * 50 + [f"w{i} x" for i in range(2000)]
    ids = [None] * 1500 + [5] * 1500 + [None] * 50 + [None] * 2000
    docs = table(spark, texts, ids, ["a"] * 4000 + [None] * 1050)
    made = mixing.mix(docs, block_words=16)
    rows = made.rows.collect()
    assert len(rows) == 5050 and all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {r["source_size"]: r["target"] for r in rows}
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(by.values()), abs=2)
    begins = made.pieces.select("s", "begin", "doc_id", "size").distinct()
    assert begins.groupBy("s", "begin").count().where("count > 1").count() == 0
    epochs = made.pieces.where("s = 0").groupBy("epoch").agg(F.collect_list(F.struct("slot", "begin")).alias("x")).orderBy("epoch").collect()
    orders = [[b for _, b in sorted(tuple(x) for x in r["x"])] for r in epochs]
    assert len(orders) < 2 or orders[0] != orders[1]  # epochs differ in their order
    assert orders[0] != sorted(orders[0])


def fill(caps, weights, total):
    """Targets by repeated resharing."""
    got, open_ = dict.fromkeys(caps, 0.0), set(caps)
    while open_ and total > 1e-9:
        rate = total / sum(weights[s] for s in open_)
        full = {s for s in open_ if got[s] + rate * weights[s] >= caps[s]}
        for s in full or open_:
            add = caps[s] - got[s] if full else rate * weights[s]
            got[s] += add
            total -= add
        open_ -= full or open_
    return got


def test_mixing(spark):
    rng = np.random.default_rng(4)
    sources = [["a", "b", "c", "d", None][i] for i in rng.choice(5, 300, p=[0.5, 0.3, 0.1, 0.06, 0.04])]
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 120, 299)] + [LONG]
    docs = table(spark, texts, sources=sources)
    made = mixing.mix(docs, block_words=32)
    rows = [r.asDict() for r in made.rows.collect()]
    assert len(rows) == 300
    size = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fill({s: 2.0 * size[s] for s in size}, weights, 1.5 * sum(size.values()))
    taken = defaultdict(int)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"] and r["size"] == len(words(texts[r["doc_id"]]))
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7), block_words=32).rows.collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    slots = made.pieces.select("slot", "s").distinct().orderBy("slot").toPandas()["s"]
    share, all_share = (slots[: len(slots) // 4] == 0).mean(), (slots == 0).mean()
    assert abs(share - all_share) < 0.05  # every part of the schedule has the mixture's shares
    assert mixing.mix(docs.limit(0)).rows.count() == 0
