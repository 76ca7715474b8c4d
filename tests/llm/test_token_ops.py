"""Tokenising, packing, token files, language identification and the pipeline."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quantspark.llm import coder, langid, lines, packing, tokenfile
from quantspark.llm.queries import tokenizer_file
from quantspark.llm.tokens import Encoder

TEXTS = ["Hello  world", "", None, " lead", "trail \n", "a\n\n b", "don't I'll 123 45", "é  b", "　wide　", "ΑΣ Σας", "<|endoftext|> x", "x" * 3000, "word " * 4000, "\x85 q", "Hello  world"]
SCHEMA = "doc_id long, text string, key string, n string, shard string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "k", "n", "s") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_library_s_ids(name, spaces):
    path = tokenizer_file(name)
    plain, encoder = Tokenizer.from_file(path), Encoder(path, spaces)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(TEXTS))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_words_share_units_where_the_pattern_allows():
    path = tokenizer_file("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), Encoder(path, False)
    texts = ["Hound hound. HOUND, (hound) 4hound4", "hound'S ''s'll x''re 12,5", "H\u0331 h\u0331 I\u0307.i\u0307 e\u0301.E\u0301 <\u0338= 2\u20dd", "\u017f\u212a.k K\x00.a _a_-b"]
    encoder.encode(pa.array(texts[:1]))
    assert encoder.known == 6  # hound . , ( ) 4
    texts += ["<|ENDOFTEXT|>", "Hound.<|endoftext|>hound. <|StartOfText|>", None, ""]
    for column in (texts[:4], texts, texts[::-1]):
        ids, counts = encoder.encode(pa.array(column))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in column]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert not Encoder(tokenizer_file("byte_bpe_50k.json"), False).fine


def test_letters_of_two_bytes_share_units():
    path = tokenizer_file("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), Encoder(path, False)
    encoder.encode(pa.array(["Größe größe. ÉTÉ, (été) ДОМ;дом ΣΑΣ σασ"]))
    assert encoder.known == 9  # größe . été , ( ) дом ; σασ
    odd = [chr(i) for i in range(0x80, 0x800)]
    forms = ["{}", "a{}", "{}a", "A{0}{0}B", "{}.", ".{}", "É{}́", "4{}'s", "'{}"]
    texts = [" ".join(form.format(c) for c in odd) for form in forms]
    texts += ["Ȩ́.ȩ́ ß̣", "É", "́É", "ÀÉ 漢É", "É<|ENDOFTEXT|>É. é"]
    for column in (texts[:-1], texts):
        ids, counts = encoder.encode(pa.array(column))
        want = [plain.encode(t, add_special_tokens=False).ids for t in column]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_of_small_letters_go_to_the_model_at_once():
    encoder, sent = Encoder(tokenizer_file("word_bpe_49k.json"), False), []
    whole = encoder.tokenizer

    class Spy:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **how)

    encoder.tokenizer = Spy()
    ids, _ = encoder.encode(pa.array(["Hound größe, дом", "ünder HOUND"]))
    assert sent == [f",{encoder.mark}"]  # only the sign is normalized and split again
    assert ids.tolist() == [i for t in ("Hound größe, дом", "ünder HOUND") for i in whole.encode(t, add_special_tokens=False).ids]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n  abzÀß’'́漢0<|>endoftx", max_size=40), min_size=1, max_size=6))
def test_units_on_odd_texts(texts):
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = Encoder.of(tokenizer_file(name), spaces)
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 200_000), max_size=5000), st.integers(1, 50))
def test_coder_round_trip(ids, repeat):
    ids = np.array((ids * repeat)[:9000], np.uint32)
    assert (coder.decode_blocks(coder.encode_blocks(ids)) == ids).all()


def test_coder_predicts_and_checks(monkeypatch):
    monkeypatch.setattr(coder, "BLOCK_IDS", 4000)
    ids = np.tile(np.arange(300, dtype=np.uint32) * 97, 40)
    frames = coder.encode_blocks(ids)
    assert len(frames) == 3 and sum(map(len, frames)) < 1.2 * len(ids)  # repeated contexts cost less than plain 16-bit ids
    for at in (40, len(frames[1]) - 9, 20):
        broken = bytearray(frames[1])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode_blocks([frames[0], bytes(broken)])
    with pytest.raises(ValueError):
        coder.decode_blocks([frames[0][:-4]])
    with pytest.raises(ValueError):
        coder.unframe(b"nothing of the kind")
    alone = coder.decode_blocks(frames[2:])  # blocks are independent
    assert (alone == ids[8000:]).all()


def test_coder_beats_order_0_on_text():
    """Below the order-0 entropy of the same ids, for which a coder would have to know their frequencies beforehand."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids, counts = Encoder.of(tokenizer_file("word_bpe_49k.json"), spaces=False).encode(texts)
    ids = np.insert(ids, np.cumsum(counts), 2)
    frames = coder.encode_blocks(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * sum(map(len, frames)) / len(ids) < 0.85 * -(share * np.log2(share)).sum()
    assert (coder.decode_blocks(frames) == ids).all()


@pytest.mark.parametrize("largest", [0, 1, 65535, 65536, (1 << 18) - 1, 1 << 18, (1 << 32) - 1])
def test_coder_alphabets(largest):
    """Wide alphabets need 64-bit pairs; beyond 18 bits the lower bits are written as they are."""
    rng = np.random.default_rng(largest % 97)
    ids = np.minimum(rng.geometric(1e-3, 6000).astype(np.uint64) * np.uint64(1 + largest // 5000), np.uint64(largest)).astype(np.uint32)
    ids[17] = largest
    assert (coder.decode_blocks(coder.encode_blocks(ids)) == ids).all()


def test_coder_context_with_every_pair():
    """A context whose pairs fill much of its line, next to very frequent ones."""
    ids = np.zeros(120_000, np.uint32)
    ids[1::2] = np.arange(60_000) % 40_000
    assert (coder.decode_blocks(coder.encode_blocks(ids)) == ids).all()


def test_token_files(spark):
    path = tokenizer_file("word_bpe_49k.json")
    ids = [40, 3, 7, None, 12, 11, 10, 9, 8, 6, 5, 4, 2, 1, 0]
    got = tokenfile.round_trip(table(spark, TEXTS, ids), path).collect()
    plain, start = Tokenizer.from_file(path), 0
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    by = {r["doc_id"]: r for r in got}
    for i in order:
        want = np.array([*plain.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2], "<u4")
        r = by[ids[i]]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(want), want.tobytes())
        start += len(want)
    assert tokenfile.round_trip(table(spark, TEXTS).limit(0), path).count() == 0


def fill_brute(lengths, capacity):
    """Closest sum from below that holds the longest length."""
    lengths = sorted((x for x in lengths if x <= capacity), reverse=True)
    sums = {lengths[0]}
    for x in lengths[1:]:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=14))
def test_best_fill_is_the_closest(lengths):
    counts = np.bincount(lengths, minlength=61)
    chosen = packing.best_fill(counts, 60)
    assert sum(k * n for k, n in chosen.items()) == fill_brute(lengths, 60)
    assert all(n <= counts[k] for k, n in chosen.items())


def test_packing(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    docs = table(spark, TEXTS * 5, [*range(70), *[None] * 5])
    rows = packing.pack(docs, path, window=128, shard_docs=20).collect()
    plain, pieces, sequences = Tokenizer.from_file(path), {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i in range(70):
        want = np.array([*plain.encode(TEXTS[i % 15] or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == want.tobytes() and {r["doc_tokens"] for r in own} == {len(want)}
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    fills = [sum(r["length"] for r in own) for own in sequences.values()]
    assert max(fills) <= 128 and sum(f < 128 for f in fills) <= 4  # at most one for each shard
    assert sum(r["length"] for r in rows if r["doc_id"] is None) > 0
    assert packing.pack(docs.limit(0), path).count() == 0


SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs away with the thing",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft dann schnell davon",
    "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει",
}


@pytest.fixture(scope="module")
def model():
    return langid.train([(lang, text) for lang, text in SENTENCES.items() for _ in range(3)])


def test_language_spans(model):
    mixed = f"{SENTENCES['en']} {SENTENCES['de']}"
    pred, score, spans = langid.predict(pa.array([SENTENCES["en"], SENTENCES["de"], SENTENCES["el"], mixed, None, "", "123 ... 45", "日本語", f"7 {SENTENCES['de']} 8"]), model)
    assert pred[:3] == ["en", "de", "el"] and pred[4:7] == ["und"] * 3 and pred[8] == "de"
    assert pred[7] in model.langs and score[7] == 0 and score[4:7] == [0, 0, 0] and all(0 <= s <= 1 for s in score)
    labels = [s["lang"] for s in spans[3]]
    assert labels == ["en", "de"] and abs(spans[3][0]["n_words"] - 17) <= 1 and sum(s["n_words"] for s in spans[3]) == len(mixed.split())


def test_documents_that_are_mostly_no_learned_language_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(11)
    prose = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").first()["text"]
    some = " ".join(prose.split()[:3])
    noise = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(3, 10))) for _ in range(n))
    bad = [noise("абвгдежзиклмноп", 100) + " " + some, some + " " + noise("ابتثجحخدذرز", 100), noise("abcdefghijklmnopqrstuvwxyz", 100) + " " + some]
    good = [prose, prose.replace(" ", " &&& "), prose[: len(prose) // 2] + " " + noise("абвг", 5)]
    odd = spark.createDataFrame([(10**9 + i, t, None, "odd", len(t)) for i, t in enumerate(bad + good)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(odd), sf).collect()
    assert {r["doc_id"] - 10**9 for r in kept if r["source"] == "odd"} == {3, 4, 5}
    assert {r["doc_id"] for r in kept if r["source"] != "odd"} == {r["doc_id"] for r in docs.collect()}


def test_a_text_is_judged_alike_in_any_batch(model):
    texts = ["Der Hund.", "the quick", "über", "le chat"]
    alone = [langid.judge(pa.array([t]), model)[:3] for t in texts]
    assert [list(x) for x in zip(*langid.judge(pa.array(texts), model)[:3], strict=True)] == [[x[0] for x in a] for a in alone]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 3, (9, 3))
    begin, size = np.array([0, 5, 5, 9]), np.array([5, 0, 4, 0])
    got = langid.viterbi(scores, begin, size, switch=2.0)
    for b, n in ((0, 5), (5, 4)):
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = scores[np.arange(b, b + n), paths].sum(1) - 2.0 * (np.diff(paths, axis=1) != 0).sum(1)
        assert tuple(got[b : b + n]) == tuple(paths[value.argmax()])
    assert len(langid.viterbi(np.zeros((0, 3)), np.array([], int), np.array([], int))) == 0


def test_language_query_learns_only_from_its_folds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r["lang"], r["text"]) for r in langid.training_rows(docs, per_lang=10).collect()]
    held = {r["text"] for r in docs.where(langid.fold() == 1).collect()}
    kept = {r["text"] for r in docs.where(langid.fold() != 1).collect()}
    assert rows and all(t in kept for _, t in rows) and not {t for _, t in rows} & (held - kept)
    assert max(sum(lang == x for x, _ in rows) for lang in {x for x, _ in rows}) <= 10
    found = langid.identify(docs).where(langid.fold() == 1).collect()
    assert np.mean([r["qs_lang"] == r["lang"] for r in found]) > 0.95
    long = spark.createDataFrame([(1, "der Hund " * 20_000, "de"), (2, None, None), (3, "the dog " * 10, "en")], "doc_id long, text string, lang string")
    assert len(langid.identify(long).collect()) == 3 and langid.identify(long.limit(0)).count() == 0


def test_training_on_executors_equals_training_in_memory(spark, sf):
    """Also with one id repeated very often, whose rows count as one, and with null ids, which never train."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where((langid.fold() != 1) & F.col("lang").isNotNull()).orderBy("doc_id").limit(1)
    many = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3000)))).select("doc_id", F.concat("text", F.col("i").cast("string")).alias("text"), "lang")
    docs = docs.unionByName(many).unionByName(many.limit(50).withColumn("doc_id", F.lit(None).cast("long")))
    rows = langid.training_rows(docs).collect()
    assert len(rows) == docs.where((langid.fold() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id").distinct().count()
    a, b = langid.fit(docs), langid.train([(r["lang"], r["text"]) for r in rows])
    assert a.langs == b.langs and a.prior == b.prior and (a.scripts == b.scripts).all() and np.allclose(a.table, b.table)


def test_scores_by_brute_force(model):
    """A document's language and score from their definitions, word by word and over all paths."""
    texts = ["der Hund und the dog", "le chat noir !!", "über 12 the", "ο σκύλος der"]
    pred, score, coverage, _ = langid.judge(pa.array(texts), model)
    n = len(model.langs)
    for i, text in enumerate(texts):
        words, letters, scores = langid.word_scores(pa.array([text]), model)
        paths = np.stack(np.meshgrid(*[range(n)] * len(scores), indexing="ij"), -1).reshape(-1, len(scores))
        value = scores[np.arange(len(scores)), paths].sum(1) - langid.SWITCH * (np.diff(paths, axis=1) != 0).sum(1)
        best, trust = paths[value.argmax()], dict.fromkeys(range(n), 0.0)
        for w, label in enumerate(best):
            share = np.exp(scores[w, label]) / np.exp(scores[w]).sum()
            trust[label] += letters[w] * max((share - 1 / n) / (1 - 1 / n), 0)
        top = max(trust, key=lambda k: (trust[k], -k))
        assert pred[i] == model.langs[top] and score[i] == pytest.approx(trust[top] / sum(trust.values()), rel=1e-4)
        assert 0 <= coverage[i] <= 1


def test_a_long_text_s_chunks_know_their_neighbours(model, monkeypatch):
    text = " ".join([SENTENCES["en"], SENTENCES["de"]] * 12)
    whole = langid.judge(pa.array([text, "the dog"]), model)
    monkeypatch.setattr(langid, "CHUNK", 50)
    assert langid.judge(pa.array([text, "the dog"]), model)[3] == whole[3]


def test_clashing_columns(spark, model):
    docs = spark.createDataFrame([(1, "the quick dog", "en", 1, "x", 2)], "doc_id long, text string, lang string, qs_lang int, QS_SPANS string, qs_rid int")
    got = langid.identify(docs, model=model)
    assert got.columns == ["doc_id", "text", "lang", "qs_rid", "qs_lang", "qs_score", "qs_coverage", "qs_spans"] and got.first()["qs_lang"] == "en"


def test_pipeline_keeps_unlabelled_and_empty_corpora(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on its own input: what the plain definitions say must hold."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "123 456", None, "src0", 7), (10**6 + 1, None, "en", None, None)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        assert name == "pack_windows" or docs.columns == columns
    before, after = seen["language_id"]
    assert {10**6, 10**6 + 1} == before.keys() - {r["doc_id"] for r in after}
    before, after = seen["line_dedup"]
    kept = {}
    for i in sorted(before):
        for line in before[i]["text"].split("\n"):
            kept.setdefault(line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines.UPPER, lines.LOWER)), i)
    for r in after:
        own = [x for x in before[r["doc_id"]]["text"].split("\n") if len(k := x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines.UPPER, lines.LOWER))) < 10 or kept[k] == r["doc_id"]]
        assert r["text"] == "\n".join(own)
    before, after = seen["near_dedup"]
    assert len({r["doc_id"] for r in after}) == len(after) <= len(before)
    before, after = seen["mix_sources"]
    counts = {i: sum(r["doc_id"] == i for r in after) for i in before}
    assert max(counts.values()) == 2 and all(r["text"] == before[r["doc_id"]]["text"] for r in after)
    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    _, pieces = seen["pack_windows"]
    want = sum(n * (len(plain.encode(before[i]["text"], add_special_tokens=False).ids) + 1) for i, n in counts.items())
    assert sum(r["length"] for r in pieces) == want == sum(len(r["ids"]) // 4 for r in pieces)
    assert corpus_pipeline.run(spark, sf).count() > 0
