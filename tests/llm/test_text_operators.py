import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxcube.llm import chat_format, decontaminate, langid, mixing, pii, token_counts, token_output

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "de": "der die und ist nicht über schön häuser straße größe mit einem für auf werden".split(),
    "en": "the and is not over nice houses street with one for have been which their".split(),
    "es": "el la y es no sobre bonito casas calle con uno para años niño señor".split(),
}


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[lang][i] for i in rng.integers(0, 15, n))


def corpus(spark):
    rows = [(k, prose(lang, 5 + k % 40, k), lang, f"s{k % 4}", 0) for k, lang in enumerate(["de", "en", "es"] * 40)]
    rows += [(900, None, "en", None, 0), (901, "", None, "s1", 0), (902, "12 34 !!", "en", "s1", 0), (903, prose("en", 20000, 1), None, "s2", 0)]
    return spark.createDataFrame(rows, DOCS)


# --- languages --------------------------------------------------------------------------------------------------------


def test_languages(spark):
    df = corpus(spark).withColumn("lang_pred", F.lit("clash"))
    rows = langid.identify(df).withColumn("held_out", langid.held_out()).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == df.count()
    assert all(r["lang_pred"] == r["lang"] and not r["lang_rejected"] for r in rows if r["doc_id"] < 900)
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["lang_score"] == 0 and by_id[k]["lang_rejected"] for k in (900, 901, 902))
    assert by_id[903]["lang_pred"] == "en" and all(0 <= r["lang_score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    kept = langid.keep_identified(corpus(spark))
    assert kept.columns == corpus(spark).columns and kept.count() == 121


def test_held_out_labels_are_not_learned(spark):
    df = corpus(spark).withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(df).langs
    assert langid.identify(df.where("false"), langid.fit(df)).count() == 0
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    model = langid.fit(corpus(spark))
    langs, score, rejected = model.predict([prose("de", 30, 9), "ввв гггг дддд жжж ззз ииии"])
    assert list(rejected) == [False, True] and langs[0] == "de"
    a, b = model.predict([prose("en", 10, 1)] * 3)[1][:2]
    assert a == b and model.predict([prose("en", 10, 1)])[1][0] == pytest.approx(a)


def language(seed, n=60):
    """Words of an invented language in Latin letters: syllables of its own."""
    rng = np.random.default_rng(seed)
    syllables = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 1 + k % 2)) + rng.choice(list("aeiouyäéø")) for k in range(14)]
    return ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]


def test_unlearned_languages_are_rejected():
    vocabulary = {f"l{k}": language(k) for k in range(5)}
    rng = np.random.default_rng(7)
    text = lambda g: " ".join(rng.choice(vocabulary[g], rng.integers(8, 120)))
    learned = ["l0", "l1", "l2"]
    labels = learned * 60
    model = langid.train([text(g) for g in labels], labels)
    own = model.predict([text(g) for g in labels])
    assert np.mean(np.array(own[0]) == np.array(labels)) > 0.99 and own[2].mean() < 0.02
    assert model.predict([text("l3") for _ in range(60)])[2].mean() > 0.9 and model.predict([text("l4") for _ in range(60)])[2].mean() > 0.9
    for t in [text("l0"), text("l4"), "ab", "", None, "É 1 é", "word " * 3000]:
        lang, score, rejected = langid.brute_force(t, model)
        a, b, c = model.predict([t or ""])
        assert (a[0], bool(c[0])) == (lang, rejected) and b[0] == pytest.approx(score, abs=1e-4)


def test_samples_are_bounded(spark):
    df = spark.createDataFrame([(None if k % 3 else 7, prose("de", 20, k), "de") for k in range(300)] + [(9, "x" * 200_000, "en")], "doc_id long, text string, lang string")
    model = langid.fit(df, sample_per_lang=20)
    assert set(model.langs) <= {"de", "en"} and langid.identify(df, model).count() == 301


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in langid.identify(docs).where(langid.held_out() & F.col("lang").isNotNull()).collect() if r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95 and np.mean([r["lang_rejected"] for r in rows]) <= 0.03


# --- chats ------------------------------------------------------------------------------------------------------------


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd: role#", ""]), st.text("\\#<>:/turnAs \n é", max_size=12)), min_size=1, max_size=5))
def test_chats_come_back(spark, turns):
    df = chats(spark, [(1, k, r, t, "clash") for k, (r, t) in enumerate(turns)])
    out = chat_format.format_chats(df)
    back = chat_format.read_back(out).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == turns
    assert list(back["learned"]) == [t for r, t in turns if r == "assistant"]
    row = out.first()
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]


def test_turn_order(spark):
    orders = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["user"], 4: ["assistant"], 5: ["user", "user", "assistant"], 6: ["user", "nobody"], 7: ["user", "assistant", "system"]}
    df = chats(spark, [(c, k, r, "x", None) for c, rs in orders.items() for k, r in enumerate(rs)])
    got = {r["conv_id"]: (r["valid"], r["state"]) for r in chat_format.format_chats(df).collect()}
    assert got == {1: (True, "assistant"), 2: (True, "assistant"), 3: (False, "user"), 4: (False, "error"), 5: (False, "error"), 6: (False, "error"), 7: (False, "error")}


def test_chat_digest_and_nulls(spark):
    df = chats(spark, [(1, 1, "assistant", None, None), (1, 0, "user", "hi", None), (None, None, None, None, None), (2, 0, "user", "b", None), (2, 0, "user", "a", None)])
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(chat_format.with_probe(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nhi\nassistant\n\n") and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == sha("user\na\nuser\nb\n") and got[None]["turns_sha256"] == sha("\n\n")
    p = chat_format.PROBE_TEXT
    assert got[-7]["turns_sha256"] == sha(f"user\n{p}\nassistant\n{p}\n") and got[-7]["loss_sha256"] == sha(p) and got[-7]["loss_chars"] == len(p)
    assert chat_format.format_chats(df.where("false")).count() == 0
    plan = chat_format.digest(chat_format.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "user>assistant" in plan.split("== Physical Plan ==")[1]  # the machine's table is in what runs


def test_flags_come_from_states(spark):
    n = 700  # several blocks of states
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k}.", None) for k in range(n)] + [(2, k, r, r, None) for k, r in enumerate(["user", "user", "assistant", "x:", "assistant"])]
    df = chats(spark, rows)
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert (got[1]["state"], got[1]["valid"], got[2]["state"]) == ("assistant", True, "error")
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == [f"t{k}." for k in range(1, n, 2)]
    assert [s["loss"] for s in got[2]["segments"][1::3]] == [0, 0, 1, 0, 1]
    mute = chat_format.ChatTemplate(learned=("user",), closing="|.*[\\E\n", escapes=(("\\", "\\b"), ("#", "\\h"), ("|", "\\p"), (":", "\\c")))
    out = chat_format.format_chats(df, mute)
    back = {r["conv_id"]: r for r in chat_format.read_back(out, mute).collect()}
    assert list(back[2]["learned"]) == ["user", "user"] and [t["role"] for t in back[2]["turns"]] == ["user", "user", "assistant", "x:", "assistant"]


# --- shards -----------------------------------------------------------------------------------------------------------

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't İstanbul ǅ é́x \x1c a\x1cb ﬁ <|endoftext|>x ... hello.it's 中文, ÀB c 12x x12 ①", None, "", " \n ", "Straße STRASSE ΑΣ Ας", "a" * 5000, "x.,; (y) |z| it's I'll \u0301abc", "word " * 30000]


def test_shards(spark):
    tokenizer = Tokenizer.from_file(BPE)
    texts = {k * 3 + 1: t for k, t in enumerate([*ODD, *[prose("de", 40, k) for k in range(300)]])}
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in texts.items()], "doc_id long, text string, start int, part int, path string").repartition(5)
    rows = token_output.round_trip(df, BPE).orderBy("start").collect()
    at = 0
    for r, k in zip(rows, sorted(texts), strict=True):
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), k
        at += len(ids)


def test_shards_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "n"), (2, "b"), (2, "a"), (1, "one")], "doc_id long, text string")
    rows = token_output.round_trip(df, BPE).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2]
    assert token_output.round_trip(df.where("false"), BPE).count() == 0


def test_other_tokenizers_get_whole_texts(tmp_path):
    facts = json.loads(Tokenizer.from_file(BPE).to_str())
    facts["pre_tokenizer"], facts["normalizer"] = None, None
    (tmp_path / "t.json").write_text(json.dumps(facts))
    encoder = token_output.WordEncoder(str(tmp_path / "t.json"), 2)
    text = "one  two Three\n\n four five, six"
    assert not encoder.by_word and token_output.encoder(BPE, 2).by_word
    assert encoder.encode([text.encode()]) == [np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]


def test_small_tables_have_a_dictionary_too(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert len(token_output.train_dictionary(df, BPE, 2)) >= 6 and len(token_output.train_dictionary(df.where("false"), BPE, 2)) == 512
    long = spark.createDataFrame([(1, "word " * 100_000)], "doc_id long, text string")
    assert 0 < len(token_output.train_dictionary(long, BPE, 2)) <= 1 << 16


def test_one_document_is_read_alone(tmp_path):
    import pyarrow.fs as pafs

    writer = token_output.ShardWriter(f"file://{tmp_path}", b"", 2)
    for k in range(50):
        writer.add(k, np.arange(k, dtype="<u2").tobytes())
    path, n_docs, n_ids = writer.close()
    assert (n_docs, n_ids) == (50, sum(range(50)))
    reader = token_output.ShardReader(pafs.LocalFileSystem(), path, b"")
    assert reader.read(7).tolist() == list(range(7)) and reader.doc_ids.tolist() == list(range(50))
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.ShardReader(pafs.LocalFileSystem(), path, b"other")
    (tmp_path / "broken.fxt").write_bytes(b"x" * 200)
    with pytest.raises(ValueError, match="no complete shard"):
        token_output.ShardReader(pafs.LocalFileSystem(), str(tmp_path / "broken.fxt"), b"")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_words_are_encoded_as_texts_are(texts):
    encoder = token_output.encoder(BPE, 2)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode([t.encode() for t in texts]) == want


# --- leaks ------------------------------------------------------------------------------------------------------------

ITEMS = {1: "What is the capital of the small island that lies east of the old harbour? It is called Northgate by everyone.", 2: "Name three rivers which cross the great plain. They are Alder, Birch and Cedar.", 3: "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", 4: "tiny", 5: None, 6: ""}


def leaky(k):
    return prose("en", 300, k) + " " + ITEMS[k] + " " + prose("en", 200, k + 50)


def test_leaks(spark):
    texts = {10: leaky(1), 11: leaky(2).upper(), 12: prose("en", 500, 7), 13: None, 14: "", 15: leaky(3), 16: ITEMS[1].replace("small", "tiny"), 17: "What is the capital of the small island that lies east of the old harbour?", 18: "Northgate by everyone. It is called", 19: leaky(1) + leaky(2)}
    df = spark.createDataFrame([(k, t, 1, 0.5) for k, t in texts.items()], "doc_id long, text string, item_id int, score double")
    bench = spark.createDataFrame([(k, t, 7) for k, t in ITEMS.items()], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == decontaminate.brute_force(texts, {k: t for k, t in ITEMS.items() if t})
    assert {(10, 1), (11, 2), (15, 3), (19, 1), (19, 2)} <= got and not {d for d, _ in got} & {12, 13, 14, 17, 18}
    clean = decontaminate.drop_leaks(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in got} and clean.columns == df.columns
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0 and decontaminate.drop_leaks(df, bench.where("false")).count() == len(texts)
    assert decontaminate.find_leaks(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("bound", ["ITEMS_PER_INDEX", "WORDS_PER_INDEX"])
def test_slices_find_what_one_index_finds(spark, monkeypatch, bound):
    texts = {k: leaky(1 + k % 3) if k % 4 else prose("en", 60, k) + " " + " ".join(ITEMS[2].split()[: 10 + k]) for k in range(1, 13)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = {**{k: t for k, t in ITEMS.items() if t}, **{k: prose("en", 20, k) for k in range(50, 60)}}
    bench = spark.createDataFrame([*items.items(), (None, "no id"), (99, None)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.find_leaks(df, bench, threshold=0.2, overlap=0.3).collect()))
    kept = {r[0] for r in decontaminate.drop_leaks(df, bench).collect()}
    monkeypatch.setattr(decontaminate, bound, 3 if bound == "ITEMS_PER_INDEX" else 40)
    several = sorted(map(tuple, decontaminate.find_leaks(df, bench, threshold=0.2, overlap=0.3).collect()))
    assert len(one) > 5 and [r[:2] for r in several] == [r[:2] for r in one] and np.allclose([r[2:] for r in several], [r[2:] for r in one])
    assert {r[0] for r in decontaminate.drop_leaks(df, bench).collect()} == kept


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghij"), min_size=1, max_size=8), min_size=1, max_size=90), st.sets(st.sampled_from("abcdefghijk"), min_size=1), st.sampled_from([0.2, 0.5, 0.8]))
def test_wand_finds_what_scoring_everything_finds(items, passage, threshold):
    index = decontaminate.BlockMaxIndex([(k, " ".join(t)) for k, t in enumerate(items)])
    terms = [index.vocabulary[w.encode()] for w in passage if w.encode() in index.vocabulary]
    scores: dict[int, float] = {}
    for t in terms:
        for item, x in index.postings[t]:
            scores[item] = scores.get(item, 0) + x
    want = {i for i, s in scores.items() if s >= threshold - 1e-9}
    assert {i for i, _ in index.search(terms, threshold)} == want


# --- token counts -----------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces, byte_score = token_counts.load_pieces(model)
    texts = {k: t for k, t in enumerate([*ODD[:6], "wordword wording words", prose("es", 200, 3), "中" * 20, None])}
    df = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(df, model).collect()}
    assert got == {k: (len((t or "").encode().split()), token_counts.brute_force(t or "", pieces, byte_score)) for k, t in texts.items()}
    assert token_counts.count_tokens(df.where("false"), model).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=6))
def test_trie_agrees_with_plain_dynamic_programming(words):
    pieces = {"▁": -5.0, "▁a": -1.0, "a": -2.0, "b": -2.0, "ab": -3.0, "abc": -3.5, "bca": -2.5, "▁ab": -3.0}
    text = " ".join(words)
    for options in ({"max_nodes": 8}, {"depth": 3}, {"depth": 1, "max_nodes": 2}):
        trie = token_counts.PieceTrie(pieces, -20.0, **options)
        for _ in range(2):
            assert trie.totals([text.encode()])[1] == [token_counts.brute_force(text, pieces, -20.0)]


def test_a_very_long_word_takes_few_nodes():
    pieces = {"▁": -5.0, "a": -2.0, "ab": -3.0, "ba": -2.9, "bab": -3.1}
    trie = token_counts.PieceTrie(pieces, -20.0, max_nodes=1000)
    word = "ab" * 100_000 + "x"
    assert trie.totals([word.encode()])[1] == [token_counts.brute_force(word[:2001] + "x", pieces, -20.0) - token_counts.brute_force(word[:2001], pieces, -20.0) + trie.totals([word[:-1].encode()])[1][0]]
    assert len(trie.score) < 600


# --- personal data ----------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text("a@.1-+ ()_é4", max_size=40))
def test_patterns(text):
    assert pii.pattern_spans(text) == pii.brute_force(text)


def test_pattern_examples():
    text = "mail a.b+c@x-y.example.com, ip 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111, tel +1 (017) 555-7713 or +12"
    spans = pii.pattern_spans(text)
    shown = {k: [text[a:b] for a, b in v] for k, v in spans.items()}
    assert shown == {"email": ["a.b+c@x-y.example.com"], "ip": ["10.0.0.255"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (017) 555-7713"]}
    assert pii.pattern_spans("a@b.c%d@e.f")["email"] == [(0, 5), (5, 11)] == pii.brute_force("a@b.c%d@e.f")["email"]
    for slow in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "@" * 100_000):
        pii.pattern_spans(slow)


def test_field(spark):
    texts = {1: "Yesterday Mr. Novak came. My name is Anna Keller and I like it.", 2: "SSN: 123-45-6789 is on file", 3: prose("de", 50, 2), 4: None, 5: "", 6: "x@y.zz " * 3000 + "ask Dr. Weber, please"}
    texts |= {7: 'und token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" der', 8: "password=maple!84Q", 9: "the token was lost in the garden. The key = 5", 10: "a1" * 100_000, 11: "api_key: " + "Zq9" * 12}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(None, texts[2], "x")], "doc_id long, text string, kind string")
    rows = pii.find_spans(df).collect()
    got = {r["doc_id"]: [(s["kind"], (texts[r["doc_id"]] or "")[s["start"] : s["end"]]) for s in r["spans"]] for r in rows if r["doc_id"]}
    assert ("name", "Novak") in got[1] and ("name", "Anna Keller") in got[1] and got[2] == [("id_number", "123-45-6789")] and got[3] == got[4] == got[5] == got[9] == got[10] == []
    assert got[6][:3000] == [("email", "x@y.zz")] * 3000 and got[6][3000:] == [("name", "Weber")]
    assert got[7] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")] and got[8] == [("secret", "maple!84Q")] and got[11] == [("secret", "Zq9" * 12)]
    assert len(rows) == len(texts) + 1
    row = {r["doc_id"]: r for r in pii.digest(pii.find_spans(df)).collect()}[2]
    assert (row["n_email"], row["n_card"], row["spans"], row["n_id_number"], row["n_spans"]) == (0, 0, "id_number:5:16", 1, 1) and row["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_spans(df.where("false")).count() == 0


def test_field_on_held_out_rows():
    """Precision and recall of each added kind on sentences with values that the field was not trained on."""
    field = pii.train()
    right, found, wanted = Counter(), Counter(), Counter()
    for words, labels in pii.labelled_table(seed=77, times=10):
        at = np.cumsum([0, *[len(w) + 1 for w in words]])
        want = set()
        for k, y in enumerate(labels):
            if y.startswith("B-"):
                end = next((e for e in range(k + 1, len(labels)) if labels[e] != f"I-{y[2:]}"), len(labels))
                want.add((y[2:], at[k] + pii.core(words[k])[1], at[end - 1] + pii.core(words[end - 1])[2]))
        got = set(field.spans([" ".join(words)])[0])
        for into, spans in ((right, want & got), (found, got), (wanted, want)):
            into.update(s[0] for s in spans)
    for kind in pii.ADDED:
        assert right[kind] / wanted[kind] >= 0.9 and right[kind] / found[kind] >= 0.95, kind


def test_field_on_the_tables(spark):
    """It finds the secrets in the documents, and next to nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] in pii.ADDED] for r in pii.find_spans(spark.createDataFrame(docs)).join(spark.createDataFrame(docs), "doc_id").collect()}
    secret = {r["doc_id"]: re.findall(r'token = "([0-9a-f]{40})"', r["text"] or "") for r in docs}
    assert sum(map(len, secret.values())) > 0
    assert sum(x in found[k] for k, xs in secret.items() for x in xs) >= 0.9 * sum(map(len, secret.values()))
    assert sum(len(v) for k, v in found.items() if not secret[k]) <= 0.01 * len(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aBé\u01c5\u00aa1.,!=\"-", min_size=1, max_size=9).filter(lambda w: len(w.split()) == 1 and w.split()[0] == w) | st.sampled_from(["token", "Token", "Mr.", "is,", "name"]), min_size=1, max_size=8))
def test_plain_words_score_as_any_other(words):
    trained = pii.train()
    field = pii.Field(trained.weights, trained.moves, trained.margin)
    ids = field.index(words)
    rows, ends = field.score(words)
    assert np.allclose(field.rows[ids], rows) and (field.ends[ids] == ends).all()


def test_decoding_is_the_best_path():
    field = pii.train()
    rng = np.random.default_rng(4)
    words = "Mr. Smith Dr. the SSN: 123-45-6789 name is Anna Keller. He".split()
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(60)]
    ids = field.index([w for t in texts for w in t.split()])
    lengths = np.array([len(t.split()) for t in texts])
    first = np.zeros(len(ids) + 1, bool)
    first[1:] = field.ends[ids]
    first[np.cumsum(lengths) - lengths] = True
    first = first[:-1]
    e = field.emissions(ids, first)
    labels = field.decode(e, first)
    heads = np.flatnonzero(first)
    import itertools

    for a, b in zip(heads, np.append(heads[1:], len(e))):
        score = lambda p: sum(e[a + k, y] for k, y in enumerate(p)) + sum(field.moves[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(score(p) for p in itertools.product(range(len(pii.LABELS)), repeat=int(b - a)))
        assert score(labels[a:b].tolist()) == pytest.approx(best)


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rows = [(k, prose("en", 3 + k % 30, k), "en", f"s{k % 5}" if k % 5 else "big", 0) for k in range(400)]
    rows += [(1000 + k, prose("en", 50, k), "en", "big", 0) for k in range(200)] + [(2000, "only one", "en", None, 8), (2001, None, "en", "s1", 0), (2002, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("x")).withColumn("goal", F.lit(1))
    plan = mixing.plan_mix(df)
    got = [r.asDict() for r in plan.selectExpr("row.source as source", "*").collect()]
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    for source, (size, target) in targets.items():
        own = [r for r in got if r["source"] == source]
        assert size == sum(r["size"] for r in own) and target <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in own) - target) <= 0.5
        assert all(0 <= r["taken"] <= 2 * r["size"] and sum(c["words"] for c in r["copies"]) == r["taken"] for r in own)
        assert all(0 <= c["position"] <= 1 for r in own for c in r["copies"])
    names = sorted((s for s in targets if s is not None)) + [None]
    free = [t / (3, 1, 2)[k % 3] for k, s in enumerate(names) for z, t in [targets[s]] if t < 2 * z - 1e-9]
    assert max(free) == pytest.approx(min(free))  # those below their cap share by weight
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(len(r["copies"]) for r in got)
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    found = mixing.source_mix(df)
    rows = [tuple(r) for r in mixing.digest(found).orderBy("doc_id").collect()]
    assert rows == [tuple(r) for r in mixing.digest(mixing.source_mix(df.repartition(7))).orderBy("doc_id").collect()]
    copies = sorted((c["position"], r["doc_id"], c["epoch"]) for r in got for c in r["copies"])
    rank = {(d, e): k for k, (_, d, e) in enumerate(copies, 1)}
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, size, source_size, target, taken, n_copies, position, first in rows:
        r = by_id[doc_id]
        assert (size, source_size, taken, n_copies) == (r["size"], r["source_size"], r["taken"], len(r["copies"])) and first == rank.get((doc_id, 0), 0)
    order = [r["_at"] for r in mixing.mix(df, position="_at").collect()]
    assert order == sorted(order)
    assert mixing.plan_mix(df.where("false")).count() == 0 and mixing.source_mix(df.where("false")).count() == 0
    twice = mixing.source_mix(df.where("doc_id < 5").union(df.where("doc_id < 5")).union(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))))
    assert twice.count() == 11 and twice.select(F.sum("taken")).first()[0] == pytest.approx(1.5 * twice.select(F.sum("size")).first()[0], abs=3)


def test_positions_invert_the_demand(spark):
    df = spark.createDataFrame([(q / 20, a, b) for q in range(21) for a, b in mixing.SCHEDULES], "q double, a double, b double")
    for r in df.select("*", mixing.position(F.col("q"), F.col("a"), F.col("b")).alias("t")).collect():
        assert r["a"] * r["t"] + (r["b"] - r["a"]) * r["t"] ** 2 / 2 == pytest.approx(r["q"] * (r["a"] + r["b"]) / 2)
