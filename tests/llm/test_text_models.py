"""Toxicity, language and BPE."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import bpe, langid, toxicity
from lodestrata.llm import queries as Q

TESTDATA = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in Q.op3_toxicity(spark, TESTDATA).collect()}
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet").collect()
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in got.values())
    y = np.array([x.toxic for x in labels if held_out(x.doc_id)])
    s = np.array([got[x.doc_id].score for x in labels if held_out(x.doc_id)])
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert pairs > 0.9 and (s[y == 1] >= 0.7).mean() > 0.75 and (s[y == 0] >= 0.7).mean() < 0.1


def test_toxicity_of_weak_marks():
    """Sixty marks, three a text, each too rare to stand out much on its own."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    marks = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(60)]

    def text(label):
        own = [rng.choice(words) for _ in range(80)]
        for _ in range(3 * label):
            own[rng.randrange(80)] = rng.choice(marks)
        return " ".join(own)

    y = [i % 2 for i in range(600)]
    model = toxicity.train([text(k) for k in y], y)
    s = np.array([model.scores([text(k) for _ in range(200)]) for k in (0, 1)])
    assert (s[1] >= 0.7).mean() > 0.9 and (s[0] >= 0.7).mean() < 0.02


def toxic_model():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(80)]
        if i % 2:
            for _ in range(5):
                t[rng.randrange(80)] = rng.choice(["vilename", "nastyword", "badinsult"])
        texts.append(" ".join(t))
        labels.append(i % 2)
    return toxicity.train(texts, labels), texts, labels


def test_toxicity_edges(spark):
    model, texts, labels = toxic_model()
    s = model.scores(texts)
    assert ((s >= 0.7) == np.array(labels)).mean() > 0.95
    rows = [(1, None, "a"), (2, "", None), (3, texts[1], "x"), (3, texts[1], "x"), (None, texts[0], ""), (5, (texts[0] + " ") * 3000, "y"), (6, "vilename", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = df.withColumn("s", toxicity.score(model, F.col("text"))).collect()
    assert len(got) == 7 and got[0].s == got[1].s < 0.5 and got[2].s == got[3].s >= 0.7 and got[2].score == "x"
    assert df.limit(0).select(toxicity.score(model, F.col("text"))).collect() == []
    with pytest.raises(ValueError, match="both kinds"):
        toxicity.train(["a"], [1])
    assert b"".join(toxicity.windows(b"ab cd " * 999, 96)) == b"ab cd " * 999


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in Q.op8_language(spark, TESTDATA).collect()}
    docs = [r for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect() if held_out(r.doc_id)]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in docs]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in got.values())


def test_language_edges(spark):
    model = langid.train({"en": ["the cat and the dog ran over the hill with them", "the hill and the cat"], "de": ["der hund und die katze liefen über den hügel mit ihnen", "die katze und der hund"]})
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the cat and the dog ran over the hill and the cat ran with them"), (5, "die katze und der hund liefen über den hügel und die katze"), (5, "die katze und der hund liefen über den hügel und die katze"), (6, "the dog " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = df.withColumn("r", langid.identify(model, F.col("text"))).collect()
    assert [r.r.lang for r in got] == ["und", "und", "und", "en", "de", "de", "en"]
    assert [r.r.rejected for r in got[:3]] == [True] * 3 and got[0].r.score == 0
    assert df.limit(0).select(langid.identify(model, F.col("text"))).collect() == []
    with pytest.raises(ValueError):
        langid.train({})
    same = langid.LanguageModel({"b": b"abc" * 9, "a": b"abc" * 9})
    assert same.predict("xyz")[0] == "b" and same.predict("xyz")[3]


PATH = Q.tokenizer_file()
LIBRARY, OWN = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False)
    data, back = OWN.encode(text)
    assert bpe._ids(data) == want.ids
    assert back == LIBRARY.decode(want.ids, skip_special_tokens=False) == OWN.decode(want.ids)


@pytest.mark.parametrize(
    "text",
    ["", "  ", "Σας ΣΑΣ İstanbul áb", "x<|endoftext|>y <|startoftext|>  it's I'LL <|endof", "a" * 3000 + "b" * 300, "\x1c\x1d\x85\xa0  tab\tq", "日本語 テスト 123 ½ ²", "👍🏽 é́ <| |>", "ﬁ ŉ ſ K", "​﻿ zero", "the" * 400, "x\x00y", "<|endoftext|>" * 3],
)
def test_bpe_equals_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_bpe_equals_the_library_on_any_text(text):
    check(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="etaoin", min_size=2, max_size=400))
def test_long_and_short_words_merge_alike(word):
    parts = [OWN.vocab[OWN.letters[ord(c)]] for c in word[:-1]] + [OWN.vocab[word[-1] + OWN.end]]
    assert OWN.merge_short(list(parts)) == OWN.merge_long(list(parts))


def test_bpe_query(spark, sf_dir):
    got = {r.doc_id: r for r in Q.op9_bpe(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 4), (3, "Hello hello", 5), (3, "Hello hello", 5)], "doc_id long, text string, ids int")
    got = df.withColumn("e", bpe.encode(PATH, F.col("text"))).withColumn("d", bpe.decode(PATH, F.col("e"))).collect()
    assert got[0].e == [] == got[1].e and got[0].d == "" and got[2].d == got[3].d == "hello</w> hello</w>"
    assert df.limit(0).select(bpe.digests(PATH, F.col("text"))).collect() == []
    assert spark.sql("select cast(null as array<int>) ids").select(bpe.decode(PATH, F.col("ids"))).first()[0] == ""
