import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import language as L
from parlance.llm.catalog import queries

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["schr", "ung", "ei"], "cc": ["é", "oux", "tion"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(lang, say(rng, lang, 40)) for lang in SYLLABLES for _ in range(60)] + [(None, "x y"), ("aa", None)]
    return L.learn(spark.createDataFrame(rows, "lang string, text string"))


def test_mixtures_and_odd_rows(spark, model):
    assert model.languages == ("aa", "bb", "cc")
    rng = random.Random(2)
    texts = [say(rng, "aa", 30), say(rng, "bb", 1), say(rng, "cc", 50) + " " + say(rng, "aa", 25), None, "", "12 !? \n", "Ⅷ €", "日本",
             say(rng, "bb", 30000), say(rng, "aa", 30), say(rng, "aa", 30)]
    df = spark.createDataFrame([(i if i < 10 else None, t, "zz") for i, t in enumerate(texts)], "doc_id int, text string, lang_pred string")
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    assert len(got) == 11
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 8, None)] == ["aa", "bb", "cc", "bb", "aa"]
    assert [x["lang"] for x in got[2]["languages"]] == ["cc", "aa"] and abs(got[2]["score"] - 2 / 3) < 0.05
    assert [len(got[i]["languages"]) for i in (0, 1, 8)] == [1, 1, 1]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert got[7]["lang_pred"] in model.languages and all(0 <= r["score"] <= 1 for r in got.values())
    assert L.identify(df.limit(0), model).count() == 0


def test_em_is_the_slow_one(model):
    rng = random.Random(3)
    texts = [say(rng, "aa", 9) + " " + say(rng, "bb", 12), say(rng, "cc", 7)]
    words = [L._word_likelihoods(t.encode(), model.table) for t in texts]
    assert [len(w) for w in words] == [21, 7]
    for w in words:
        p = np.exp(w - w.max(1, keepdims=True))
        share = np.full(3, 1 / 3)
        for _ in range(L.ROUNDS):
            new = np.zeros(3)
            for row in p:
                new += row * share / (row * share).sum()
            share = new / len(p)
        sizes = np.array([len(x) for x in words])
        got, _ = L._mixture(np.concatenate([np.exp(x - x.max(1, keepdims=True)) for x in words]), np.cumsum(sizes) - sizes, sizes, np.full((2, 3), 1 / 3))
        assert any(np.allclose(g, share) for g in got)


def test_long_texts_in_runs(model, monkeypatch):
    text = (say(random.Random(4), "aa", 500) + " , " + "日本" * 40).encode()
    whole = L._word_likelihoods(text, model.table)
    assert len(whole) == 501
    for run in (1, 7, 30):
        monkeypatch.setattr(L, "RUN", run)
        assert np.allclose(L._word_likelihoods(text, model.table), whole)


@pytest.mark.parametrize("keep", [0, 1 << 25])
def test_a_long_text_gets_the_em_of_all_its_words(model, monkeypatch, keep):
    monkeypatch.setattr(L, "KEEP", keep)
    rng = random.Random(5)
    texts = [say(rng, "aa", 300), " ".join(say(rng, lang, 1) for lang in ("aa", "bb") * 200),
             say(rng, "cc", 200) + "\n" + say(rng, "bb", 90) + " " + say(rng, "aa", 60), "é" * 5000, "x", "12"]
    short = L.infer([L._word_likelihoods(t.encode(), model.table) for t in texts])
    assert [len(c) for c in short[:3]] == [1, 2, 3]
    for text, want in zip(texts, short):
        for run in (64, 1000):
            got = L.infer_long(text.encode(), model.table, run)
            assert [i for i, _ in got] == [i for i, _ in want]
            assert np.allclose([s for _, s in got], [s for _, s in want])


def test_more_words_than_a_run_tells_apart(model):
    """Alternating languages in over 2^20 words: neighbours must not be taken together."""
    text = ("kato ungei " * (1 << 19) + "kato").encode()
    got = L.infer_long(text, model.table, L.run_bytes(3))
    assert sorted(model.languages[i] for i, _ in got) == ["aa", "bb"]
    assert all(abs(s - 0.5) < 0.01 for _, s in got)


def test_150_languages_are_all_learned(spark):
    """Rare ones too, in bounded memory: a text of 400,000 words takes less than 400 MB beside it."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:03}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for i in range(150)}
    speak = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(lang, speak(lang, 60)) for i, lang in enumerate(own) for _ in range(2 if i % 3 else 6)]
    model = L.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == tuple(own)
    asked = spark.createDataFrame([(i, speak(lang, 30)) for i, lang in enumerate(own)], "doc_id int, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(asked, model).collect()}
    assert [got[i] for i in range(150)] == list(own)
    long = (speak("l001", 300_000) + " " + speak("l149", 100_000)).encode()
    tracemalloc.start()
    found = L.infer_long(long, model.table, L.run_bytes(150))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [model.languages[i] for i, _ in found] == ["l001", "l149"] and abs(found[0][1] - 0.75) < 0.01
    print("peak MB:", peak >> 20)
    assert peak < 400 << 20


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        L.learn(spark.createDataFrame([(x, "ab cd") for x in "abc"], "lang string, text string"))


def test_no_labels(spark):
    none = spark.createDataFrame([(1, "a b", None)], "doc_id int, text string, lang string")
    assert [r["lang_pred"] for r in L.identify(none, L.learn(none)).collect()] == ["und"]


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries()["op7_language_mixture"](spark, sf)
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    right = sum(r["lang"] == r["lang_pred"] for r in held) / len(held)
    print("held out:", len(held), right)
    assert right > 0.97
