import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import winnow as W
from parlance.llm.catalog import oracle_sql, queries
from tests_llm_sql import rows, sql_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, span=13):
    out = []
    for text in docs:
        w = words(text)
        hit, found = set(), set()
        for key, item in items:
            v = words(item)
            k = min(span, len(v))
            grams = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i:i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add(str(key) if key is not None else "")
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def random_case(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "Ab", "é", "x1", "straße"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--", "[`~"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 8, 12, 13, 14, 40]))) for i in range(12)]
    items += [(50, items[5][1]), (51, items[-1][1] + " b"), (7, say(20)), (None, say(15)), (60, None), (61, " ,, ")]
    docs = ["", None, "...", "a" * 3000]
    for _ in range(40):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split(" ")
            i = rng.randint(0, len(part))
            parts += [" ".join(part[i:i + rng.randint(0, 30)]), say(rng.randint(0, 5))]
        docs.append(" ".join(parts))
    return docs + docs[-2:], items


@pytest.mark.parametrize("index_words,run", [(1_000_000, 1 << 20), (60, 1 << 20), (20, 64)])
def test_spans_and_items_are_those_of_brute_force(spark, monkeypatch, index_words, run):
    monkeypatch.setattr(W, "RUN", run)
    texts, items = random_case(index_words)
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id int, text string, found string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r["doc"]["doc_id"]: r["found"] for r in W.shared_spans(docs, bench, index_words=index_words).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items)):
        assert got[i]["n_words"] == n
        assert [p for s in got[i]["spans"] for p in range(s["start"], s["end"])] == hit, texts[i]
        assert got[i]["items"] == found


@pytest.mark.parametrize("rows", [1 << 18, 5])
def test_repeated_words_are_those_of_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(W, "ROWS", rows)
    rng = random.Random(9)
    items = [(1, "x " * 50), (2, "a b " * 20), (3, "a b c " * 9), (4, " ".join(rng.choice("ab") for _ in range(200))),
             (5, "x x x"), (6, "y " * 12), (7, "x " * 13), (8, "X " * 50)]
    texts = ["x " * 300, "b a " * 60, "c " * 5 + "a b c " * 30 + "x x", " ".join(rng.choice("ab") for _ in range(400)),
             "x " * 12, "y " * 40, "x x y x x x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc"]["doc_id"]: r["found"] for r in W.shared_spans(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items)):
        assert (got[i]["n_words"], got[i]["items"]) == (n, found)
        assert [p for s in got[i]["spans"] for p in range(s["start"], s["end"])] == hit


def test_repeated_words_cost_no_more_than_others():
    """An item of 5,000 equal words in a document of 1,000,000."""
    index = W.build_index([("1", "x " * 5000), ("2", "a b " * 2500)])
    shared = type("Shared", (), {"value": vars(index)})
    began = time.monotonic()
    tracemalloc.start()
    n, spans, items = W._search(shared)([b"x " * 1_000_000, b"b a " * 500_000, b"z"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("seconds:", time.monotonic() - began, "peak MB:", peak >> 20)
    assert n == [1_000_000, 1_000_000, 1] and [[e - s for s, e in x] for x in spans] == [[1_000_000], [1_000_000], []]
    assert items == [{"1"}, {"2"}, set()]
    assert time.monotonic() - began < 60 and peak < 500 << 20


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    """The bytes decide, not the hashes alone."""
    of = W.Words._of
    monkeypatch.setattr(W.Words, "_of", staticmethod(lambda part: (*of(part)[:2], np.minimum(of(part)[2], np.uint64(1)))))
    shared = type("Shared", (), {"value": vars(W.build_index([("1", "one " * 13)]))})
    n, spans, items = W._search(shared)([b"two " * 20, b"one " * 13 + b"six", b"ten " * 13])
    assert items == [set(), {"1"}, set()] and spans == [[], [(0, 13)], []]


def test_runs_cut_between_words(monkeypatch):
    texts = [t for t in random_case(3)[0] if t] + ["word" * 100 + " x"]
    whole = [W.Words(t.encode()) for t in texts]
    monkeypatch.setattr(W, "RUN", 7)
    for t, w in zip(texts, whole):
        v = W.Words(t.encode())
        assert v.starts.tolist() == w.starts.tolist() and v.hashes.tolist() == w.hashes.tolist()
        assert [x.decode() for x in v.text(0, len(v.starts))] == words(t)


def test_empty_tables_and_stage(spark):
    docs = spark.createDataFrame([(1, "one two", 5), (1, "one two", 5), (None, None, None)], "doc_id int, text string, doc int")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [r["found"]["items"] for r in W.shared_spans(docs, none).collect()] == [[], [], []]
    assert W.shared_spans(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(1, "Two")], "item_id int, text string")
    kept = W.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 1


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op2_winnowing_decontamination"](spark, sf)
    assert rows(got) == sql_rows(oracle_sql()["op2_winnowing_decontamination"], sf)
    assert got.filter("contaminated").count() > 0
