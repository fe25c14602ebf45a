import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.llm import rules as R
from parlance.llm.catalog import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_are_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c d e", "a a a a a a a", "x\x0by\x0cz w v", "𝔘 ß # | <\n\n\x1c\n# |", "é " * 30000]
    for _ in range(150):
        vocab = rng.choice([["a", "b"], ["a", "b", "c", "d", "Ab", "#x", "é"], [str(i) for i in range(500)]])
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  ", "\t\n"]) for _ in range(rng.randint(0, 120))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in R.measured(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLUMNS) == brute(t), t


def tail(k, n, p):
    return sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    rows = [(0, 10), (3, 10), (10, 10), (5, 400), (40, 900)]
    df = spark.createDataFrame(rows, "k bigint, n bigint").select("k", "n", R.binomial_cdf(F.col("k"), F.col("n"), 0.05).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(tail(r["k"], r["n"], 0.05), rel=1e-9)


def labelled(spark, n=6000):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        noisy = rng.random() < (0.9 if bad else 0.004)
        words = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(30)]
        docs.append((i, " ".join(w + "###" if noisy else w for w in words), "en" if i % 3 else "fr"))
        labels.append((i, int(not bad)))
    docs += [(n, " ".join(f"w{j}###" for j in range(20)), None), (n + 1, " ".join(f"w{j}###" for j in range(20)), "xx")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int"))


def test_cutoffs_are_the_brute_force_ones_and_keep_their_promise(spark):
    docs, labels = labelled(spark)
    stats = R.measured(docs, strata=["lang"]).cache()
    got = {(r["stratum"][0], r["ratio"]): r["cutoff"] for r in R.cutoffs(stats, labels).collect()}
    rows = stats.join(labels.filter("quality = 1"), "doc_id").filter("not base_failed").collect()
    want = {}
    for lang in ("en", "fr"):
        for ratio in R.RATIOS:
            values = [r[ratio] for r in rows if r["stratum"][0] == lang]
            for i in range(R.STEPS + 1):
                cut = 1 - i / R.STEPS
                k = sum(v > cut + 1e-9 for v in values)
                if not tail(k, len(values), R.ALPHA / 4) <= R.DELTA / 8:
                    break
                want[lang, ratio] = cut
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    out = R.judge(docs, labels, strata=["lang"])
    assert out.count() == docs.count()
    bad = out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in bad}
    assert kept[1] > 0.95 and kept[0] < 0.2
    assert {r["kept"] for r in out.filter("doc_id >= 6000").collect()} == {True}  # strata without labels


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, "a b", 3), (None, "a b c d e f g h i j", 3)], "doc_id bigint, text string, kept int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id bigint, quality int")
    got = R.judge(docs, labels).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == [("1", False), ("1", False), ("None", True)]
    assert R.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_query_is_brute_force_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries()["op10_risk_controlled_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert tuple(got[d["doc_id"]][c] for c in COLUMNS) == brute(d["text"])
        assert not (got[d["doc_id"]]["base_failed"] and got[d["doc_id"]]["kept"])
