import random
import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import ensemble as E
from parlance.llm.catalog import queries


def test_statistics(spark):
    texts = ["", None, "a a b!\nA1 | #\n\na a b!", "x " * 40000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", E.statistics(F.col("text")).alias("s")).collect()}
    assert got[0] == got[1] and set(got[0]) == {0.0, got[0]["line_words"]}
    s = got[2]
    assert (s["distinct"], s["same_as_before"], s["dup_lines"]) == (5 / 9, 2 / 9, 1 / 3)
    assert (s["pipes"], s["upper"], s["digits"], s["exclamations"], s["symbols"]) == (1 / 12, 1 / 12, 1 / 12, 2 / 12, 2 / 12)
    assert got[3]["same_as_before"] == 39999 / 40000


def examples(spark, n=1500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [rng.choice(["the", "of", "and"]) + str(rng.randint(0, 9)) * rng.randint(0, 3) for _ in range(rng.randint(5, 60))]
        kind = rng.randint(0, 1)
        rows.append((i, " ".join((w + "###" if kind else w.upper() + "!!") if bad else w for w in words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int")


def test_compiled_score_is_the_rules_by_hand(spark):
    table = examples(spark).select(E.statistics(F.col("text")).alias("stats"), F.col("quality").cast("double").alias("label")).cache()
    e = E.fit(table, trees=6)
    assert 0 < len(e.rules) < 80 and all(str(r) for r in e.rules)
    import math
    for r in table.select("stats", "label", e.score().alias("score")).limit(200).collect():
        total = e.bias + sum(x.weight for x in e.rules if all(
            (r["stats"][n] > t) if above else (r["stats"][n] <= t) for n, above, t in x.conditions))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
        assert (r["score"] >= 0.3) == bool(r["label"])


def test_labels_of_held_out_rows_and_ids_change_nothing(spark):
    data = examples(spark)
    labels = data.select("doc_id", "quality")
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = data.select("doc_id", "text")
    assert E.learn(docs, labels, trees=4) == E.learn(docs, turned, trees=4)
    assert len(E.learn(docs, labels, trees=4, sample_rows=20).rules) >= 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "a", 1), (None, "b c", 1)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([(None, 1), (7, None), (1, 5)], "doc_id bigint, quality int")
    kept = E.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    assert {r["score"] for r in E.scored(docs, E.learn(docs, none)).select("score").collect()} == {0.5}
    assert E.keep_good(docs.limit(0), none.limit(0)).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op4_sparse_rule_ensemble"](spark, sf)
    assert got.select("doc_id").distinct().count() == got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = lambda q: sum(r["predicted"] == q for r in rows if r["quality"] == q) / sum(r["quality"] == q for r in rows)
    print("held out:", len(rows), right(0), right(1))
    assert right(1) > 0.97 and right(0) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
