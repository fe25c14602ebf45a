import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import scoring as sc


def graph(spark, texts, kind="SYMPTOM"):
    return spark.createDataFrame([("r", t, kind) for t in texts], "res_id string, text string, type string")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similarity(metric, a, b):
    return 1 - levenshtein(a, b) / max(len(a), len(b))


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.97])
def test_fuzzy_pairs_lose_nothing(spark, threshold, metric="levenshtein"):
    rng = random.Random(3)
    words = {"".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(150)}
    words |= {w[:-1] + "z" for w in words} | {"x" + w for w in words} | {"the same long phrase", "the same lung phrase"}
    words |= {"".join(rng.choices("abcde", k=40)) for _ in range(4)}
    words |= {w[:9] + "q" + w[10:] for w in words if len(w) == 40} | {w[1:] for w in words if len(w) == 40}
    long = "".join(rng.choices("abcdefgh", k=1000))
    words |= {long, long[:400] + long[410:], long[5:] + "xyz"}
    left, right = sorted(words)[::2], sorted(words)[1::2]
    got = {(r.student_text, r.baseline_text) for r in
           sc.fuzzy_pairs(graph(spark, left), graph(spark, right), metric, threshold).collect()}
    want = {(a, b) for a in left for b in right if similarity(metric, a, b) >= threshold - 1e-12}
    assert got == want


def test_long_texts_add_rows_of_bounded_width(spark):
    """Texts of 20,000 characters meet by ids and numbers; only those of the pairs found are fetched."""
    rng = random.Random(7)
    a, b = ("".join(rng.choices("abcdefghij", k=20000)) for _ in range(2))
    near = a[:7000] + "xx" + a[7003:]
    s, base = graph(spark, [a, b]), graph(spark, [near, "c" * 20000])
    u = F.lit(False).alias("settled")
    rows = sc._windows(sc._numbered(sc._texts(s, []).select("*", u)), [], 0.8, 14)
    assert rows.columns == ["id", "n", "settled", "q", "seg", "at"] and rows.schema["seg"].dataType.simpleString() == "bigint"
    got = [(r.student_text, r.baseline_text) for r in sc.fuzzy_pairs(s, base).collect()]
    assert got == [(a, near)]


def test_fuzzy_pairs_within_keys(spark):
    s = spark.createDataFrame([("a", "cough"), ("b", "fever")], "res_id string, text string")
    b = spark.createDataFrame([("a", "coughs"), ("b", "cough"), ("b", "fevers")], "res_id string, text string")
    got = {tuple(r)[:3] for r in sc.fuzzy_pairs(s, b, "levenshtein", 0.8, ("res_id",)).collect()}
    assert got == {("a", "cough", "coughs"), ("b", "fever", "fevers")}


def test_overlap_is_directional(spark):
    s, b = graph(spark, ["Cough ", "coughs", "rash"]), graph(spark, ["cough", "headache"])
    r = sc.node_overlap(s, b, "levenshtein", 0.8).first()
    assert (r.matched_count, r.student_total, r.baseline_matched, r.baseline_total) == (2, 3, 1, 2)
    assert (r.precision, r.recall, r.f1) == (0.6667, 0.5, 0.5714)
    assert sc.node_jaccard(s, b).first().node_jaccard == 0.25


# Published reports: (Ns, Nb, population), (Es, Eb, relation), F1 and composite.
@pytest.mark.parametrize("ns,nb,population,es,eb,relation,f1,composite", [
    (275, 222, 0.8258, 320, 171, 1.0, 0.7799, 0.9014), (250, 222, 0.7508, 203, 171, 0.7914, 0.4788, 0.7552)])
def test_published_components(spark, ns, nb, population, es, eb, relation, f1, composite):
    assert sc.population_completeness(spark.range(ns), spark.range(nb)).first().population_completeness == population
    assert sc.relation_completeness(spark.range(es), spark.range(eb)).first().relation_completeness == relation
    assert abs((f1 + population + relation + 1.0) / 4 - composite) <= 1e-4


def test_published_type_similarity(spark):
    student = {"SYMPTOM": 96, "MEDICAL_HISTORY": 85, "TREATMENT": 41, "PROCEDURE": 18, "DIAGNOSIS": 15, "LOCATION": 15,
               "LAB_RESULT": 5}
    human = {"SYMPTOM": 73, "LOCATION": 10, "DIAGNOSIS": 17, "MEDICAL_HISTORY": 61, "TREATMENT": 43, "PROCEDURE": 16,
             "LAB_RESULT": 2}
    def rows(counts):
        return spark.createDataFrame([(t,) for t, n in counts.items() for _ in range(n)], "type string")
    assert sc.type_similarity(rows(student), rows(human)).first().type_similarity == 0.9917


def test_edge_jaccard_counts_repeats(spark):
    s = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b"), ("a", "R", "c")], "src_text string, type string, tgt_text string")
    b = spark.createDataFrame([("A ", "R", "b"), ("x", "R", "c")], "src_text string, type string, tgt_text string")
    r = sc.edge_jaccard(s, b).first()
    assert (r.common, r.student_edges, r.baseline_edges, r.edge_jaccard) == (1, 3, 2, 0.25)


def test_coverage_and_composite(spark):
    s = spark.createDataFrame([("r1", "cough", "A"), ("r2", "rash", "A")], "res_id string, text string, type string")
    b = spark.createDataFrame([("r1", "cough", "A"), ("r1", "fever", "A"), ("r2", "cough", "A")], "res_id string, text string, type string")
    cov = sc.per_patient_coverage(s, b)
    assert sorted(tuple(r) for r in cov.collect()) == [("r1", 0.5, 1, 1, 2), ("r2", 0.0, 0, 1, 1)]
    assert [r.res_id for r in sc.coverage_worst_k(cov, 1).collect()] == ["r2"]
    e = spark.createDataFrame([("x", "R", "y")], "src_text string, type string, tgt_text string")
    row = sc.composite_score((s, e), (b, e), "exact", 0.8, ["A"], ["R"]).first()
    assert (row.entity_f1, row.population, row.relation, row.schema) == (0.5, 0.6667, 0.6667, 1.0)
    assert row.composite == round((0.5 + 0.6667 * 2 + 1) / 4, 4)


def test_empty_sides(spark):
    none, some = graph(spark, ["x"]).filter(F.lit(False)), graph(spark, ["x"])
    r = sc.node_overlap(none, some).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_words_of_common_syllables_meet_by_deletions(spark):
    """Words of 15 to 19 characters (three edits) make no windows: their chunks of three characters meet nearly all others."""
    rng = random.Random(11)
    def word():
        return "".join(rng.choices(["cio", "ent", "aci", "men", "tra", "des"], k=6))[:rng.randint(12, 19)]
    words = {word() for _ in range(120)}
    for w in list(words):
        at = sorted(rng.sample(range(len(w)), 3))
        words |= {w[:at[0]] + w[at[0] + 1:at[1]] + "x" + w[at[1]:at[2]] + "y" + w[at[2] + 1:], w[1:], "zz" + w}
    left, right = sorted(words)[::2], sorted(words)[1::2]
    got = {(r.student_text, r.baseline_text) for r in sc.fuzzy_pairs(graph(spark, left), graph(spark, right)).collect()}
    assert got == {(a, b) for a in left for b in right if similarity("", a, b) >= 0.8 - 1e-12}
    texts = sc._numbered(sc._texts(graph(spark, [w for w in words if len(w) < 16]), []).withColumn("settled", F.lit(False)))
    assert sc._windows(texts, [], 0.8, sc._short_limit(0.8)).isEmpty()
    assert [sc._short_limit(t) for t in (0.8, 0.9, 0.95)] == [19, 29, 59]


def test_tasks_grow_with_the_rows_of_a_join(spark):
    few, many = (sc._dealt(spark.range(8), n * sc.TASK_ROWS, ["id"]).rdd.getNumPartitions() for n in (0.1, 50))
    assert few <= 8 and many == 50


def test_coverage_matches_no_null_key_and_flags_only_the_baseline(spark):
    rows = "res_id string, text string, type string"
    s = spark.createDataFrame([(None, "cough", "A"), ("r", "coughs", "A"), ("r", "rash", "A")], rows)
    b = spark.createDataFrame([(None, "cough", "A"), ("r", "cough", "A"), ("r", "rash", "A"), ("r", "fever", "A")], rows)
    assert {tuple(r) for r in sc.per_patient_coverage(s, b).collect()} == {(None, 0.0, 0, 0, 1), ("r", 0.6667, 2, 2, 3)}
    flags, _ = sc.matched_texts(s, b, "levenshtein", 0.8, ("res_id",), only_baseline=True)
    assert {r.matched for r in flags.collect()} == {None}


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.97])
def test_texts_of_small_and_large_keys_lose_no_pair(spark, threshold):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(120)} | {"x" * 99, "x" * 97, "x" * 100}
    words = sorted(words | {w[1:] + "z" for w in words})
    s, b = ([(k, w) for i, w in enumerate(words) for k in ("p", "q") if (k == "p" or i < 9) and i % 2 == side] for side in (0, 1))
    want = {(k, a, c) for k, a in s for j, c in b if j == k and similarity("", a, c) >= threshold - 1e-12}
    made = [spark.createDataFrame(rows, "res_id string, text string").withColumn("settled", F.lit(False)) for rows in (s, b)]
    for paired in (0, 8, 1024):  # all searched, one of each, all beside
        got = [tuple(r) for r in sc._near(*made, ["res_id"], threshold, paired).distinct().collect()]
        assert len(got) == len(set(got)) and set(got) == want
