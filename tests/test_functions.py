import json
import random
import re
import time

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.parsing import largest_json
from parlance.functions.vectors import cosine
from parlance.operators import responses as rs
from parlance.rules.clinical import ALIASES, LOW_VALUE_REGEX


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def many(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonicalize_text(spark):
    cases = {
        "stuffy nose": "nasal congestion", "covid": "covid-19", "The  Stuffy nose.": "nasal congestion",
        "no covid": "no covid", "non smoker": "non-smoker", "absent covid": "absent covid-19", "absent": "absent",
        "type one diabetes": "type 1 diabetes", "anosmia": "loss of smell", "ageusia": "loss of taste",
        "class exposure": "school exposure", "cat allergy": "possible cat allergy", "daily puffer": "maintenance inhaler",
        "antibiotics prophylaxis": "prophylactic antibiotics", "gallbladder removal": "cholecystectomy",
        "the a cough": "a cough", "absent absent the covid": "absent absent covid-19", "absent no covid": "absent no covid",
        "": "", " .": "", "absent the": "absent the", "An\tx ray;": "x-ray",
    }
    got = many(spark, lambda c: tx.canonicalize_text(c, ALIASES), list(cases))
    assert got == list(cases.values())
    assert many(spark, lambda c: tx.canonicalize_text(c, ALIASES), [None]) == [""]


def test_alias_table_is_idempotent(spark):
    once = many(spark, lambda c: tx.canonicalize_text(c, ALIASES), list(ALIASES))
    assert many(spark, lambda c: tx.canonicalize_text(c, ALIASES), once) == once


def test_evidence_supported(spark):
    text = "Alpha beta  gamma delta. And more"
    cases = {"": False, "x y z": True, "BETA gamma": True, "alpha q gamma r delta": True, "alpha q gamma r s": False}
    df = spark.createDataFrame(list(cases.items()), "ev string, want boolean")
    for row in df.select("want", tx.evidence_supported(F.col("ev"), F.lit(text)).alias("got")).collect():
        assert row.want == row.got


def test_quote_in_turn(spark):
    turn = "I have  a Dry cough, really"
    quotes = {'"a dry cough!"': True, " I HAVE a": True, "wet cough": False, "": False, "?!": True}
    df = spark.createDataFrame(list(quotes.items()), "q string, want boolean")
    for row in df.select("q", "want", tx.quote_in_turn(F.col("q"), F.lit(turn)).alias("got")).collect():
        assert row.want == row.got, row.q


TALK = "[D-1] D: any cough today?\n\n[P-1] P: yes, green phlegm since monday\n\n[D-2] D: were you tired?\n\n[P-2] P: no"


def test_find_evidence_attributes_to_own_turn(spark):
    def find(regex, terms, compat):
        return one(spark, tx.find_evidence(F.col("t"), F.lit(regex), F.array(*map(F.lit, terms)), compat=compat), t=TALK)
    own = find(r"\bgreen (?:phlegm|sputum)\b", ["green"], False)
    assert (own.evidence, own.turn_id, own.via) == ("green phlegm", "P-1", "pattern")
    # The window round the hit also reaches back to the doctor's turn.
    assert find(r"\bgreen (?:phlegm|sputum)\b", ["green"], True).turn_id == "D-1"


def test_find_evidence_fallback_matches_whole_words(spark):
    def find(compat):
        return one(spark, tx.find_evidence(F.col("t"), F.lit(r"\bred spots\b"), F.array(F.lit("ire")), compat=compat), t=TALK)
    assert find(False) is None
    assert find(True).evidence == "ire" and find(True).via == "fallback"


def test_low_value_regex():
    assert re.match(LOW_VALUE_REGEX, "absent sick contacts") and re.match(LOW_VALUE_REGEX, "no pets")
    assert re.match(LOW_VALUE_REGEX, "no confusion/memory loss") and not re.match(LOW_VALUE_REGEX, "absent fever")


def test_error_class(spark):
    rows = [(429, False, "429", True), (503, False, "5xx", True), (408, False, "retriable_other", True),
            (404, False, "nonretriable", False), (None, True, "network", True), (None, False, "retriable_other", True)]
    df = spark.createDataFrame(rows, "s int, n boolean, kind string, retry boolean")
    for r in df.select("*", tx.error_class(F.col("s"), F.col("n")).alias("k"), tx.retriable(F.col("s")).alias("r")).collect():
        assert (r.kind, r.retry) == (r.k, r.r)


def test_cosine(spark):
    assert one(spark, cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert abs(one(spark, cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) - 0.5 ** 0.5) < 1e-12


def test_noisy_json(spark):
    good = '{"matched": [{"label": "x"}]}'
    cases = [
        (good, "whole"), ("<think>{a}</think>" + good, "whole"), (f"Sure\n```json\n{good}\n```", "fenced"),
        (f"Well {good[:-1]}, }} so", "outer"), ("[1, 2,]", "outer"), ("nothing", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content string")
    got = rs.parse_noisy_json(df).select(
        "i", "strategy", rs.parse_status(F.col("content"), F.col("json")).alias("status"),
        rs.parse_status(F.col("content"), F.col("json"), F.lit(True)).alias("edge")).orderBy("i").collect()
    assert [r.strategy for r in got] == [s for _, s in cases]
    assert [r.status for r in got] == ["OK"] * 5 + ["PARSE_FAIL", "LLM_FAIL", "LLM_FAIL"]
    assert [r.edge for r in got][3:5] == ["OK", "PARSE_FAIL"]


def test_largest_json(spark):
    text = 'Draft {"a": 1} then {"matched": [{"b": "{"}], "other": []} bye {"c": 2}'
    more = ['[{"a":1},{"b":22}]', 'So:\n```json\n[{"a": 1}, {"b": 22}]\n```', 'He said "so {"a": {"b": "x}"}, } and {', "7", ""]
    df = spark.createDataFrame([(text,), ("{bad",), ('{"x": 1,}',), *((m,) for m in more)], "t string")
    got = [r[0] for r in df.select(largest_json("t")).collect()]
    assert json.loads(got[0]) == {"matched": [{"b": "{"}], "other": []}
    assert got[1] is None and json.loads(got[2]) == {"x": 1}
    assert json.loads(got[3]) == json.loads(got[4]) == [{"a": 1}, {"b": 22}]
    assert json.loads(got[5]) == {"a": {"b": "x}"}} and got[6:] == [None, None]


def test_evidence_of_many_words_takes_no_quadratic_time(spark):
    words = [f"word{i}" for i in range(60_000)]
    df = spark.createDataFrame([(" ".join(reversed(words)), " ".join(words)), (" ".join([*words, "new"] * 2), " ".join(words[:30_000]))],
                               "ev string, text string")
    judged = df.select(tx.evidence_supported(F.col("ev"), F.col("text")).alias("got"))
    start = time.time()
    assert [r.got for r in judged.collect()] == [True, False]
    # Comparing every word with every known one took far longer.
    assert time.time() - start < 12
