import random

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance import catalog
from parlance.functions.text import evidence_supported
from parlance.operators import extract as ex
from parlance.operators import filters as fl
from parlance.operators import patterns as pt
from parlance.operators.linking import add_inferred_edges, infer_edges
from parlance.operators.turns import render_transcript

TURN = "res_id string, seq bigint, turn_id string, speaker string, text string"
PATTERNS = [
    ("A", "one", r"\bchest (?:pain|ache)\b", ["thorax"]), ("A", "two", r"fever|chills", []), ("B", "three", r"no \w+", ["none"]),
    ("B", "across", r"end\s+\[[DP]-\d+\] [DP]: start", []), ("C", "terms", r"zzz+y", ["ache", "rash"]), ("C", "digits", r"\d\d mg", ["mg"]),
    ("C", "marks", r"[^\w\s]{2}", []),
]


@pytest.mark.parametrize("regex, want", [
    (r"\byellow (?:phlegm|sputum|mucus)\b", ["yellow "]), (r"(?:cat|dog)s?", ["cat", "dog"]), (r"a+b+c", None), (r"(?:abc)+x", ["abc"]),
    (r"(?:abc)?xyz", ["xyz"]), (r"(?i)Fever", ["fever"]), (r"[\p{L}]+ache", ["ache"]), (r"\Qab\E", None), (r"ab|xyzzy", None),
    (r"é(?:lan|cole)", ["cole", "lan"]), (r"(?:abc|bcd)longer", ["longer"]), (r"\d+", None), (r"x{2,}yes", ["yes"]), (r"(", None)])
def test_literals(regex, want):
    assert pt.literals(regex) == want


def talk(seed, conversations=25):
    rnd = random.Random(seed)
    words = ["chest pain", "Chest  ache", "FEVER", "no rash", "ache", "end", "start", "thorax", "50 mg", "mg", "??", "well", "none", "ſtart", "chills\nand"]
    rows = [("x", 1, "D-1", "D", "this is the end"), ("x", 2, "P-1", "P", "start now")]
    for c in range(conversations):
        counts = {"D": 0, "P": 0}
        for seq in range(1, rnd.randrange(1, 12)):
            who = rnd.choice("DP")
            counts[who] += 1
            rows.append((f"r{c}", seq, f"{who}-{counts[who]}", who, " ".join(rnd.choices(words, k=rnd.randrange(1, 5)))))
    return rows


def found(df):
    return sorted((r.res_id, r.type, r.text, r.evidence, r.turn_id, r.via, r.ord) for r in df.collect())


@pytest.mark.parametrize("bracketed", [True, False])
def test_turn_rows_find_what_whole_texts_hold(spark, bracketed):
    turns = spark.createDataFrame(talk(1), TURN)
    whole = found(ex.pattern_extract(render_transcript(turns, bracketed), PATTERNS))
    assert found(ex.pattern_extract(turns.repartition(4), PATTERNS, bracketed=bracketed)) == whole and len(whole) > 60
    assert ("across" in {w[2] for w in whole}) == bracketed


def test_many_patterns_meet_through_literals(spark):
    turns = spark.createDataFrame(talk(2), TURN)
    many = PATTERNS + [("X", f"p{i}", rf"\bword{i}q\b", [f"other{i}"]) for i in range(20_000)]
    whole = found(ex.pattern_extract(render_transcript(turns, True), PATTERNS))
    assert found(ex.pattern_extract(turns, many)) == whole
    as_table = spark.createDataFrame([(i, *p) for i, p in enumerate(many)], "rule bigint, type string, name string, regex string, terms array<string>")
    assert found(ex.pattern_extract(turns, as_table)) == whole
    assert found(ex.pattern_extract(turns, as_table.filter("rule < 7"))) == whole
    texts = render_transcript(turns, True)
    assert found(ex.pattern_extract(texts, as_table)) == whole
    # What is tried follows the literals that texts hold, and the patterns without any.
    tried = pt.with_patterns(texts.select("res_id", "text"), as_table, ["res_id"])
    assert tried.count() < 12 * texts.count()


def test_no_conversation_becomes_one_value(spark):
    turns = spark.createDataFrame(talk(3), TURN)
    plan = ex.pattern_extract(turns, PATTERNS)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_one_long_conversation(spark):
    n = 20_000
    turns = spark.range(1, n + 1).select(
        F.lit("r").alias("res_id"), F.col("id").alias("seq"), F.concat(F.lit("P-"), F.col("id").cast("string")).alias("turn_id"),
        F.lit("P").alias("speaker"), F.when(F.col("id") % 7000 == 0, "chest pain, 50 mg").otherwise("nothing to report").alias("text"))
    got = {(r.text, r.turn_id) for r in ex.pattern_extract(turns, PATTERNS).collect()}
    assert got == {("one", "P-7000"), ("digits", "P-7000")}


def test_empty_and_null(spark):
    turns = spark.createDataFrame([("r", 1, "P-1", "P", None), ("r", 2, "P-2", "P", "fever")], TURN)
    assert [(r.text, r.turn_id) for r in ex.pattern_extract(turns, PATTERNS).collect()] == [("two", "P-2")]
    assert ex.pattern_extract(turns.limit(0), PATTERNS).count() == 0
    assert ex.pattern_extract(turns, []).count() == 0


def test_context_of_hits(spark):
    texts = spark.createDataFrame([("r", "a b the c d e"), ("s", "the"), ("t", ""), ("u", None)], "res_id string, text string")
    vocab = spark.createDataFrame([("the", "X"), ("the c", "Y")], "label string, entity_type string")
    got = {(r.res_id, r.label): (r.start, r.before, r.after) for r in ex.lexicon_extract(texts, vocab, ["res_id"], 2, 3).collect()}
    assert got == {("r", "the"): (2, ["a", "b"], ["c", "d", "e"]), ("r", "the c"): (2, ["a", "b"], ["d", "e"]), ("s", "the"): (0, [], [])}


def quotes_of(rows, seed):
    """Cuts of transcripts, whole and in the middle of words, other words, and what none of them holds."""
    rnd = random.Random(seed)
    lines = {}
    for res, seq, turn, who, text in rows:
        lines.setdefault(res, []).append(f"[{turn}] {who}: {text}")
    out = [("gone", "not a word of it here"), ("gone", "two words"), ("r1", ""), ("r1", None), ("r1", " ... ")]
    for res, own in lines.items():
        whole = "\n".join(own)
        for _ in range(12):
            at = rnd.randrange(len(whole))
            out.append((res, whole[at:at + rnd.randrange(5, 60)].upper() if rnd.random() < 0.3 else whole[at:at + rnd.randrange(5, 40)]))
        out.append((res, " ".join(rnd.choices(whole.split() + ["absent", "unheard", "other"], k=6))))
        out.append((res, "xchest painx fever no rashx"))
    return out


@pytest.mark.parametrize("share, short", [(0.6, 3), (0.95, 3), (0.9, 1)])
def test_quotes_as_the_function_on_whole_texts_judges_them(spark, share, short):
    rows = [r for r in talk(5) if r[0] != "r2"]
    turns = spark.createDataFrame(rows, TURN)
    quotes = spark.createDataFrame(quotes_of(rows, 6), "res_id string, evidence string")
    whole = render_transcript(turns, True)
    want = sorted((r.res_id, r.evidence) for r in quotes.join(whole, "res_id", "left").filter(
        evidence_supported(F.col("evidence"), F.coalesce("text", F.lit("")), share, short)).select("res_id", "evidence").collect())
    assert 100 < len(want) < 350
    for texts in (whole, turns):
        # Quotes of up to sixty characters lie within seven lines.
        kept = fl.grounding_filter(quotes, texts, share, short, reach=5).filter("trim(evidence) != ''")
        assert sorted((r.res_id, r.evidence) for r in kept.collect()) == [w for w in want if w[1].strip()]


def test_relation_rules_as_a_table(spark):
    nodes = spark.createDataFrame([("r", f"N_{i}", f"text {i}", "AB"[i % 2], "e", "D-1", i) for i in range(40)],
                                  "res_id string, id string, text string, type string, evidence string, turn_id string, ord bigint")
    rules = [("s" if i % 2 else "t", i, f"text {i}", ["A", "B"], f"text {i + 1}", ["B", "A"], "LINK") for i in range(20_000)]
    table = spark.createDataFrame(rules, "rule_set string, ord bigint, src string, src_types array<string>, tgt string, tgt_types array<string>, type string")
    got = sorted(tuple(r) for r in infer_edges(nodes, table).collect())
    assert len(got) == 39 and got == sorted(tuple(r) for r in infer_edges(nodes, rules[:100]).collect())
    assert infer_edges(nodes, table, ["s"]).count() == 19
    given = infer_edges(nodes, rules[:3]).withColumn("ord", F.col("ord") + (1 << 50))
    merged = add_inferred_edges(given, infer_edges(nodes, table))
    assert [r.source_id for r in merged.orderBy("ord").collect()][:4] == ["N_0", "N_1", "N_2", "N_3"] and merged.count() == 39


@pytest.mark.parametrize("name", ["pattern_extract_many", "pattern_extract_plain", "pattern_extract_whole"])
def test_sql_of_patterns_finds_the_turn_of_the_match_itself(spark, tmp_path, name):
    rows = [(1, 0, "user", "a cup of x"), (1, 1, "assistant", "tea from here"), (1, 2, "user", "out of it from there")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ["res_id", "type", "text", "evidence", "turn_id", "via"]
    want = sorted(con.sql(catalog.oracle_sql()[name]).select(*columns).fetchall())
    # A match ends with its line: the first "of" and the first "from" are no match together.
    assert want == [(1, "DIAGNOSIS", "great fall", "of it from", "P-2", "pattern")]
    assert [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()] == want


def test_texts_and_quotes_are_shuffled_whole(spark, monkeypatch):
    rows = [r for r in talk(5) if r[0] != "r2"]
    quotes = spark.createDataFrame(quotes_of(rows, 6), "res_id string, evidence string")
    whole = render_transcript(spark.createDataFrame(rows, TURN), True)
    want = sorted((r.res_id, r.evidence) for r in quotes.join(whole, "res_id", "left").filter(
        evidence_supported(F.col("evidence"), F.coalesce("text", F.lit("")))).select("res_id", "evidence").collect())
    several = whole.unionByName(whole.filter("res_id = 'r1'"))
    for texts in (whole, several):
        for quoted in (1 << 20, 40):
            monkeypatch.setattr(fl, "QUOTED", quoted)
            kept = fl.grounding_filter(quotes, texts).filter("trim(evidence) != ''")
            assert sorted((r.res_id, r.evidence) for r in kept.collect()) == [w for w in want if w[1].strip()]
    # Words were rows of a shuffle.
    assert "_word#" not in fl.supported_quotes(quotes, whole)._jdf.queryExecution().optimizedPlan().toString()
